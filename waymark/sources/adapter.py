"""The driver's tables as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def fcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as floating-car data: a user is a vehicle, its events follow second by second, those without a time last; errors stand still."""
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("vehicle_id"), F.row_number().over(w).cast("double").alias("timestep_time"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.least("value", F.lit(20.0))).alias("vehicle_speed"),
        F.col("event_type").alias("vehicle_lane"), F.col("value").alias("vehicle_pos"), "event_id",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by the hour: who is where on which lane at the same time; the first row of a vehicle and hour counts."""
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .withColumn("rn", F.row_number().over(w)).where("rn = 1")
        .select(
            F.col("user_id").cast("string").alias("vehicle_id"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("timestep_time"),
            F.least("value", F.lit(20.0)).alias("vehicle_speed"), F.col("event_type").alias("vehicle_lane"), F.col("value").alias("vehicle_pos"),
        )
    )


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one trace for each supplier with uneven time steps: days are seconds, the first row of a day counts."""
    w = Window.partitionBy("l_suppkey", "l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("rn", F.row_number().over(w)).where("rn = 1")
        .select(
            F.col("l_suppkey").cast("string").alias("vehicle_id"), F.unix_date(F.to_date("l_shipdate")).cast("double").alias("timestep_time"),
            F.when(F.col("l_quantity") <= 5, 0.0).otherwise(F.col("l_quantity") / 3).alias("vehicle_speed"),
            (F.col("l_discount") * 100 - 5).alias("vehicle_accel"), F.col("l_returnflag").alias("vehicle_type"),
        )
    )
