"""Scans of network, route and trace files; sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.columns import is_internal, number

FCD_XML = "_time double, vehicle array<struct<_id string, _lane string, _pos double, _speed double, _x double, _y double, _type string, _odometer double, _VALUE string>>"


def fcd_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a floating-car-data export, one a vehicle and time step."""
    steps = spark.read.format("xml").option("rowTag", "timestep").schema(FCD_XML).load(path)
    names = {"_id": "vehicle_id", "_lane": "vehicle_lane", "_pos": "vehicle_pos", "_speed": "vehicle_speed", "_x": "vehicle_x", "_y": "vehicle_y", "_type": "vehicle_type", "_odometer": "vehicle_odometer"}
    return steps.select(F.col("_time").alias("timestep_time"), F.explode("vehicle").alias("v")).select("timestep_time", *[F.col(f"v.{a}").alias(b) for a, b in names.items()])


def connections_xml(spark: SparkSession, path: str, include_internal: bool = True) -> DataFrame:
    """lane_id, next_lane_id of a network; a connection by an internal lane gives two links."""
    c = spark.read.format("xml").option("rowTag", "connection").schema("_from string, _to string, _fromLane string, _toLane string, _via string, _VALUE string").load(path)
    c = c.where("_from <> '' and _to <> '' and _fromLane is not null and _toLane is not null")
    a, b, via = F.concat_ws("_", "_from", "_fromLane"), F.concat_ws("_", "_to", "_toLane"), F.when(F.col("_via") != "", F.col("_via"))
    if not include_internal:
        c = c.where(~is_internal(a) & ~is_internal(b) & ~is_internal(via))
    link = lambda x, y: F.struct(x.alias("lane_id"), y.alias("next_lane_id"))
    return c.select(F.explode(F.when(via.isNotNull(), F.array(link(a, via), link(via, b))).otherwise(F.array(link(a, b)))).alias("l")).select("l.*").distinct()


def lanes_xml(spark: SparkSession, path: str, include_internal: bool = True) -> DataFrame:
    """lane_id and length; a length that is no number is null."""
    lanes = spark.read.format("xml").option("rowTag", "lane").schema("_id string, _length string, _VALUE string").load(path).where("_id is not null and _length is not null")
    out = lanes.select(F.col("_id").alias("lane_id"), number("_length").alias("length")).distinct()
    return out if include_internal else out.where(~is_internal(F.col("lane_id")))


FLOWS = "flow_id string, from_edge string, to_edge string, vehs_per_hour double"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def flows_xml(spark: SparkSession, path: str | None) -> DataFrame:
    """Flows of a route file; none without a path or a file there."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], FLOWS)
    flows = spark.read.format("xml").option("rowTag", "flow").schema("_id string, _from string, _to string, _vehsPerHour string, _VALUE string").load(path)
    return flows.where("_id <> '' and _from <> '' and _to <> ''").select(F.col("_id").alias("flow_id"), F.col("_from").alias("from_edge"), F.col("_to").alias("to_edge"), number("_vehsPerHour").alias("vehs_per_hour"))


def csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV with a header; a byte-order mark before the first name is dropped. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("\ufeff"))


def write_csv(df: DataFrame, path: str, one_file: bool = False, mark: bool = False) -> None:
    """A folder of CSV files with a header, or one; with `mark` the header starts with a byte-order mark."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, out_format: str = "csv") -> str:
    """df as Parquet or as a CSV with a byte-order mark; where it is."""
    path = f"{path}.{out_format.lower()}"
    if out_format.lower() == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        write_csv(df, path, mark=True)
    return path


def envelope_csv(spark: SparkSession, path: str, duplicates: str = "widest", decimals: int = 1) -> DataFrame:
    """accel_round, q1_smooth and q99_smooth of a jerk envelope, keys rounded half to even; rows without a key go.

    Of several rows with a key "widest" keeps the least and the greatest limit, "last" the one furthest down, "all" every row.
    """
    from waymark.functions.columns import half_even, require_columns

    rows = csv(spark, path)
    require_columns(rows, ["accel_round", "q1_smooth", "q99_smooth"])
    rows = rows.select(half_even(number("accel_round"), decimals).alias("accel_round"), number("q1_smooth").alias("q1_smooth"), number("q99_smooth").alias("q99_smooth"), F.monotonically_increasing_id().alias("at"))
    rows = rows.where("accel_round is not null")
    if duplicates == "all":
        return rows.drop("at")
    if duplicates == "last":
        rows = rows.where("q1_smooth is not null and q99_smooth is not null")
        return rows.groupBy("accel_round").agg(F.max_by("q1_smooth", "at").alias("q1_smooth"), F.max_by("q99_smooth", "at").alias("q99_smooth"))
    return rows.groupBy("accel_round").agg(F.min("q1_smooth").alias("q1_smooth"), F.max("q99_smooth").alias("q99_smooth"))


def accel_envelope_csv(spark: SparkSession, path: str) -> DataFrame:
    """speed_kmh, vehicle_type, q1_smooth and q99_smooth of an acceleration envelope."""
    return csv(spark, path).select(F.col("speed_kmh").try_cast("int").alias("speed_kmh"), "vehicle_type", number("q1_smooth").alias("q1_smooth"), number("q99_smooth").alias("q99_smooth"))


#: Where results go below an output folder.
OUTPUT_TREE = {"badcase": "15_badcase", "merge": "99_merge", "logs": "logs", "ground_truth": "00_ground_truth"}


def output_folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{OUTPUT_TREE[kind]}"


def semicolon_to_comma(spark: SparkSession, source: str, target: str) -> None:
    write_csv(csv(spark, source, ";"), target)


def csv_to_parquet(spark: SparkSession, source: str, target: str, sep: str = ",", schema: str | None = None) -> None:
    csv(spark, source, sep, schema).write.mode("overwrite").parquet(target)


def convert_fcd(spark: SparkSession, source: str, folder: str, make_comma_csv: bool = True, make_parquet: bool = False, prefix: str = "FCD") -> list[str]:
    """FCD XML to comma CSV and Parquet below folder; what was written."""
    rows, made = fcd_xml(spark, source), []
    if make_comma_csv:
        write_csv(rows, f"{folder}/{prefix}.csv")
        made.append(f"{folder}/{prefix}.csv")
    if make_parquet:
        rows.write.mode("overwrite").parquet(f"{folder}/{prefix}.parquet")
        made.append(f"{folder}/{prefix}.parquet")
    return made


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as JSON lines."""
    row.coalesce(1).write.mode("overwrite").json(path)


def resource(name: str, own: str | None = None) -> Path:
    """The first that exists of: own path, this folder, its resources, the working folder, its resources."""
    here = Path(__file__).resolve().parent
    for place in [*([Path(own)] if own else []), here / name, here / "resources" / name, Path.cwd() / name, Path.cwd() / "resources" / name]:
        if place.exists():
            return place
    raise FileNotFoundError(name)


def snapshot(config: dict, stats: dict) -> str:
    return json.dumps({"config": config, "stats": stats}, ensure_ascii=False, indent=2, default=str)
