"""Checks of acceleration and jerk against envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import half_even, number

KEYS = ["trip_id", "vehicle_id"]


def tenths(c: Column, decimals: int = 1) -> Column:
    """Key of an envelope: acceleration in tenths (or by `decimals`), half to even."""
    return F.rint(c * 10**decimals).cast("int")


def jerk_limits(envelope: DataFrame, decimals: int = 1) -> DataFrame:
    """tenths, jerk_min, jerk_max of an envelope (accel_round, q1_smooth, q99_smooth): a row a key with the widest limits; rows without a key go."""
    rows = envelope.where(number("accel_round").isNotNull())
    return rows.groupBy(tenths(number("accel_round"), decimals).alias("tenths")).agg(F.min(number("q1_smooth")).alias("jerk_min"), F.max(number("q99_smooth")).alias("jerk_max"))


def checked(df: DataFrame) -> DataFrame:
    """Rows that checks look at: those with a time and a speed."""
    return df.where(number("timestep_time").isNotNull() & number("vehicle_speed").isNotNull())


def with_jerk(df: DataFrame, dt: float | None = None) -> DataFrame:
    """Adds the forward jerk by trip and vehicle, per second or divided by dt."""
    w = Window.partitionBy(*KEYS).orderBy("timestep_time")
    jerk = F.lead("vehicle_accel").over(w) - F.col("vehicle_accel")
    return df.withColumn("jerk", jerk / dt if dt else jerk)


def judged(df: DataFrame, envelope: DataFrame, decimals: int = 1) -> DataFrame:
    """Adds limits, has_limits and in_envelope; the envelope has a row for each tenth, so it is small and fixed."""
    out = df.withColumn("tenths", tenths(F.col("vehicle_accel"), decimals)).join(jerk_limits(envelope, decimals), "tenths", "left").drop("tenths")
    has = F.col("jerk_min").isNotNull() & F.col("jerk_max").isNotNull()
    return out.withColumn("has_limits", has).withColumn("in_envelope", F.coalesce(has & F.col("jerk").between(F.col("jerk_min"), F.col("jerk_max")), F.lit(False)))


def numbered(df: DataFrame) -> DataFrame:
    """Adds idx from 0 and n, by trip and vehicle."""
    w = Window.partitionBy(*KEYS)
    return df.withColumn("idx", (F.row_number().over(w.orderBy("timestep_time")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def jerk_points(df: DataFrame, envelope: DataFrame, dt: float | None = None, decimals: int = 1) -> DataFrame:
    """The rows that have a jerk, judged and numbered."""
    return numbered(judged(with_jerk(checked(df), dt).where("jerk is not null"), envelope, decimals))


def _passes(points: DataFrame) -> DataFrame:
    inner = points.groupBy(*KEYS).agg(F.max("n").alias("n"), F.bool_and(F.when((F.col("idx") >= 1) & (F.col("idx") <= F.col("n") - 2), F.col("in_envelope"))).alias("ok"))
    return inner.select(*KEYS, "n", F.when(F.col("n") < 3, True).otherwise(F.coalesce("ok", F.lit(False))).alias("ok"))


def bad_cases_all_rows(df: DataFrame, envelope: DataFrame, decimals: int = 1) -> DataFrame:
    """Cases that fail when all rows with a speed are numbered: any inner row outside, three rows or more."""
    return _passes(numbered(judged(with_jerk(checked(df)), envelope, decimals))).where("not ok").select(*KEYS)


def case_summary(df: DataFrame, envelope: DataFrame, dt: float | None = None, decimals: int = 1) -> DataFrame:
    """Every case with pass_in_env_mid and what its points with a jerk show; fewer than three points pass."""
    points = jerk_points(df, envelope, dt, decimals)
    counts = points.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_jerk_points"), F.count_if("in_envelope").alias("n_in_env"), F.count_if(~F.col("has_limits")).alias("n_missing_thr"),
        F.count_if(F.col("has_limits") & ~F.col("in_envelope")).alias("n_out_of_range"), F.min("jerk").alias("jerk_min_obs"), F.max("jerk").alias("jerk_max_obs"),
    )
    out = checked(df).select(*KEYS).distinct().join(_passes(points).drop("n"), KEYS, "left").join(counts, KEYS, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_jerk_points", "n_in_env", "n_missing_thr", "n_out_of_range")}
    return out.withColumns({"pass_in_env_mid": F.coalesce("ok", F.lit(True)), **zero}).drop("ok")


def bad_cases_points(df: DataFrame, envelope: DataFrame, dt: float | None = None) -> DataFrame:
    return case_summary(df, envelope, dt).where("not pass_in_env_mid").select(*KEYS)


def bad_rows(df: DataFrame, bad: DataFrame) -> DataFrame:
    return df.join(bad, KEYS, "left_semi")


def filter_cases(df: DataFrame, envelope: DataFrame, dt: float | None = None, decimals: int = 1, points: bool = True) -> dict[str, DataFrame]:
    """The filter's tables: bad_rows, summary, ok_ids, bad_ids, stats (one row) and, if asked for, points."""
    rows, summary = checked(df), case_summary(df, envelope, dt, decimals)
    ok, bad = (summary.where(x).select(*KEYS) for x in ("pass_in_env_mid", "not pass_in_env_mid"))
    out = {"bad_rows": bad_rows(rows, bad), "summary": summary, "ok_ids": ok, "bad_ids": bad}
    n = F.col("n_jerk_points")
    out["stats"] = summary.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(~F.col("pass_in_env_mid")).alias("bad_cases"), F.count_if("pass_in_env_mid").alias("ok_cases"),
        F.coalesce(F.sum(n), F.lit(0)).alias("jerk_points"), F.coalesce(F.sum(F.greatest(n - 2, F.lit(0))), F.lit(0)).alias("mid_points"),
    )
    if points:
        w = Window.partitionBy(*KEYS).orderBy("timestep_time")
        with_next = rows.withColumn("accel_next", F.lead("vehicle_accel").over(w))
        out["points"] = jerk_points(with_next, envelope, dt, decimals).withColumn("accel_round", half_even(F.col("vehicle_accel"), decimals)).select(
            *KEYS, "timestep_time", "vehicle_accel", "accel_next", "jerk", "accel_round", "jerk_min", "jerk_max", F.col("has_limits").alias("has_thr"), F.col("in_envelope").alias("in_env"), "idx", "n"
        )
    return out


def accel_limits(df: DataFrame, envelope: DataFrame, vehicle_type: str = "vehicle_type") -> DataFrame:
    """Adds the accel envelope's limits at the rounded speed in km/h and the vehicle's type."""
    limits = envelope.select(F.col("speed_kmh").cast("int").alias("kmh"), F.col("vehicle_type").alias(vehicle_type), F.col("q1_smooth").alias("accel_min"), F.col("q99_smooth").alias("accel_max"))
    return df.withColumn("kmh", F.rint(F.col("vehicle_speed") * 3.6).cast("int")).join(limits, ["kmh", vehicle_type], "left")
