"""Savitzky-Golay smoothing of speed with limits, consistency and distance kept."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import LEGACY_TRIP, clip, renamed, require_columns

KEYS = ["trip_id", "vehicle_id"]
WIDEST = 11


@dataclass(frozen=True)
class SmoothConfig:
    """Limits of the smoother: speed in m/s, acceleration in m/s2, the filter's window and degree, the least rows."""

    window: int = WIDEST
    degree: int = 3
    min_length: int = 5
    v_min: float = 0.0
    v_max: float = 16.67
    a_min: float = -4.5
    a_max: float = 2.5
    zero: float = 1e-6
    eps: float = 1e-12
    min_valid: int = 6


@lru_cache
def projection(window: int, degree: int) -> np.ndarray:
    """Row e: weights of the window's samples in the fitted polynomial's value at sample e."""
    x = np.vander(np.arange(window) - window // 2, degree + 1)
    return x @ np.linalg.pinv(x)


def coefficients(window: int = WIDEST, degree: int = 3) -> list[tuple[int, int, list[float]]]:
    """(window, sample, weights) for every odd window from 5 up to the widest."""
    return [(w, e, [float(c) for c in projection(w, min(degree, w - 2))[e]]) for w in range(5, window + 1, 2) for e in range(w)]


def _w(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("timestep_time")


def safe_step(keys=KEYS) -> Column:
    """Column expression input `_dt`: the step before a row; what isn't positive becomes the group's median positive step, or 1."""
    median = F.coalesce(F.median(F.when(F.col("_dt") > 0, F.col("_dt"))).over(Window.partitionBy(*keys)), F.lit(1.0))
    return F.when(F.col("_dt") > 0, F.col("_dt")).otherwise(median)


def with_step(df: DataFrame, keys=KEYS) -> DataFrame:
    w = _w(keys)
    return df.withColumn("_dt", F.col("timestep_time") - F.lag("timestep_time").over(w)).withColumn("_step", safe_step(keys))


def savgol(df: DataFrame, value: str, out: str, window: int = WIDEST, degree: int = 3, least: int = 5) -> DataFrame:
    """Adds the smoothed value by case: windows shrink to the largest odd length that fits; cases under `least` rows stay as they are.

    A row at place e of its window is a weighted sum of lags and leads. The weights of the window of full size, by place, and of
    each smaller one are literals, so a case is sorted once, nothing is joined or collected, and the sums stay in generated code.
    """
    w = _w()
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).withColumn("_rn", F.row_number().over(w) - 1)
    odd = F.least(F.lit(window), F.when(F.col("_n") % 2 == 1, F.col("_n")).otherwise(F.col("_n") - 1)).cast("int")
    rows = rows.withColumn("_win", odd).withColumn("_h", F.floor(F.col("_win") / 2).cast("int"))
    place = F.when(F.col("_rn") < F.col("_h"), F.col("_rn")).when(F.col("_rn") >= F.col("_n") - F.col("_h"), F.col("_win") - F.col("_n") + F.col("_rn")).otherwise(F.col("_h")).cast("int")
    rows = rows.withColumn("_e", place)
    near = {k: f"_x{k + window}" for k in range(-window + 1, window)}
    rows = rows.withColumns({name: F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k > 0 else F.col(value) for k, name in near.items()})
    fitted = F.lit(None).cast("double")
    for size, e, weights in coefficients(window, degree):
        total = reduce(lambda a, b: a + b, [F.lit(c) * F.col(near[k - e]) for k, c in enumerate(weights)])
        fitted = F.when((F.col("_win") == size) & (F.col("_e") == e), total).otherwise(fitted)
    return rows.withColumn(out, F.when(F.col("_n") < least, F.col(value)).otherwise(fitted)).drop("_n", "_rn", "_win", "_h", "_e", *near.values())


def smooth(df: DataFrame, config: SmoothConfig = SmoothConfig()) -> DataFrame:
    """Rows of trips (trip_id, vehicle_id, timestep_time, vehicle_speed, vehicle_odometer) with smoothed vehicle_speed and vehicle_accel.

    Smooth, clip, limit acceleration and integrate again, keep standing starts and ends, scale the inner speeds to the
    odometer's distance, keep the ends once more. A case with fewer than six valid rows, or with a null among its speeds or
    odometers, is clipped only.
    """
    c = config
    w, whole = _w(), Window.partitionBy(*KEYS)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("timestep_time").isNotNull() & F.col("vehicle_speed").isNotNull() & F.col("vehicle_odometer").isNotNull()
    rows = with_step(df).withColumn("_raw", F.col("vehicle_speed")).withColumn("_m", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(w))
    valid = F.count(F.when(ok, 1)).over(whole)
    rows = rows.withColumn("_full", (valid >= c.min_valid) & (valid == F.col("_m")))
    rows = savgol(rows, "_raw", "_sg", c.window, c.degree, c.min_length).withColumn("_sg", clip(F.col("_sg"), c.v_min, c.v_max))
    first = F.first("_sg").over(upto)
    change = F.when(F.col("_i") > 1, clip((F.col("_sg") - F.lag("_sg").over(w)) / F.col("_step"), c.a_min, c.a_max) * F.col("_step")).otherwise(0.0)
    rows = rows.withColumn("_change", change).withColumn("_rec", clip(first + F.sum("_change").over(upto), c.v_min, c.v_max))
    at_end = (F.col("_i") == 1) | (F.col("_i") == F.col("_m"))
    still = at_end & (F.abs("_raw") <= c.zero)
    rows = rows.withColumn("_rec", F.when(still, 0.0).otherwise(F.col("_rec")))
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = F.last("vehicle_odometer").over(ends) - F.first("vehicle_odometer").over(ends)
    rows = rows.withColumn("_next", F.lead("_step").over(w))
    inner = F.sum(F.when(~at_end, F.col("_rec") * F.col("_next")).otherwise(0.0)).over(whole)
    rows = rows.withColumn("_target", target).withColumn("_inner", inner)
    scaled = clip(F.col("_rec") * (F.col("_target") / (F.col("_inner") + c.eps)), c.v_min, c.v_max)
    final = F.when(~at_end & (F.col("_m") > 3) & (F.col("_target") >= 0), scaled).otherwise(F.col("_rec"))
    rows = rows.withColumn("vehicle_speed", F.when(F.col("_full"), final).otherwise(clip(F.col("_raw"), c.v_min, c.v_max)))
    accel = F.when(F.col("_i") == 1, 0.0).otherwise((F.col("vehicle_speed") - F.lag("vehicle_speed").over(w)) / F.col("_step"))
    return rows.withColumn("vehicle_accel", accel).select(*[c for c in df.columns if c != "vehicle_accel"], "vehicle_accel")


def rebuild_odometer(df: DataFrame) -> DataFrame:
    """vehicle_odometer by vehicle: the first raw value (0 if missing) plus what each row's speed covers until the next; a missing speed covers nothing."""
    keys = ["vehicle_id"]
    w = _w(keys)
    rows = with_step(df, keys).withColumn("_next", F.lead("_step").over(w))
    before = F.coalesce(F.sum(F.col("vehicle_speed") * F.col("_next")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = F.coalesce(F.first("vehicle_odometer").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return rows.withColumn("vehicle_odometer", start + before).select(*df.columns)


def add_jerk(df: DataFrame) -> DataFrame:
    """vehicle_jerk by vehicle: backward difference of acceleration by the safe step, the first 0."""
    keys = ["vehicle_id"]
    w = _w(keys)
    jerk = F.when(F.lag(F.lit(1)).over(w).isNull(), 0.0).otherwise((F.col("vehicle_accel") - F.lag("vehicle_accel").over(w)) / F.col("_step"))
    return with_step(df, keys).withColumn("vehicle_jerk", jerk).select(*[c for c in df.columns if c != "vehicle_jerk"], "vehicle_jerk")


SMOOTHED = ["timestep_time", "vehicle_id", "trip_id", "vehicle_speed", "vehicle_accel", "vehicle_jerk", "vehicle_odometer"]


def smooth_trips(df: DataFrame, config: SmoothConfig = SmoothConfig()) -> DataFrame:
    """The whole smoother: speeds and accelerations by trip, the odometer and the jerk by vehicle; what is still missing of the two last is 0."""
    df = renamed(df, {LEGACY_TRIP: "trip_id"})
    require_columns(df, ["timestep_time", "vehicle_id", "trip_id", "vehicle_speed", "vehicle_odometer"])
    smoothed = rebuild_odometer(smooth(df, config)).withColumn("vehicle_accel", F.coalesce("vehicle_accel", F.lit(0.0)))
    return add_jerk(smoothed).withColumn("vehicle_jerk", F.coalesce("vehicle_jerk", F.lit(0.0))).select(*SMOOTHED)
