"""Trip splitting and unit-step kinematics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import half_even


def segments(df: DataFrame, vehicle: str = "vehicle_id", t: str = "timestep_time", v: str = "vehicle_speed") -> DataFrame:
    """Adds `segment`: 1..K for a vehicle's driving blocks, -1 at rest. A row at rest one second before or after a block joins it;
    between two blocks the later wins. A missing speed counts as driving."""
    w = Window.partitionBy(vehicle).orderBy(t)
    rest = F.coalesce(F.col(v) == 0, F.lit(False))
    marked = df.withColumn("_rest", rest)
    start = ~F.col("_rest") & F.coalesce(F.lag("_rest").over(w), F.lit(True))
    marked = marked.withColumn("_drive", F.when(~F.col("_rest"), F.sum(start.cast("long")).over(w)))
    # A row one second beside a driving row is beside the block's first or last row.
    by_one = F.max(F.when(~F.col("_rest"), F.col("_drive"))).over(Window.partitionBy(vehicle).orderBy(t).rangeBetween(1, 1))
    before = F.max(F.when(~F.col("_rest"), F.col("_drive"))).over(Window.partitionBy(vehicle).orderBy(t).rangeBetween(-1, -1))
    return marked.withColumn("segment", F.coalesce("_drive", F.greatest(by_one, before), F.lit(-1)).cast("long")).drop("_rest", "_drive")


def trip_ids(df: DataFrame, vehicle: str = "vehicle_id", parts: int = 32, sample: int = 1024) -> DataFrame:
    """Adds `trip_id`, the place of (vehicle, segment) among all, from 1. Rows without a vehicle stay and have none.

    No task ranks all keys: distinct keys are dealt into ranges of vehicles, numbered within each, and moved by the counts of the
    ranges before. The cuts between ranges are quantiles of a sample of vehicles, `sample` of them by a hash, so they hold
    whatever prefix the names share.
    """
    keys = df.where(F.col(vehicle).isNotNull()).select(vehicle, "segment").distinct()
    some = sorted(r[0] for r in keys.select(vehicle).distinct().orderBy(F.xxhash64(vehicle)).limit(sample).collect())
    cuts = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(vehicle))) if cuts else F.lit(0)
    keys = keys.withColumn("_p", place)
    offsets = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # `parts` rows at most
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keys.join(F.broadcast(offsets), "_p").withColumn("trip_id", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(vehicle, "segment")))
    return df.join(ranked.select(vehicle, "segment", "trip_id"), [vehicle, "segment"], "left")


def split_trips(df: DataFrame, **names: str) -> DataFrame:
    return trip_ids(segments(df, **names))


def kinematics_forward(df: DataFrame, vehicle: str = "vehicle_id", t: str = "timestep_time", v: str = "vehicle_speed", pos: str | None = "vehicle_pos") -> DataFrame:
    """Adds acceleration, jerk (forward differences at one second, the last is 0), distance, cumulative distance and position,
    by vehicle across trips."""
    w = Window.partitionBy(vehicle).orderBy(t)
    last = F.lead(F.lit(1)).over(w).isNull()
    out = df.withColumn("vehicle_acceleration", F.when(last, 0.0).otherwise(F.coalesce(F.lead(v).over(w) - F.col(v), F.lit(0.0))))
    out = out.withColumn("vehicle_jerk", F.coalesce(F.lead("vehicle_acceleration").over(w) - F.col("vehicle_acceleration"), F.lit(0.0)))
    out = out.withColumn("distance_m", F.col(v) + 0.5 * F.col("vehicle_acceleration"))
    before = F.sum("distance_m").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.lag(F.lit(1)).over(w).isNull()
    out = out.withColumn("cumulative_distance", F.when(first, 0.0).when(F.lag("distance_m").over(w).isNotNull(), before))
    if pos:
        start = F.first(pos, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("mileage_pos", half_even(start + F.col("cumulative_distance"), 4))
    return out


def kinematics_backward(df: DataFrame, dt: float = 1.0, vehicle: str = "vehicle_id", t: str = "timestep_time", v: str = "vehicle_speed") -> DataFrame:
    """Adds accel, jerk (backward differences, the first is 0) and the odometer, the sum of v dt + a dt^2 / 2."""
    w = Window.partitionBy(vehicle).orderBy(t)
    out = df.withColumn("vehicle_accel", F.coalesce(F.col(v) - F.lag(v).over(w), F.lit(0.0)) / dt)
    out = out.withColumn("vehicle_jerk", F.coalesce(F.col("vehicle_accel") - F.lag("vehicle_accel").over(w), F.lit(0.0)) / dt)
    step = F.coalesce(F.col(v), F.lit(0.0)) * dt + F.coalesce("vehicle_accel", F.lit(0.0)) * (0.5 * dt * dt)
    return out.withColumn("vehicle_odometer", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def moving_trips(df: DataFrame, keys: list[str], v: str = "vehicle_speed") -> DataFrame:
    """Rows of the groups that move at all."""
    moves = F.max(F.coalesce(F.col(v), F.lit(0.0)) != 0).over(Window.partitionBy(*keys))
    return df.withColumn("_moves", moves).where("_moves").drop("_moves")


def trip_summary(df: DataFrame) -> DataFrame:
    """Duration, distance and mean speed of each trip."""
    return df.where("segment > 0").groupBy("trip_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max("timestep_time") - F.min("timestep_time")).alias("duration_s"),
        F.sum("distance_m").alias("distance_m"), F.avg("vehicle_speed").alias("mean_speed"),
    )
