"""Overwrite-merge of two stages, union of methods, positions by odometer."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import LEGACY, number, renamed, require_columns, to_kmh

CANDIDATES = ["vehicle_jerk", "vehicle_accel", "vehicle_speed", "vehicle_odometer"]


def overwrite_merge(stage1: DataFrame, stage2: DataFrame, keys: list[str] | None = None, policy: str = "notna_any") -> DataFrame:
    """stage1 with stage2's candidate columns where stage2 has any (notna_any) or the last three (notna_all3) of them.

    All candidates are then taken, nulls too. opt_source tells where a row comes from: none, stage1 (any candidate of its own) or
    stage2; an older opt_source goes. Keys are vehicle and time, and the trip where both sides have it; null keys match, and
    several rows of stage2 with a key give as many rows.
    """
    if policy not in ("notna_any", "notna_all3"):
        raise ValueError(f"policy is notna_any or notna_all3, not {policy}")
    used = [c for c in CANDIDATES if c in stage2.columns]
    if not used:
        raise ValueError(f"stage 2 has none of {CANDIDATES}")
    if policy == "notna_all3" and not set(CANDIDATES[1:]) <= set(used):
        raise ValueError(f"notna_all3 needs {CANDIDATES[1:]} in stage 2")
    keys = keys or [k for k in ("trip_id", "vehicle_id", "timestep_time") if k != "trip_id" or {k} <= set(stage1.columns) & set(stage2.columns)]
    one = stage1.drop("opt_source")
    two = stage2.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_{c}") for c in used])
    on = reduce(and_, [one[k].eqNullSafe(two[f"_k{i}"]) for i, k in enumerate(keys)])
    there = [F.col(f"_{c}").isNotNull() for c in (used if policy == "notna_any" else CANDIDATES[1:])]
    out = one.join(two, on, "left").withColumn("_mask", reduce(or_ if policy == "notna_any" else and_, there))
    has_own = reduce(or_, [F.col(c).isNotNull() for c in CANDIDATES if c in one.columns], F.lit(False))
    source = F.when(F.col("_mask"), "stage2").when(has_own, "stage1").otherwise("none")
    values = [F.when(F.col("_mask"), F.col(f"_{c}")).otherwise(F.col(c) if c in one.columns else F.lit(None)).alias(c) for c in used]
    return out.select(*[c for c in one.columns if c not in used], *values, source.alias("opt_source"))


#: Columns that method files must have, those of the simulation besides, and those that may be missing.
METHOD_COLUMNS = ("timestep_time", "vehicle_id", "trip_id", "vehicle_speed")
SIMULATION_COLUMNS = (*METHOD_COLUMNS, "vehicle_x", "vehicle_y", "vehicle_type")
OPTIONAL_COLUMNS = ("vehicle_accel", "vehicle_jerk", "vehicle_odometer", "vehicle_type", "vehicle_x", "vehicle_y")


def standardize_method(df: DataFrame, data_type: str, simulation: bool = False, dt: float = 1.0) -> DataFrame:
    """A method's rows with legacy names renamed, typed, and with acceleration, jerk and odometer where the whole column has no value.

    One pass counts the values of the three. Differences are backward by vehicle, the first 0; a speed that is missing adds
    nothing to the odometer.
    """
    df = renamed(df, LEGACY)
    require_columns(df, list(SIMULATION_COLUMNS if simulation else METHOD_COLUMNS))
    for c in OPTIONAL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c == "vehicle_type" else "double"))
    numbers = [c for c in (*METHOD_COLUMNS, *OPTIONAL_COLUMNS) if c not in ("vehicle_id", "trip_id", "vehicle_type")]
    df = df.withColumns({c: number(c) for c in numbers} | {c: F.col(c).cast("string") for c in ("vehicle_id", "trip_id", "vehicle_type")})
    accels, jerks, odometers = df.agg(*[F.count(c) for c in ("vehicle_accel", "vehicle_jerk", "vehicle_odometer")]).first()
    w = Window.partitionBy("vehicle_id").orderBy("timestep_time")
    change = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) / dt
    if not accels:
        df = df.withColumn("vehicle_accel", change("vehicle_speed"))
    if not jerks:
        df = df.withColumn("vehicle_jerk", change("vehicle_accel"))
    if not odometers:
        step = F.coalesce("vehicle_speed", F.lit(0.0)) * dt + F.coalesce("vehicle_accel", F.lit(0.0)) * (0.5 * dt * dt)
        df = df.withColumn("vehicle_odometer", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select(*METHOD_COLUMNS, *OPTIONAL_COLUMNS).withColumn("data_type", F.lit(data_type))


def merge_methods(simulation: DataFrame, methods: dict[str, DataFrame], dt: float = 1.0, name: str = "SUMO", keep_trip_and_jerk: bool = False) -> DataFrame:
    """The simulation and the methods as one table: types filled from the simulation, positions by its odometer."""
    base = standardize_method(simulation, name, True, dt)
    parts = {name: base} | {k: fill_types(standardize_method(df, k, False, dt), base) for k, df in methods.items()}
    out = interpolate_xy(union_methods(parts), base)
    columns = ["timestep_time", "vehicle_id", "vehicle_speed", "vehicle_accel", "vehicle_odometer", "vehicle_type", "vehicle_x", "vehicle_y", "data_type"]
    return out.select(*columns, *(["trip_id", "vehicle_jerk"] if keep_trip_and_jerk else []))


def track_points(df: DataFrame, ids: list[str]) -> DataFrame:
    """What a figure of tracks shows: the chosen vehicles' places by method and time."""
    return df.where(F.col("vehicle_id").isin(ids)).select("vehicle_id", "data_type", "timestep_time", "vehicle_x", "vehicle_y")


def motion_points(df: DataFrame, ids: list[str], dt: float = 1.0, speed_unit: str = "m/s") -> DataFrame:
    """What a figure of speed, acceleration and jerk shows, by method and vehicle; a vehicle without any acceleration (jerk) gets
    differences, else a missing one is 0."""
    rows = df.where(F.col("vehicle_id").isin(ids)).withColumn("timestep_time", number("timestep_time")).where("timestep_time is not null").withColumn("vehicle_speed", number("vehicle_speed"))
    w, whole = Window.partitionBy("data_type", "vehicle_id").orderBy("timestep_time"), Window.partitionBy("vehicle_id")
    for column, source in (("vehicle_accel", "vehicle_speed"), ("vehicle_jerk", "vehicle_accel")):
        own = number(column) if column in df.columns else F.lit(None).cast("double")
        rows = rows.withColumn("_own", own).withColumn("_some", F.count("_own").over(whole) > 0)
        change = F.coalesce(F.col(source) - F.lag(source).over(w), F.lit(0.0)) / dt
        rows = rows.withColumn(column, F.when(F.col("_some"), F.coalesce("_own", F.lit(0.0))).otherwise(change)).drop("_own", "_some")
    shown = to_kmh(F.col("vehicle_speed")) if speed_unit.lower() in ("km/h", "kmh", "kph") else F.col("vehicle_speed")
    return rows.select("vehicle_id", "data_type", "timestep_time", shown.alias("vehicle_speed_plot"), "vehicle_accel", "vehicle_jerk")


def union_methods(methods: dict[str, DataFrame]) -> DataFrame:
    """All methods' rows with data_type; of rows with the same method, vehicle and time the first by its values counts."""
    out = None
    for name, df in methods.items():
        df = df.withColumn("data_type", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c not in ("data_type", "vehicle_id", "timestep_time"))
    w = Window.partitionBy("data_type", "vehicle_id", "timestep_time").orderBy(*rest)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fill_types(df: DataFrame, types_from: DataFrame) -> DataFrame:
    """vehicle_type where it is missing: the vehicle's first known type by time in types_from."""
    first = types_from.where("vehicle_type is not null").groupBy("vehicle_id").agg(F.min_by("vehicle_type", F.struct("timestep_time", "vehicle_type")).alias("_type"))
    return df.join(first, "vehicle_id", "left").withColumn("vehicle_type", F.coalesce("vehicle_type", "_type")).drop("_type")


def interpolate_xy(df: DataFrame, knots: DataFrame) -> DataFrame:
    """vehicle_x and vehicle_y by odometer along the vehicle's knots (vehicle_odometer, vehicle_x, vehicle_y), beyond the ends by the end segments.

    Of knots with the same odometer the first by x and y counts; with fewer than two, old values stay. Knots become segments that
    are met with the rows in one sort by odometer.
    """
    clean = knots.where("vehicle_odometer is not null and vehicle_x is not null and vehicle_y is not null").groupBy("vehicle_id", F.col("vehicle_odometer").alias("o")).agg(F.min(F.struct("vehicle_x", "vehicle_y")).alias("p"))
    w = Window.partitionBy("vehicle_id").orderBy("o")
    seg = clean.select("vehicle_id", "o", F.col("p.vehicle_x").alias("x"), F.col("p.vehicle_y").alias("y"), F.lead("o").over(w).alias("o2"), F.lead("p.vehicle_x").over(w).alias("x2"), F.lead("p.vehicle_y").over(w).alias("y2"), F.lag("o").over(w).isNull().alias("lead"))
    seg = seg.where("o2 is not null").select("vehicle_id", F.when(F.col("lead"), F.lit(float("-inf"))).otherwise(F.col("o")).alias("_at"), F.lit(0).alias("_kind"), F.struct("o", "x", "y", "o2", "x2", "y2").alias("_s"))
    rows = df.withColumn("_at", F.col("vehicle_odometer")).withColumn("_kind", F.lit(1))
    both = rows.unionByName(seg, allowMissingColumns=True)
    order = Window.partitionBy("vehicle_id").orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where("_kind = 1")
    share = (F.col("vehicle_odometer") - F.col("_s.o")) / (F.col("_s.o2") - F.col("_s.o"))
    value = lambda a, b, old: F.when(F.col("_s").isNotNull() & F.col("vehicle_odometer").isNotNull(), F.col(a) + share * (F.col(b) - F.col(a))).otherwise(F.col(old))
    return met.withColumns({"vehicle_x": value("_s.x", "_s.x2", "vehicle_x"), "vehicle_y": value("_s.y", "_s.y2", "vehicle_y")}).select(*df.columns)


def sample_vehicles(ids: list[str], n: int = 10, seed: int = 42) -> list[str]:
    """n of the ids in order, drawn with a fixed seed; all if there are no more, ten for an n that isn't positive."""
    import numpy as np

    ordered = sorted({str(x) for x in ids})
    n = n if n and n > 0 else 10
    return ordered if n >= len(ordered) else sorted(np.random.default_rng(seed).choice(ordered, size=n, replace=False).tolist())
