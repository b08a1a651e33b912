"""Ground-truth ingest: time steps, speed and acceleration made to agree, odometer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import converts, finite, known_unit, number, resolve_columns, to_mps

STANDARD = ["timestep_time", "vehicle_id", "vehicle_speed", "vehicle_accel", "vehicle_jerk", "vehicle_odometer", "vehicle_type", "vehicle_x", "vehicle_y"]


def order():
    return Window.partitionBy("vehicle_id").orderBy("timestep_time")


def sanitize(df: DataFrame) -> DataFrame:
    """Numbers as numbers, ids as text, rows without a time or an id dropped."""
    out = df.withColumn("timestep_time", number("timestep_time")).withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    return out.where("timestep_time is not null and vehicle_id is not null")


def dt_stats(df: DataFrame) -> DataFrame:
    """Least, median and greatest of the positive time steps, and how many aren't positive."""
    dt = df.select((F.col("timestep_time") - F.lag("timestep_time").over(order())).alias("dt")).where("dt is not null")
    up = F.when(F.col("dt") > 0, F.col("dt"))
    return dt.agg(F.min(up).alias("dt_min"), F.median(up).alias("dt_median"), F.max(up).alias("dt_max"), F.count_if(F.col("dt") <= 0).alias("n_nonpos"))


def speed_p95(df: DataFrame, unit: str = "m/s") -> DataFrame:
    """95th percentile of speed in m/s, exact, and the hints it gives on the unit it came in: too fast for one that wasn't
    converted, too slow for one that came from km/h."""
    by_factor, from_kmh = converts(unit), unit.strip().lower() in ("kmh", "km/h", "kph")
    p = df.agg(F.percentile("vehicle_speed", F.lit(0.95)).alias("p95"))
    return p.select("p95", ((F.col("p95") > 60) & F.lit(not by_factor)).alias("looks_unconverted"), ((F.col("p95") < 10) & F.lit(from_kmh)).alias("looks_converted_twice"))


def diff_accel(df: DataFrame) -> DataFrame:
    """vehicle_accel from speed by each row's own time step; the first is 0, a step that isn't positive or a speed that isn't finite gives null."""
    dt, v = F.col("timestep_time") - F.lag("timestep_time").over(order()), finite(F.col("vehicle_speed"))
    first = F.lag(F.lit(1)).over(order()).isNull()
    return df.withColumn("vehicle_accel", F.when(first, 0.0).when(dt > 0, (v - F.lag(v).over(order())) / dt))


def integrate_speed(df: DataFrame, initial: float = 0.0, clip: bool = True) -> DataFrame:
    """vehicle_speed from acceleration, held where a step or acceleration is missing, never below 0 after the first row.

    The recursion max(0, v + a dt) is S_t - min(0, least S so far) over the steps that count, S being the running sum.
    """
    initial = initial if abs(initial) < float("inf") else 0.0
    dt, a = F.col("timestep_time") - F.lag("timestep_time").over(order()), finite(F.col("vehicle_accel"))
    valid = F.coalesce(dt > 0, F.lit(False)) & a.isNotNull()
    first = F.lag(F.lit(1)).over(order()).isNull()
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_ok", valid & ~first).withColumn("_s", F.when(F.col("_ok"), a * dt).otherwise(0.0))
    out = out.withColumn("_s", F.lit(float(initial)) + F.sum("_s").over(upto))
    low = F.least(F.lit(0.0), F.coalesce(F.min(F.when(F.col("_ok"), F.col("_s"))).over(upto), F.lit(0.0)))
    return out.withColumn("vehicle_speed", F.col("_s") - low if clip else F.col("_s")).drop("_ok", "_s")


def enforce(df: DataFrame, prefer: str = "speed", initial: float = 0.0, clip: bool = True) -> DataFrame:
    """Acceleration from speed or speed from acceleration, by vehicle: what a vehicle lacks is derived, and with both `prefer` decides."""
    all_rows = Window.partitionBy("vehicle_id")
    has_v, has_a = F.count(finite(F.col("vehicle_speed"))).over(all_rows) > 0, F.count(finite(F.col("vehicle_accel"))).over(all_rows) > 0
    keep = df.withColumn("_v", has_v).withColumn("_a", has_a).withColumn("_speed", F.col("vehicle_speed")).withColumn("_accel", F.col("vehicle_accel"))
    made = integrate_speed(keep, initial, clip).withColumnRenamed("vehicle_speed", "_made_v").withColumn("vehicle_speed", F.col("_speed"))
    made = diff_accel(made).withColumnRenamed("vehicle_accel", "_made_a")
    by_speed = F.col("_v") & (~F.col("_a") | F.lit(prefer.strip().lower() != "accel"))
    by_accel = F.col("_a") & ~by_speed
    out = made.withColumn("vehicle_accel", F.when(by_speed, F.col("_made_a")).otherwise(F.col("_accel"))).withColumn("vehicle_speed", F.when(by_accel, F.col("_made_v")).otherwise(F.col("_speed")))
    return out.select(*df.columns)


def odometer(df: DataFrame) -> DataFrame:
    """vehicle_odometer: running sum of each row's speed times its own step; steps that aren't positive or speeds that aren't finite add nothing."""
    dt, v = F.col("timestep_time") - F.lag("timestep_time").over(order()), finite(F.col("vehicle_speed"))
    step = F.when((dt > 0) & v.isNotNull(), v * dt).otherwise(0.0)
    return df.withColumn("_d", step).withColumn("vehicle_odometer", F.sum("_d").over(order().rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def standardize(df: DataFrame, speed_unit: str = "m/s", prefer: str = "speed", initial: float = 0.0, clip: bool = True, keep_jerk: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the nine standard columns, a report of one row).

    What a column holds, and not only whether it is there, decides what is derived: one pass counts values. An odometer without
    a value is derived, a type without one is 'unknown', and without any speed or acceleration there is nothing to go by.
    """
    prefer = prefer.strip().lower() if prefer.strip().lower() in ("speed", "accel") else "speed"
    found, used, warnings = resolve_columns(df)
    found = found.withColumn("vehicle_speed", to_mps(F.col("vehicle_speed"), speed_unit))
    ready = sanitize(found)
    rows_in, types = found.agg(F.count(F.lit(1)), F.count("vehicle_type")).first()
    rows, speeds, accels, odometers = ready.agg(F.count(F.lit(1)), F.count("vehicle_speed"), F.count("vehicle_accel"), F.count("vehicle_odometer")).first()
    if not speeds and not accels:
        raise ValueError("neither speed nor acceleration has a value")
    if not types:
        ready = ready.withColumn("vehicle_type", F.lit("unknown"))
        warnings.append("no vehicle type: 'unknown'")
    if not known_unit(speed_unit):
        warnings.append(f"unknown speed unit {speed_unit}: taken as m/s")
    if rows < rows_in:
        warnings.append(f"{rows_in - rows} rows without time or id are dropped")
    derived = ["vehicle_accel" if speeds and (prefer == "speed" or not accels) else "vehicle_speed"]
    out = enforce(ready, prefer, initial, clip)
    if not odometers:
        out = odometer(out)
        derived.append("vehicle_odometer")
    if not keep_jerk or used["vehicle_jerk"] is None:
        out = out.withColumn("vehicle_jerk", F.lit(None).cast("double"))
        derived.append("vehicle_jerk")
    out = out.select(*STANDARD)
    hints = speed_p95(found, speed_unit).first()
    warnings += [text for is_so, text in ((hints[1], "the 95th percentile of speed is above 60 m/s"), (hints[2], "the 95th percentile of speed is below 10 m/s after conversion")) if is_so]
    counts = out.agg(F.count(F.lit(1)).alias("rows_out"), F.countDistinct("vehicle_id").alias("n_vehicles"))
    told = {
        "rows_in": F.lit(rows_in).cast("long"), "speed_unit_in": F.lit(speed_unit), "speed_unit_out": F.lit("m/s"), "speed_converted": F.lit(converts(speed_unit)), "prefer": F.lit(prefer),
        "initial_speed": F.lit(float(initial)), "derived_cols": F.array(*map(F.lit, derived)), "warnings": F.array(*map(F.lit, warnings)).cast("array<string>"),
        "used_colmap": F.create_map(*[x for s in STANDARD for x in (F.lit(s), F.lit(used[s]).cast("string"))]),
    }
    return out, dt_stats(out).crossJoin(counts).withColumns(told)
