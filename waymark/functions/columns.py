"""Column helpers: casts, units, lane names, rounding and alias resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed units, all their names, and their factor to metres a second.
TO_MPS = {"mps": 1.0, "m/s": 1.0, "ms": 1.0, "m_s": 1.0, "kmh": 1 / 3.6, "km/h": 1 / 3.6, "kph": 1 / 3.6, "mph": 0.44704}
#: Accepted names of the standard columns, first match wins.
ALIASES = {
    "timestep_time": ("timestep_time", "time", "timestamp", "t", "sec", "secs", "second", "seconds"),
    "vehicle_id": ("vehicle_id", "veh_id", "vehid", "id", "veh", "vehicle"),
    "vehicle_type": ("vehicle_type", "veh_type", "vtype", "type", "class", "vclass"),
    "vehicle_speed": ("vehicle_speed", "speed", "v", "vel", "velocity", "veh_speed"),
    "vehicle_accel": ("vehicle_accel", "vehicle_acceleration", "accel", "acceleration", "a", "veh_accel"),
    "vehicle_jerk": ("vehicle_jerk", "jerk", "j"),
    "vehicle_odometer": ("vehicle_odometer", "odometer", "odo", "distance", "dist", "s", "pos", "mileage"),
}
#: Pairs of x and y names by priority, and the names of one of them where no pair is there.
PAIRS = (("vehicle_x", "vehicle_y"), ("coordinate_x", "coordinate_y"), ("coord_x", "coord_y"), ("pos_x", "pos_y"), ("position_x", "position_y"), ("location_x", "location_y"), ("x", "y"))
SINGLES = {
    "vehicle_x": ("vehicle_x", "x", "pos_x", "position_x", "location_x", "coord_x", "coordinate_x"),
    "vehicle_y": ("vehicle_y", "y", "pos_y", "position_y", "location_y", "coord_y", "coordinate_y"),
}
#: Names that older files use.
LEGACY = {"car_speed": "vehicle_speed", "car_accel": "vehicle_accel", "car_jerk": "vehicle_jerk", "coord_x": "vehicle_x", "coord_y": "vehicle_y"}
LEGACY_TRIP = "工况ID"


def number(c: Column | str) -> Column:
    """try_cast to double; NaN becomes null."""
    c = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Null for infinities too: they take no part in differences and sums."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def known_unit(unit: str) -> bool:
    return unit.strip().lower() in TO_MPS


def converts(unit: str) -> bool:
    return TO_MPS.get(unit.strip().lower(), 1.0) != 1.0


def to_mps(speed: Column, unit: str) -> Column:
    """Speed in m/s; an unknown unit leaves it as it is (known_unit tells)."""
    return speed * F.lit(TO_MPS.get(unit.strip().lower(), 1.0))


def to_kmh(speed: Column) -> Column:
    return speed * 3.6


def half_even(c: Column, decimals: int) -> Column:
    return F.rint(c * float(10**decimals)) / float(10**decimals)


def is_internal(lane: Column) -> Column:
    return F.coalesce(lane.startswith(":"), F.lit(False))


def lane_to_edge(lane: Column) -> Column:
    lane = F.trim(lane)
    return F.when(lane.startswith(":"), lane).otherwise(F.regexp_replace(lane, "_[^_]*$", ""))


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def first_outer_edge(edges: Column) -> Column:
    return F.try_element_at(F.filter(edges, lambda x: ~x.startswith(":")), F.lit(1))


def last_outer_edge(edges: Column) -> Column:
    return F.try_element_at(F.filter(edges, lambda x: ~x.startswith(":")), F.lit(-1))


def plain_name(name: str) -> str:
    """A column name as it is compared: trimmed, lower case, blanks as underscores."""
    return name.strip().lower().replace(" ", "_")


def safe_file_name(name: str, dots: bool = False, collapse: bool = False) -> str:
    """A name without the characters that file systems refuse, each as an underscore; dots too, or runs of them and of white
    space as one underscore that is trimmed at the ends."""
    if collapse:
        return re.sub(r'[\\/*?:"<>|.\s]+', "_", str(name)).strip("_")
    return re.sub(r'[\\/*?:"<>|.]' if dots else r'[\\/*?:"<>|]', "_", str(name))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with the old names that it has as the new ones; a name that is already there stays."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def resolve_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str | None], list[str]]:
    """df as the nine standard columns, which source column each comes from (None: it is null), and warnings.

    Of source names that compare equal the last counts. x and y are taken as a pair, by the pairs' priority, and one by one only
    where no pair is there.
    """
    by_name = {plain_name(c): k for k, c in enumerate(df.columns)}
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    used: dict[str, int | None] = {s: next((by_name[n] for n in names if n in by_name), None) for s, names in ALIASES.items()}
    warnings = []
    pair = next(((x, y) for x, y in PAIRS if x in by_name and y in by_name), None)
    if pair:
        used |= {"vehicle_x": by_name[pair[0]], "vehicle_y": by_name[pair[1]]}
        if pair == PAIRS[-1]:
            warnings.append("x and y are taken as coordinates")
    else:
        used |= {s: next((by_name[n] for n in names if n in by_name), None) for s, names in SINGLES.items()}
        if used["vehicle_x"] is None or used["vehicle_y"] is None:
            warnings.append("no pair of coordinates")
    chosen = []
    for standard, k in used.items():
        text = standard in ("vehicle_id", "vehicle_type")
        source = F.lit(None) if k is None else F.col(f"c{k}")
        chosen.append((source.cast("string") if text else number(source)).alias(standard))
    return plain.select(*chosen), {s: None if k is None else df.columns[k] for s, k in used.items()}, warnings


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
