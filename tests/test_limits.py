"""Rows that stand at a limit, against the queries' SQL."""

import datetime
import random

import duckdb
import pandas as pd
import pytest
from test_queries import rows

from waymark.plans.queries import ORACLE_SQL, QUERIES

#: Three speeds of a vehicle whose jerk at the second is a limit of the envelope but for the last bit, by seconds and by half seconds.
AT_LIMITS = (
    (4.07, 0.01, 2.59), (3.93, 0.01, 2.65), (3.58, 0.01, 2.88), (1.41, 0.01, 4.17), (0.01, 1.39, 8.33), (0.01, 3.62, 13.67), (0.01, 3.93, 14.41), (0.01, 4.1, 14.83),
    (4.91, 0.8, 0.01), (4.49, 0.61, 0.01), (3.93, 0.37, 0.03), (1.48, 0.03, 1.36), (0.01, 1.39, 5.55), (0.08, 3.69, 10.52), (0.29, 4.18, 11.35), (0.01, 4.1, 11.51),
)


def events(folder, speeds):
    """Speeds of each vehicle, second by second, as events."""
    made, began = [], datetime.datetime(2024, 1, 1)
    for user, values in enumerate(speeds):
        made += [(20 * user + k + 1, began + datetime.timedelta(seconds=k), user, "view", v, "{}") for k, v in enumerate(values)]
    frame = pd.DataFrame(made, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame["event_id"] = frame["event_id"] * 13 + 1  # none is among the missing speeds
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(folder / "events.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["case_summary", "filter_points", "jerk_envelope_points"])
def test_jerk_at_a_limit(spark, tmp_path, name):
    con = events(tmp_path, AT_LIMITS)
    ours, theirs = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(ours) and rows(ours) == rows(theirs)


#: Speeds of a vehicle whose accelerations and jerks are next to zero, or go to zero from below when they are rounded.
NEAR_ZERO = ((0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (5.0, 4.97, 4.96, 4.96, 4.97, 4.93), (7.3, 7.2, 7.1, 7.0, 6.9, 6.8), (3.0, 3.0, 2.9999999, 2.9999999, 3.0, 2.9999998))


def exact(frame, keys=("trip_id", "vehicle_id", "timestep_time")):
    """Rows to the last bit: a zero below zero isn't a zero above it."""
    return [tuple(map(repr, r)) for r in frame.sort_values(list(keys))[sorted(frame.columns)].astype(object).values.tolist()]


@pytest.mark.parametrize("name", ["filter_points", "jerk_envelope_points"])
def test_sign_of_zero(spark, tmp_path, name):
    con = events(tmp_path, NEAR_ZERO)
    ours, theirs = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert any("-0.0" in r for r in exact(theirs)) and exact(ours) == exact(theirs)


@pytest.mark.parametrize("name", ["filter_points", "jerk_envelope_points"])
def test_events_without_a_time(spark, tmp_path, name):
    """They come last, those without an id behind the others."""
    con = events(tmp_path, [(3.0, 4.5, 6.25, 2.0, 7.75, 1.5), (1.0, 1.5, 0.0, 2.5, 2.25, 9.0)])
    frame = pd.read_parquet(tmp_path / "events.parquet")
    frame.loc[[0, 2, 4, 7, 8, 9], "ts"] = pd.NaT
    frame["event_id"] = frame["event_id"].astype("Int64")
    frame.loc[[2, 8], "event_id"] = pd.NA
    frame.to_parquet(tmp_path / "events.parquet", index=False)
    ours, theirs = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(ours) and exact(ours) == exact(theirs)


def test_sixth_decimal(spark, tmp_path):
    """Positions that end in half a millionth are rounded as by the SQL. Vehicles have 16 rows at most: longer sums have no fixed order in the SQL."""
    dealt = random.Random(7)
    con = events(tmp_path, [[round(dealt.uniform(0.01, 20), 2) for _ in range(16)] for _ in range(1500)])
    ours, theirs = QUERIES["xy_interpolate"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["xy_interpolate"]).df()
    keys = ["data_type", "vehicle_id", "timestep_time"]
    both = ours.merge(theirs, on=keys)
    assert len(both) == len(ours) == len(theirs) == 2 * 16 * 1500
    for c in ("vehicle_x", "vehicle_y"):
        assert ((both[f"{c}_x"] == both[f"{c}_y"]) | both[f"{c}_x"].isna() & both[f"{c}_y"].isna()).all()
