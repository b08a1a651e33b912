"""Queries on the driver's tables and the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.columns import number, to_mps
from waymark.operators import envelope as env
from waymark.operators import merge, neighbors, optimize, smooth, standardize, topology, trips
from waymark.sources import network
from waymark.sources.adapter import fcd, fleet, snapshots

LINKS = (("click", "view"), ("view", "purchase"), ("purchase", "signup"), ("view", "signup"), ("signup", "error"), ("error", "click"))
LENGTHS = (("click", 120.0), ("view", 80.5), ("purchase", 60.25), ("signup", 200.0), ("error", 40.0))
PLAIN_LINKS = (("a_0", "a_1"), ("a_1", ":j_0"), ("a_0", ":j_0"), (":j_0", "b_0"), ("b_0", "c_0"), ("b_0", "d_0"), ("d_0", "e_0"), ("e_0", "b_0"), ("c_0", "f_1"), ("g_0", "c_0"))
PLAIN_LENGTHS = (("a_0", 10.0), ("a_1", 4.0), (":j_0", 2.0), ("b_0", 20.0), ("c_0", 5.5), ("d_0", 7.0), ("e_0", 9.0), ("f_1", 3.0), ("g_0", 4.0))


def pairs(spark: SparkSession, rows, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])).alias("r")).select("r.*")


def links_of(spark, rows=LINKS):
    return pairs(spark, rows, "lane_id string, next_lane_id string")


def lengths_of(spark, rows=LENGTHS):
    return pairs(spark, rows, "lane_id string, length double")


def limits(spark: SparkSession, scale: float = 1.0) -> DataFrame:
    """A jerk envelope by rule: a row for each tenth from -4.1 to 4.1. Limits are whole hundredths divided once, so they are the
    doubles nearest to the rule's decimals and a jerk at a limit is judged as by the SQL."""
    k = F.col("id") - 41
    low, high = (-600 - F.abs(k) * 5) / 100 * scale, (500 + F.abs(k) * 4) / 100 * scale
    return spark.range(83).select((k / 10).alias("accel_round"), low.alias("q1_smooth"), high.alias("q99_smooth"))


def accel_table(spark: SparkSession) -> DataFrame:
    """An acceleration envelope by rule for three types, 0 to 100 km/h."""
    return spark.range(101).select(F.col("id").alias("speed_kmh"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("vehicle_type")).withColumns(
        {"q1_smooth": -2 - F.col("speed_kmh") / 100, "q99_smooth": 3 - F.col("speed_kmh") / 50}
    )


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles at six decimals, as the SQL rounds them: half away from zero by the double's millionfold, not by its shortest decimals.
    What is rounded to zero keeps its sign."""
    for c, kind in df.dtypes:
        if kind == "double" and (not names or c in names):
            many = F.col(c) * 1e6
            whole = F.rint(many)  # half to even: a half that went to zero goes back
            whole = F.when(many - whole == F.signum(many) * 0.5, whole + F.signum(many)).otherwise(whole)
            df = df.withColumn(c, F.when(F.abs(many) < float("inf"), whole / 1e6).otherwise(F.col(c)))
    return df


def with_trips(spark, d):
    return trips.split_trips(fcd(spark, d))


def profile(spark, d):
    """Trips with backward kinematics: acceleration, jerk and odometer."""
    return trips.kinematics_backward(with_trips(spark, d).withColumn("trip_id", F.col("trip_id").cast("string")))


def gappy(spark, d):
    """The profile with some speeds missing: checks leave these rows out before they number the others."""
    return profile(spark, d).withColumn("vehicle_speed", F.when(F.col("event_id") % 13 != 0, F.col("vehicle_speed")))


def _filtered(spark, d):
    """The filter's points with its one-row stats beside them."""
    made = env.filter_cases(gappy(spark, d), limits(spark), dt=0.5)
    return r6(made["points"].crossJoin(made["stats"]).select("trip_id", "vehicle_id", "timestep_time", "accel_next", "jerk", "accel_round", "has_thr", "in_env", "idx", "n", "total_cases", "bad_cases", "ok_cases", "jerk_points", "mid_points"))


def _smoothed(spark, d):
    return r6(smooth.smooth_trips(profile(spark, d)))


def _methods(spark, d):
    """Both methods as raw files have them, through the whole merge."""
    base, other = methods(spark, d)
    raw = with_trips(spark, d).select("vehicle_id", "timestep_time", F.col("trip_id").cast("string").alias("trip_id"))
    one = base.join(raw, ["vehicle_id", "timestep_time"]).drop("vehicle_odometer", "vehicle_accel")
    one = one.withColumnsRenamed({"vehicle_x": "coord_x", "vehicle_y": "coord_y"})
    two = other.join(raw, ["vehicle_id", "timestep_time"]).select("trip_id", "vehicle_id", "timestep_time", F.col("vehicle_speed").cast("string").alias("car_speed"))
    out = merge.merge_methods(one, {"RVST": two}, keep_trip_and_jerk=True)
    return r6(out.select("data_type", "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_accel", "vehicle_jerk", "vehicle_odometer", "vehicle_type", "trip_id"))


def _motion(spark, d):
    base, other = methods(spark, d)
    both = merge.union_methods({"SUMO": base.drop("vehicle_accel"), "RVST": other.drop("vehicle_accel")})
    ids = merge.sample_vehicles([str(k) for k in range(1, 40)], 12)
    return r6(merge.motion_points(both, ids, 0.5, "km/h"))


def _tracks(spark, d):
    base, other = methods(spark, d)
    return r6(merge.track_points(merge.union_methods({"SUMO": base, "RVST": other}), merge.sample_vehicles([str(k) for k in range(1, 40)], 12)))


def _report(spark, d):
    """The report of an ingest whose odometer and type columns have no value and whose unit is unknown to it."""
    raw = fleet(spark, d).select(F.col("timestep_time").alias("Seconds"), F.col("vehicle_id").alias("VehID"), F.col("vehicle_speed").alias("vel"), F.lit(None).cast("double").alias("mileage"), F.lit(None).cast("string").alias("vclass"))
    out, report = standardize.standardize(raw, "knots")
    total = out.agg(F.sum("vehicle_odometer").alias("odometers"), F.count_if(F.col("vehicle_type") == "unknown").alias("unknown_types"))
    told = report.withColumns({"derived_cols": F.array_join("derived_cols", ","), "n_warnings": F.size("warnings"), "speed_from": F.col("used_colmap")["vehicle_speed"], "odometer_from": F.col("used_colmap")["vehicle_odometer"]})
    return r6(told.drop("warnings", "used_colmap").crossJoin(total))


def _written(spark, d):
    """Traces through the sources: written as a CSV with a byte-order mark, as Parquet, and read back."""
    folder = scratch(spark)
    network.write_csv(fcd(spark, d).select("vehicle_id", "timestep_time", "vehicle_speed"), f"{folder}/marked", mark=True)
    fcd(spark, d).select("vehicle_id", "timestep_time", "vehicle_lane").write.option("header", True).option("sep", ";").csv(f"{folder}/semicolon")
    network.semicolon_to_comma(spark, f"{folder}/semicolon", f"{folder}/comma")
    network.csv_to_parquet(spark, f"{folder}/marked", f"{folder}/parquet")
    back = spark.read.parquet(network.write_table(spark.read.parquet(f"{folder}/parquet"), f"{folder}/table", "parquet"))
    lanes = network.csv(spark, f"{folder}/comma")
    return r6(back.join(lanes, ["vehicle_id", "timestep_time"]).select("vehicle_id", number("timestep_time").alias("timestep_time"), number("vehicle_speed").alias("vehicle_speed"), "vehicle_lane"))


NET = """<net><edge id="a"><lane id="a_0" length="10.5"/><lane id=":j_0" length="x"/></edge><edge id="b"><lane id="b_0" length="20"/></edge><edge id="c"><lane id="c_0"/></edge>
<connection from="a" to="b" fromLane="0" toLane="0" via=":j_0"/><connection from="b" to="c" fromLane="0" toLane="0"/><connection from="" to="c" fromLane="0" toLane="0"/></net>"""
ROUTES = """<routes><flow id="f1" from="a" to="c" vehsPerHour="100"/><flow id="f2" from="a" to="c" vehsPerHour="x"/><flow id="f3" from="a" to="c" vehsPerHour="250"/><flow id="f4" from="b" to="c"/></routes>"""


def _network(spark, d):
    """A small network's files, written by a plain text sink and read by the XML scans: links, lanes and the best flows."""
    folder = scratch(spark)
    for name, text in (("net.xml", NET), ("rou.xml", ROUTES)):
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    rows = network.connections_xml(spark, f"{folder}/net.xml").select(F.lit("link").alias("kind"), F.col("lane_id").alias("a"), F.col("next_lane_id").alias("b"), F.lit(None).cast("double").alias("x"))
    rows = rows.unionByName(network.lanes_xml(spark, f"{folder}/net.xml").select(F.lit("lane").alias("kind"), F.col("lane_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("length").alias("x")))
    rows = rows.unionByName(network.lanes_xml(spark, f"{folder}/net.xml", False).select(F.lit("outer").alias("kind"), F.col("lane_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("length").alias("x")))
    best = topology.best_flows(network.flows_xml(spark, f"{folder}/rou.xml"))
    rows = rows.unionByName(best.select(F.lit("flow").alias("kind"), F.concat_ws(">", "from_edge", "to_edge").alias("a"), F.col("flow_id").alias("b"), F.lit(None).cast("double").alias("x")))
    return rows.unionByName(network.flows_xml(spark, f"{folder}/none.xml").select(F.lit("none").alias("kind"), F.col("flow_id").alias("a"), F.col("flow_id").alias("b"), F.col("vehs_per_hour").alias("x")))


def blanked(df: DataFrame) -> DataFrame:
    """A first stage for the merge: some rows have jerk alone, some nothing, and an old opt_source."""
    gone = lambda c, n: F.when(F.col("event_id") % 11 > n, F.col(c)).alias(c)
    return df.select("trip_id", "vehicle_id", "timestep_time", "event_id", F.lit("old").alias("opt_source"), gone("vehicle_jerk", 0), *[gone(c, 1) for c in ("vehicle_accel", "vehicle_speed", "vehicle_odometer")])


def changed(df: DataFrame) -> DataFrame:
    """A second stage for the merge: every third event, some of its columns missing, every 21st twice."""
    every = df.where("event_id % 3 = 0")
    every = every.unionByName(every.where("event_id % 21 = 0").withColumn("vehicle_accel", F.col("vehicle_accel") - 7))
    return every.select(
        "trip_id", "vehicle_id", "timestep_time", F.when(F.col("event_id") % 2 == 0, F.col("vehicle_accel") + 1).alias("vehicle_accel"),
        F.when(F.col("event_id") % 5 != 0, F.col("vehicle_speed") + 2).alias("vehicle_speed"), F.when(F.col("event_id") % 7 != 0, F.col("vehicle_odometer") + 3).alias("vehicle_odometer"),
    )


def methods(spark, d):
    """Two methods on the same traces: the base has positions at every tenth row, the other shifted speeds."""
    base = trips.kinematics_backward(fcd(spark, d)).drop("vehicle_jerk", "vehicle_lane", "vehicle_pos")
    base = base.withColumns({"vehicle_type": F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("T"), (F.col("event_id") % 3).cast("string"))), "vehicle_x": F.when(F.col("event_id") % 10 == 0, F.col("timestep_time") * 2), "vehicle_y": F.when(F.col("event_id") % 10 == 0, F.col("timestep_time") - 5)})
    other = base.withColumns({"vehicle_speed": F.col("vehicle_speed") + 0.5, "vehicle_odometer": F.col("vehicle_odometer") * 1.01, "vehicle_type": F.lit(None).cast("string"), "vehicle_x": F.lit(None).cast("double"), "vehicle_y": F.lit(None).cast("double")})
    return base, other


def regular(spark, d):
    """Trips as the optimiser takes them: gentle speeds about 10 m/s, an end at steady speed, the odometer that goes with them."""
    w = trips.Window.partitionBy("trip_id", "vehicle_id").orderBy("timestep_time")
    rows = with_trips(spark, d).where("segment > 0").withColumn("_v", 10 + (F.col("vehicle_speed") - 10) / 10)
    rows = rows.withColumn("vehicle_speed", F.when(F.lead("_v").over(w).isNull(), F.coalesce(F.lag("_v").over(w), "_v")).otherwise(F.col("_v")))
    step = F.coalesce((F.col("vehicle_speed") + F.lag("vehicle_speed").over(w)) / 2, F.lit(0.0))
    rows = rows.withColumn("_s", step)
    return rows.withColumn("vehicle_odometer", F.sum("_s").over(w)).select(F.col("trip_id").cast("string").alias("trip_id"), "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_odometer")


def _stage2(spark, d):
    one = optimize.run_stage1(regular(spark, d), 2.0)
    return optimize.run_stage2(one, env.bad_cases_all_rows(one, limits(spark, 0.3)), limits(spark, 0.3))


def _neighbors(side):
    def run(spark, d):
        out = neighbors.neighbors(snapshots(spark, d), links_of(spark), lengths_of(spark))
        return r6(out.select("vehicle_id", "timestep_time", *[f"{side}_{c}" for c in ("vehicle_id", "flow_pos", "vehicle_speed", "vehicle_lane", "headway_distance")]))

    return run


def _merge(policy):
    def run(spark, d):
        one = profile(spark, d)
        out = merge.overwrite_merge(blanked(one), changed(one), policy=policy)
        return r6(out.select("trip_id", "vehicle_id", "timestep_time", "vehicle_jerk", "vehicle_accel", "vehicle_speed", "vehicle_odometer", "opt_source"))

    return run


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where the master is local and nothing is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
    return f"{root.rstrip('/')}/sources-{uuid.uuid4().hex}"


def _paths(spark, d):
    return topology.simple_paths(links_of(spark, PLAIN_LINKS)).select("path_id", F.array_join("path", ">").alias("path"))


def _path_tables(spark, d):
    links = links_of(spark, PLAIN_LINKS)
    flows = pairs(spark, (("f1", "a", "f", 100.0), ("f2", "a", "f", 250.0), ("f3", "g", "f", 50.0)), "flow_id string, from_edge string, to_edge string, vehs_per_hour double")
    table, long = topology.path_tables(topology.simple_paths(links), lengths_of(spark, PLAIN_LENGTHS), links, flows)
    return r6(long.join(table, "path_id").select("path_id", "EdgeLane_seq", "EdgeLane_id", "EdgeLane_length", "cum_length", "cum_length_prev", "flow_id", "path_len", "n_edge_lanes", "is_strict_start_edge", "is_strict_end_edge"))


def _xy(spark, d):
    base, other = methods(spark, d)
    all_rows = merge.union_methods({"SUMO": base, "RVST": other})
    return r6(merge.interpolate_xy(all_rows, base).select("data_type", "vehicle_id", "timestep_time", "vehicle_x", "vehicle_y"))


def _types(spark, d):
    base, other = methods(spark, d)
    return merge.fill_types(merge.union_methods({"SUMO": base, "RVST": other}), base).select("data_type", "vehicle_id", "timestep_time", "vehicle_type")


def _union(spark, d):
    base, other = methods(spark, d)
    return r6(merge.union_methods({"SUMO": base, "RVST": other}).select("data_type", "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_odometer"))


def _standard(spark, d):
    raw = fleet(spark, d).select(F.col("timestep_time").alias("Time"), F.col("vehicle_id").alias("veh id"), F.col("vehicle_speed").alias("V"), F.col("vehicle_type").alias("type"))
    return r6(standardize.standardize(raw, "km/h")[0].select("timestep_time", "vehicle_id", "vehicle_speed", "vehicle_accel", "vehicle_odometer", "vehicle_type"))


QUERIES = {
    "trip_summary": lambda s, d: r6(trips.trip_summary(trips.kinematics_forward(with_trips(s, d)))),
    "trip_split": lambda s, d: with_trips(s, d).select("vehicle_id", "timestep_time", "segment", "trip_id"),
    "kinematics_forward": lambda s, d: r6(trips.kinematics_forward(fcd(s, d)).select("vehicle_id", "timestep_time", "vehicle_acceleration", "vehicle_jerk", "distance_m", "cumulative_distance", "mileage_pos")),
    "kinematics_backward": lambda s, d: r6(trips.kinematics_backward(fcd(s, d), 0.5).select("vehicle_id", "timestep_time", "vehicle_accel", "vehicle_jerk", "vehicle_odometer")),
    "idle_trip_filter": lambda s, d: trips.moving_trips(with_trips(s, d), ["trip_id"]).select("vehicle_id", "timestep_time", "trip_id"),
    "dt_stats": lambda s, d: r6(standardize.dt_stats(fleet(s, d))),
    "unit_convert_p95": lambda s, d: r6(standardize.speed_p95(fleet(s, d).withColumn("vehicle_speed", to_mps(F.col("vehicle_speed") * 6, "kph")), "kph")),
    "gt_accel_from_speed": lambda s, d: r6(standardize.diff_accel(fleet(s, d)).select("vehicle_id", "timestep_time", "vehicle_accel")),
    "gt_speed_from_accel": lambda s, d: r6(standardize.integrate_speed(fleet(s, d), 1.5).select("vehicle_id", "timestep_time", "vehicle_speed")),
    "gt_odometer": lambda s, d: r6(standardize.odometer(fleet(s, d)).select("vehicle_id", "timestep_time", "vehicle_odometer")),
    "gt_standardize": _standard,
    "lane_reach": lambda s, d: r6(topology.reach(links_of(s), lengths_of(s)).withColumn("ahead", F.lit(True)).unionByName(topology.reach(links_of(s), lengths_of(s), forward=False).withColumn("ahead", F.lit(False)))),
    "lane_links_full": lambda s, d: topology.lane_links_full(links_of(s, PLAIN_LINKS), lengths_of(s, PLAIN_LENGTHS)),
    "lane_degrees": lambda s, d: topology.degrees(links_of(s, PLAIN_LINKS)),
    "path_enumeration": _paths,
    "path_tables": _path_tables,
    "neighbors_ahead": _neighbors("following"),
    "neighbors_behind": _neighbors("preceding"),
    "neighbors_full": lambda s, d: r6(neighbors.neighbors(snapshots(s, d), links_of(s), lengths_of(s)).select("vehicle_id", "timestep_time", "lane_length", "vehicle_edge", "following_vehicle_id", "preceding_vehicle_id", "following_headway_distance", "preceding_headway_distance")),
    "safe_distance": lambda s, d: r6(optimize.safe_distance(neighbors.neighbors(snapshots(s, d), links_of(s), lengths_of(s)))),
    "jerk_envelope_points": lambda s, d: r6(env.jerk_points(gappy(s, d), limits(s)).select("trip_id", "vehicle_id", "timestep_time", "jerk", "jerk_min", "jerk_max", "in_envelope", "idx", "n")),
    "bad_cases_allrows": lambda s, d: env.bad_cases_all_rows(gappy(s, d), limits(s)),
    "bad_cases_points": lambda s, d: env.bad_cases_points(gappy(s, d), limits(s)),
    "bad_case_rows": lambda s, d: env.bad_rows(env.checked(gappy(s, d)), env.bad_cases_points(gappy(s, d), limits(s))).select("trip_id", "vehicle_id", "timestep_time"),
    "case_summary": lambda s, d: r6(env.case_summary(gappy(s, d), limits(s))),
    "accel_envelope_lookup": lambda s, d: r6(env.accel_limits(fleet(s, d), accel_table(s)).select("vehicle_id", "timestep_time", "kmh", "accel_min", "accel_max")),
    "overwrite_merge_any": _merge("notna_any"),
    "overwrite_merge_all3": _merge("notna_all3"),
    "sg_smooth": lambda s, d: r6(smooth.smooth(profile(s, d)).select("trip_id", "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_accel")),
    "sg_odometer": lambda s, d: r6(smooth.rebuild_odometer(profile(s, d)).select("vehicle_id", "timestep_time", "vehicle_odometer")),
    "sg_jerk": lambda s, d: r6(smooth.add_jerk(profile(s, d)).select("vehicle_id", "timestep_time", "vehicle_jerk")),
    "union_methods_dedupe": _union,
    "vehicle_type_fill": _types,
    "xy_interpolate": _xy,
    "filter_points": _filtered,
    "smooth_trips": _smoothed,
    "merge_methods": _methods,
    "motion_points": _motion,
    "track_points": _tracks,
    "gt_report": _report,
    "sources_roundtrip": _written,
    "network_scan": _network,
    "optimize_stage1": lambda s, d: r6(optimize.run_stage1(regular(s, d), 2.0)),
    "optimize_stage2": lambda s, d: r6(_stage2(s, d)),
}

# ------------------------------------------------------------------ SQL


def values(rows, names: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {text}) AS x({names}))"


FCD = """fcd AS (SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS t,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE least(value, 20.0) END AS v, event_type AS lane, value AS pos, event_id FROM events)"""
SEG = FCD + """, m AS (SELECT *, coalesce(v = 0, false) AS rest FROM fcd),
m2 AS (SELECT *, CASE WHEN NOT rest AND coalesce(lag(rest) OVER (PARTITION BY vehicle_id ORDER BY t), true) THEN 1 ELSE 0 END AS st FROM m),
m3 AS (SELECT *, CASE WHEN NOT rest THEN sum(st) OVER (PARTITION BY vehicle_id ORDER BY t) END AS drive FROM m2),
bounds AS (SELECT vehicle_id, drive, min(t) - 1 AS t0, max(t) + 1 AS t1 FROM m3 WHERE drive IS NOT NULL GROUP BY ALL),
touch AS (SELECT vehicle_id, t, max(drive) AS d FROM (SELECT vehicle_id, t0 AS t, drive FROM bounds UNION ALL SELECT vehicle_id, t1, drive FROM bounds) GROUP BY ALL),
seg AS (SELECT m3.vehicle_id, m3.t, v, lane, pos, event_id, CAST(coalesce(drive, d, -1) AS BIGINT) AS segment FROM m3 LEFT JOIN touch ON m3.vehicle_id = touch.vehicle_id AND m3.t = touch.t),
trips AS (SELECT *, dense_rank() OVER (ORDER BY vehicle_id, segment) AS trip_id FROM seg)"""
KIN = """, k1 AS (SELECT *, coalesce(lead(v) OVER w - v, 0) AS acc FROM {0} WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
k2 AS (SELECT *, coalesce(lead(acc) OVER w - acc, 0) AS jerk, v + 0.5 * acc AS dist FROM k1 WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
kin AS (SELECT *, coalesce(sum(dist) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM k2)"""
BACK = """, b1 AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY vehicle_id ORDER BY t), 0) / {1} AS acc FROM {0}),
back AS (SELECT *, coalesce(acc - lag(acc) OVER (PARTITION BY vehicle_id ORDER BY t), 0) / {1} AS jerk,
  sum(v * {1} + 0.5 * acc * {1} * {1}) OVER (PARTITION BY vehicle_id ORDER BY t) AS odo FROM b1)"""
PROFILE = SEG + BACK.format("trips", "1.0")
FLEET = """fleet AS (SELECT CAST(l_suppkey AS VARCHAR) AS vehicle_id, CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t,
  CASE WHEN l_quantity <= 5 THEN 0.0 ELSE l_quantity / 3 END AS v, l_discount * 100 - 5 AS a, l_returnflag AS typ FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1),
steps AS (SELECT *, t - lag(t) OVER w AS dt, lag(v) OVER w AS v_before FROM fleet WINDOW w AS (PARTITION BY vehicle_id ORDER BY t))"""
GRAPH = f"links AS {values(LINKS, 'a, b')}, lens AS {values(LENGTHS, 'lane, len')}"
REACH = GRAPH + """, e1 AS (SELECT links.*, coalesce(len, 0) AS d FROM links LEFT JOIN lens ON a = lane), e2 AS (SELECT b AS a, a AS b, coalesce(len, 0) AS d FROM links LEFT JOIN lens ON links.a = lane),
fw AS (SELECT lane AS x, lane AS y, 0.0 AS o FROM lens UNION ALL SELECT a, b, d FROM e1 UNION ALL SELECT p.a, q.b, p.d + q.d FROM e1 p JOIN e1 q ON p.b = q.a),
bw AS (SELECT lane AS x, lane AS y, 0.0 AS o FROM lens UNION ALL SELECT a, b, d FROM e2 UNION ALL SELECT p.a, q.b, p.d + q.d FROM e2 p JOIN e2 q ON p.b = q.a),
ahead AS (SELECT x, y, min(o) AS o FROM fw GROUP BY ALL), behind AS (SELECT x, y, min(o) AS o FROM bw GROUP BY ALL)"""
NEAR = REACH + """, snap AS (SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CAST(floor(epoch(ts) / 3600) AS DOUBLE) AS t, least(value, 20.0) AS v, event_type AS lane, value AS pos FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) = 1),
ca AS (SELECT t, x AS ego, pos + o AS p, min(row(vehicle_id, pos, v, lane)) AS w FROM snap JOIN ahead ON lane = y GROUP BY t, x, pos + o),
cb AS (SELECT t, x AS ego, pos - o AS p, max(row(vehicle_id, pos, v, lane)) AS w FROM snap JOIN behind ON lane = y GROUP BY t, x, pos - o),
ja AS (SELECT s.*, c.p AS ap, struct_extract(c.w, 1) AS av, struct_extract(c.w, 2) AS apos, struct_extract(c.w, 3) AS aspeed, struct_extract(c.w, 4) AS alane FROM snap s ASOF LEFT JOIN ca c ON s.t = c.t AND s.lane = c.ego AND s.pos < c.p),
jb AS (SELECT s.vehicle_id, s.t, c.p AS bp, struct_extract(c.w, 1) AS bv, struct_extract(c.w, 2) AS bpos, struct_extract(c.w, 3) AS bspeed, struct_extract(c.w, 4) AS blane FROM snap s ASOF LEFT JOIN cb c ON s.t = c.t AND s.lane = c.ego AND s.pos > c.p),
near AS (SELECT ja.*, bp, bv, bpos, bspeed, blane, ap - pos AS ah, pos - bp AS bh FROM ja JOIN jb USING (vehicle_id, t))"""
POINTS = PROFILE + """, j AS (SELECT CAST(trip_id AS VARCHAR) AS trip_id, vehicle_id, t, acc, lead(acc) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t) - acc AS jerk FROM back WHERE event_id % 13 <> 0),
lim AS (SELECT k, -6 - abs(k) * 0.05 AS lo, 5 + abs(k) * 0.04 AS hi FROM (SELECT CAST(range - 41 AS INTEGER) AS k FROM range(83))),
all_j AS (SELECT j.*, lo, hi, coalesce(lo IS NOT NULL AND jerk >= lo AND jerk <= hi, false) AS ok, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY trip_id, vehicle_id) AS n
  FROM j LEFT JOIN lim ON CAST(round_even(acc * 10, 0) AS INTEGER) = k WINDOW w AS (PARTITION BY trip_id, vehicle_id ORDER BY t)),
pts AS (SELECT * EXCLUDE (idx, n), row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY trip_id, vehicle_id) AS n FROM all_j WHERE jerk IS NOT NULL WINDOW w AS (PARTITION BY trip_id, vehicle_id ORDER BY t)),
summary AS (SELECT c.trip_id, c.vehicle_id, CASE WHEN coalesce(p.n, 0) < 3 THEN true ELSE coalesce(p.good, false) END AS pass_in_env_mid, coalesce(p.n, 0) AS n_jerk_points, coalesce(p.n_in, 0) AS n_in_env,
  coalesce(p.n_miss, 0) AS n_missing_thr, coalesce(p.n_out, 0) AS n_out_of_range, p.lo AS jerk_min_obs, p.hi AS jerk_max_obs FROM (SELECT DISTINCT trip_id, vehicle_id FROM j) c LEFT JOIN
  (SELECT trip_id, vehicle_id, count(*) AS n, bool_and(CASE WHEN idx >= 1 AND idx <= n - 2 THEN ok END) AS good, count(*) FILTER (ok) AS n_in, count(*) FILTER (lo IS NULL) AS n_miss,
   count(*) FILTER (lo IS NOT NULL AND NOT ok) AS n_out, min(jerk) AS lo, max(jerk) AS hi FROM pts GROUP BY ALL) p USING (trip_id, vehicle_id))"""
METHODS = FCD + BACK.format("fcd", "1.0") + """, sumo AS (SELECT 'SUMO' AS data_type, vehicle_id, t, v, odo, CASE WHEN event_id % 4 = 0 THEN 'T' || CAST(event_id % 3 AS VARCHAR) END AS typ,
  CASE WHEN event_id % 10 = 0 THEN t * 2 END AS x, CASE WHEN event_id % 10 = 0 THEN t - 5 END AS y FROM back),
both_m AS (SELECT * FROM sumo UNION ALL SELECT 'RVST', vehicle_id, t, v + 0.5, odo * 1.01, NULL, NULL, NULL FROM sumo)"""
FOUR = "trip_id, vehicle_id, t AS timestep_time"


def merged_sql(mask: str) -> str:
    return f"""WITH {PROFILE}, one AS (SELECT trip_id, vehicle_id, t, event_id, CASE WHEN event_id % 11 > 0 THEN jerk END AS jerk, CASE WHEN event_id % 11 > 1 THEN acc END AS acc, CASE WHEN event_id % 11 > 1 THEN v END AS v, CASE WHEN event_id % 11 > 1 THEN odo END AS odo FROM back),
  twice AS (SELECT trip_id, vehicle_id, t, event_id, acc, v, odo FROM back WHERE event_id % 3 = 0 UNION ALL SELECT trip_id, vehicle_id, t, event_id, acc - 7, v, odo FROM back WHERE event_id % 21 = 0),
  two AS (SELECT trip_id, vehicle_id, t, CASE WHEN event_id % 2 = 0 THEN acc + 1 END AS a2, CASE WHEN event_id % 5 <> 0 THEN v + 2 END AS v2, CASE WHEN event_id % 7 <> 0 THEN odo + 3 END AS o2 FROM twice),
  j AS (SELECT b.*, a2, v2, o2, coalesce({mask}, false) AS m FROM one b LEFT JOIN two USING (trip_id, vehicle_id, t))
  SELECT CAST(trip_id AS VARCHAR) AS trip_id, vehicle_id, t AS timestep_time, round(jerk, 6) AS vehicle_jerk, round(CASE WHEN m THEN a2 ELSE acc END, 6) AS vehicle_accel, round(CASE WHEN m THEN v2 ELSE v END, 6) AS vehicle_speed,
  round(CASE WHEN m THEN o2 ELSE odo END, 6) AS vehicle_odometer, CASE WHEN m THEN 'stage2' WHEN coalesce(acc, v, odo, jerk) IS NOT NULL THEN 'stage1' ELSE 'none' END AS opt_source FROM j"""


CHOSEN = ", ".join(f"'{x}'" for x in merge.sample_vehicles([str(k) for k in range(1, 40)], 12))


def smooth_trips_sql() -> str:
    """The smoothed speeds, then odometer and jerk by vehicle."""
    inner = smooth_sql().replace("SELECT " + FOUR + ",", "SELECT trip_id, vehicle_id, t, odo, i, n,").replace("round(fin, 6) AS vehicle_speed", "fin").replace("round(CASE", "CASE").replace("/ step END, 6) AS vehicle_accel", "/ step END AS acc")
    head, _, tail = inner.rpartition("SELECT trip_id, vehicle_id, t, odo, i, n,")
    return f"""{head.rstrip()}, s7 AS (SELECT trip_id, vehicle_id, t, odo, i, n, {tail})
  SELECT {FOUR}, round(fin, 6) AS vehicle_speed, round(acc, 6) AS vehicle_accel, round(coalesce((acc - lag(acc) OVER w) / (t - lag(t) OVER w), 0), 6) AS vehicle_jerk,
  round(first_value(odo) OVER w + coalesce(sum(fin) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS vehicle_odometer FROM s7 WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)"""


def smooth_sql() -> str:
    rows = [(w, e, k, c) for w, e, cs in smooth.coefficients() for k, c in enumerate(cs)]
    return f"""WITH {PROFILE}, coef AS {values(rows, 'w, e, k, c')},
  g0 AS (SELECT CAST(trip_id AS VARCHAR) AS trip_id, vehicle_id, t, v, odo, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trip_id, vehicle_id) AS n, t - lag(t) OVER w AS dt FROM back WINDOW w AS (PARTITION BY trip_id, vehicle_id ORDER BY t)),
  g AS (SELECT *, CASE WHEN dt > 0 THEN dt ELSE coalesce(median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY trip_id, vehicle_id), 1.0) END AS step, least(11, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END) AS win FROM g0),
  h AS (SELECT *, CASE WHEN i < win // 2 THEN i WHEN i >= n - win // 2 THEN win - n + i ELSE win // 2 END AS e FROM g),
  fit AS (SELECT h.trip_id, h.vehicle_id, h.i, sum(c * s.v) AS sg FROM h JOIN coef ON coef.w = h.win AND coef.e = h.e JOIN g0 s ON s.trip_id = h.trip_id AND s.vehicle_id = h.vehicle_id AND s.i = h.i - h.e + coef.k WHERE h.n >= 5 GROUP BY ALL),
  s1 AS (SELECT h.*, least(greatest(coalesce(sg, v), 0), 16.67) AS sg FROM h LEFT JOIN fit USING (trip_id, vehicle_id, i)),
  s2 AS (SELECT *, CASE WHEN i > 0 THEN least(greatest((sg - lag(sg) OVER w) / step, -4.5), 2.5) * step ELSE 0 END AS ch FROM s1 WINDOW w AS (PARTITION BY trip_id, vehicle_id ORDER BY t)),
  s3 AS (SELECT *, least(greatest(first_value(sg) OVER w + sum(ch) OVER w, 0), 16.67) AS rec0, i = 0 OR i = n - 1 AS ends, lead(step) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t) AS nxt FROM s2 WINDOW w AS (PARTITION BY trip_id, vehicle_id ORDER BY t)),
  s4 AS (SELECT *, CASE WHEN ends AND abs(v) <= 1e-6 THEN 0 ELSE rec0 END AS rec FROM s3),
  s5 AS (SELECT *, sum(CASE WHEN NOT ends THEN rec * nxt ELSE 0 END) OVER (PARTITION BY trip_id, vehicle_id) AS inr, last_value(odo) OVER x - first_value(odo) OVER x AS tgt FROM s4 WINDOW x AS (PARTITION BY trip_id, vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  s6 AS (SELECT *, CASE WHEN n < 6 THEN least(greatest(v, 0), 16.67) WHEN NOT ends THEN least(greatest(rec * (tgt / (inr + 1e-12)), 0), 16.67) ELSE rec END AS fin FROM s5)
  SELECT {FOUR}, round(fin, 6) AS vehicle_speed, round(CASE WHEN i = 0 THEN 0 ELSE (fin - lag(fin) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t)) / step END, 6) AS vehicle_accel FROM s6"""


PLAIN = f"links AS {values(PLAIN_LINKS, 'a, b')}, lens AS {values(PLAIN_LENGTHS, 'lane, len')}"
PATHS = f"""WITH RECURSIVE {PLAIN}, p AS (SELECT [a] AS path FROM links WHERE a NOT IN (SELECT b FROM links) UNION SELECT list_append(path, b) FROM p JOIN links ON a = path[-1] WHERE NOT list_contains(path, b)),
  done AS (SELECT DISTINCT path FROM p LEFT JOIN links ON a = path[-1] WHERE b IS NULL OR list_contains(path, b)),
  numbered AS (SELECT row_number() OVER (ORDER BY path) - 1 AS path_id, path FROM done)"""

ORACLE_SQL = {
    "trip_summary": f"WITH {SEG}{KIN.format('trips')} SELECT trip_id, vehicle_id, count(*) AS n_rows, round(max(t) - min(t), 6) AS duration_s, round(sum(dist), 6) AS distance_m, round(avg(v), 6) AS mean_speed FROM kin WHERE segment > 0 GROUP BY trip_id, vehicle_id",
    "trip_split": f"WITH {SEG} SELECT vehicle_id, t AS timestep_time, segment, trip_id FROM trips",
    "kinematics_forward": f"WITH {FCD}{KIN.format('fcd')} SELECT vehicle_id, t AS timestep_time, round(acc, 6) AS vehicle_acceleration, round(jerk, 6) AS vehicle_jerk, round(dist, 6) AS distance_m, round(cum, 6) AS cumulative_distance, round(round_even((first_value(pos) OVER (PARTITION BY vehicle_id ORDER BY t) + cum) * 10000, 0) / 10000, 6) AS mileage_pos FROM kin",
    "kinematics_backward": f"WITH {FCD}{BACK.format('fcd', '0.5')} SELECT vehicle_id, t AS timestep_time, round(acc, 6) AS vehicle_accel, round(jerk, 6) AS vehicle_jerk, round(odo, 6) AS vehicle_odometer FROM back",
    "idle_trip_filter": f"WITH {SEG} SELECT vehicle_id, t AS timestep_time, trip_id FROM trips WHERE trip_id IN (SELECT trip_id FROM trips WHERE v <> 0)",
    "dt_stats": f"WITH {FLEET} SELECT min(dt) FILTER (dt > 0) AS dt_min, median(dt) FILTER (dt > 0) AS dt_median, max(dt) FILTER (dt > 0) AS dt_max, count(*) FILTER (dt <= 0) AS n_nonpos FROM steps WHERE dt IS NOT NULL",
    "unit_convert_p95": f"WITH {FLEET} SELECT round(p, 6) AS p95, false AS looks_unconverted, p < 10 AS looks_converted_twice FROM (SELECT quantile_cont(v * 6 * (1 / 3.6), 0.95) AS p FROM fleet)",
    "gt_accel_from_speed": f"WITH {FLEET} SELECT vehicle_id, t AS timestep_time, round(CASE WHEN dt IS NULL THEN 0 WHEN dt > 0 THEN (v - v_before) / dt END, 6) AS vehicle_accel FROM steps",
    "gt_speed_from_accel": f"""WITH RECURSIVE {FLEET}, o AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t) AS i FROM steps),
      r AS (SELECT vehicle_id, t, i, CAST(1.5 AS DOUBLE) AS s FROM o WHERE i = 1 UNION ALL SELECT o.vehicle_id, o.t, o.i, CASE WHEN o.dt > 0 AND o.a IS NOT NULL THEN greatest(0, r.s + o.a * o.dt) ELSE r.s END FROM r JOIN o ON o.vehicle_id = r.vehicle_id AND o.i = r.i + 1)
      SELECT vehicle_id, t AS timestep_time, round(s, 6) AS vehicle_speed FROM r""",
    "gt_odometer": f"WITH {FLEET} SELECT vehicle_id, t AS timestep_time, round(sum(CASE WHEN dt > 0 THEN v * dt ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t), 6) AS vehicle_odometer FROM steps",
    "gt_standardize": f"""WITH {FLEET}, s AS (SELECT *, v * (1 / 3.6) AS w, v_before * (1 / 3.6) AS w0 FROM steps)
      SELECT t AS timestep_time, vehicle_id, round(w, 6) AS vehicle_speed, round(CASE WHEN dt IS NULL THEN 0 WHEN dt > 0 THEN (w - w0) / dt END, 6) AS vehicle_accel, round(sum(CASE WHEN dt > 0 THEN w * dt ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t), 6) AS vehicle_odometer, typ AS vehicle_type FROM s""",
    "lane_reach": f'WITH {REACH} SELECT x AS lane_id, y AS other, round(o, 6) AS "offset", true AS ahead FROM ahead UNION ALL SELECT x, y, round(o, 6), false FROM behind',
    "lane_links_full": f"WITH {PLAIN}, l AS (SELECT a, b FROM links UNION SELECT lane, NULL FROM lens WHERE lane NOT IN (SELECT a FROM links)) SELECT a AS lane_id, b AS next_lane_id, x.len AS lane_length, y.len AS next_lane_length FROM l LEFT JOIN lens x ON x.lane = a LEFT JOIN lens y ON y.lane = b",
    "lane_degrees": f"WITH {PLAIN} SELECT node, (SELECT count(*) FROM links WHERE b = node) AS in_degree, (SELECT count(*) FROM links WHERE a = node) AS out_degree FROM (SELECT a AS node FROM links UNION SELECT b FROM links)",
    "path_enumeration": PATHS + " SELECT path_id, array_to_string(path, '>') AS path FROM numbered",
    "path_tables": PATHS + """, x AS (SELECT path_id, generate_subscripts(path, 1) AS k, unnest(path) AS lane FROM numbered),
      e AS (SELECT *, CASE WHEN lane LIKE ':%' THEN lane ELSE regexp_replace(lane, '_[^_]*$', '') END AS edge FROM x),
      b AS (SELECT *, CASE WHEN lag(edge) OVER (PARTITION BY path_id ORDER BY k) = edge THEN 0 ELSE 1 END AS st FROM e),
      c AS (SELECT *, sum(st) OVER (PARTITION BY path_id ORDER BY k) AS block FROM b),
      d AS (SELECT path_id, block, min(edge) AS edge, coalesce(sum(len), 0) AS len FROM c LEFT JOIN lens USING (lane) GROUP BY ALL),
      sig AS (SELECT path_id, list(edge ORDER BY block) AS seq FROM d GROUP BY ALL), kept AS (SELECT min(path_id) AS path_id, row_number() OVER (ORDER BY min(path_id)) - 1 AS new_id, seq FROM sig GROUP BY seq),
      o AS (SELECT kept.new_id AS path_id, edge, len, row_number() OVER w - 1 AS q, sum(len) OVER w AS cum, list_filter(seq, lambda z: z NOT LIKE ':%') AS outer_seq FROM d JOIN kept USING (path_id) WINDOW w AS (PARTITION BY d.path_id ORDER BY block)),
      flows AS (SELECT * FROM (VALUES ('a', 'f', 'f2'), ('g', 'f', 'f3')) AS f(x, y, flow_id)),
      t AS (SELECT path_id, max(cum) AS path_len, count(*) AS n, arg_min(edge, q) AS s, arg_max(edge, q) AS z FROM o GROUP BY ALL),
      el AS (SELECT DISTINCT CASE WHEN a LIKE ':%' THEN a ELSE regexp_replace(a, '_[^_]*$', '') END AS f, CASE WHEN b LIKE ':%' THEN b ELSE regexp_replace(b, '_[^_]*$', '') END AS g FROM links)
      SELECT o.path_id, q AS "EdgeLane_seq", edge AS "EdgeLane_id", round(len, 6) AS "EdgeLane_length", round(cum, 6) AS cum_length, round(coalesce(lag(cum) OVER (PARTITION BY o.path_id ORDER BY q), 0), 6) AS cum_length_prev, flow_id, round(path_len, 6) AS path_len, n AS n_edge_lanes,
      s NOT IN (SELECT g FROM el WHERE f <> g) AS is_strict_start_edge, z NOT IN (SELECT f FROM el WHERE f <> g) AS is_strict_end_edge
      FROM o JOIN t USING (path_id) LEFT JOIN flows ON outer_seq[1] = x AND outer_seq[-1] = y""",
    "neighbors_ahead": f"WITH {NEAR} SELECT vehicle_id, t AS timestep_time, av AS following_vehicle_id, round(apos, 6) AS following_flow_pos, round(aspeed, 6) AS following_vehicle_speed, alane AS following_vehicle_lane, round(ah, 6) AS following_headway_distance FROM near",
    "neighbors_behind": f"WITH {NEAR} SELECT vehicle_id, t AS timestep_time, bv AS preceding_vehicle_id, round(bpos, 6) AS preceding_flow_pos, round(bspeed, 6) AS preceding_vehicle_speed, blane AS preceding_vehicle_lane, round(bh, 6) AS preceding_headway_distance FROM near",
    "neighbors_full": f"WITH {NEAR} SELECT vehicle_id, t AS timestep_time, len AS lane_length, n.lane AS vehicle_edge, av AS following_vehicle_id, bv AS preceding_vehicle_id, round(ah, 6) AS following_headway_distance, round(bh, 6) AS preceding_headway_distance FROM near n LEFT JOIN lens ON lens.lane = n.lane",
    "safe_distance": f"WITH {NEAR} SELECT round(coalesce(least(min(ah), min(bh)), 2.0), 6) AS x_safe FROM near",
    "jerk_envelope_points": f"WITH {POINTS} SELECT {FOUR}, round(jerk, 6) AS jerk, round(lo, 6) AS jerk_min, round(hi, 6) AS jerk_max, ok AS in_envelope, idx, n FROM pts",
    "bad_cases_allrows": f"WITH {POINTS} SELECT trip_id, vehicle_id FROM all_j GROUP BY ALL HAVING count(*) >= 3 AND NOT coalesce(bool_and(CASE WHEN idx >= 1 AND idx <= n - 2 THEN ok END), false)",
    "bad_cases_points": f"WITH {POINTS} SELECT trip_id, vehicle_id FROM summary WHERE NOT pass_in_env_mid",
    "bad_case_rows": f"WITH {POINTS} SELECT {FOUR} FROM j WHERE (trip_id, vehicle_id) IN (SELECT (trip_id, vehicle_id) FROM summary WHERE NOT pass_in_env_mid)",
    "case_summary": f"WITH {POINTS} SELECT * REPLACE (round(jerk_min_obs, 6) AS jerk_min_obs, round(jerk_max_obs, 6) AS jerk_max_obs) FROM summary",
    "accel_envelope_lookup": f"WITH {FLEET} SELECT vehicle_id, t AS timestep_time, CAST(round_even(v * 3.6, 0) AS INTEGER) AS kmh, CASE WHEN round_even(v * 3.6, 0) <= 100 THEN round(-2 - round_even(v * 3.6, 0) / 100, 6) END AS accel_min, CASE WHEN round_even(v * 3.6, 0) <= 100 THEN round(3 - round_even(v * 3.6, 0) / 50, 6) END AS accel_max FROM fleet",
    "overwrite_merge_any": merged_sql("a2 IS NOT NULL OR v2 IS NOT NULL OR o2 IS NOT NULL"),
    "overwrite_merge_all3": merged_sql("a2 IS NOT NULL AND v2 IS NOT NULL AND o2 IS NOT NULL"),
    "sg_smooth": smooth_sql(),
    "sg_odometer": f"WITH {PROFILE} SELECT vehicle_id, t AS timestep_time, round(first_value(odo) OVER (PARTITION BY vehicle_id ORDER BY t) + coalesce(sum(v) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS vehicle_odometer FROM back",
    "sg_jerk": f"WITH {PROFILE} SELECT vehicle_id, t AS timestep_time, round(coalesce(acc - lag(acc) OVER (PARTITION BY vehicle_id ORDER BY t), 0), 6) AS vehicle_jerk FROM back",
    "filter_points": "WITH " + POINTS.replace("- acc AS jerk FROM", ") / 0.5 AS jerk, lead(acc) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t) AS nxt FROM").replace("lead(acc) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t) )", "(lead(acc) OVER (PARTITION BY trip_id, vehicle_id ORDER BY t) - acc)") + f""" SELECT {FOUR}, round(nxt, 6) AS accel_next, round(jerk, 6) AS jerk, round(round_even(acc * 10, 0) / 10, 6) AS accel_round, lo IS NOT NULL AS has_thr, ok AS in_env, idx, n, s.* FROM pts,
      (SELECT count(*) AS total_cases, count(*) FILTER (NOT pass_in_env_mid) AS bad_cases, count(*) FILTER (pass_in_env_mid) AS ok_cases, CAST(sum(n_jerk_points) AS BIGINT) AS jerk_points, CAST(sum(greatest(n_jerk_points - 2, 0)) AS BIGINT) AS mid_points FROM summary) s""",
    "smooth_trips": smooth_trips_sql(),
    "merge_methods": f"""WITH {SEG}{BACK.format('trips', '1.0')}, typed AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'T' || CAST(event_id % 3 AS VARCHAR) END AS typ FROM back), f AS (SELECT vehicle_id, arg_min(typ, t) AS ft FROM typed WHERE typ IS NOT NULL GROUP BY ALL),
      o0 AS (SELECT vehicle_id, t, event_id, trip_id, v + 0.5 AS v FROM trips){BACK.format('o0', '1.0').replace('b1 AS', 'c1 AS').replace('back AS', 'other AS').replace('FROM b1', 'FROM c1')}
      SELECT 'SUMO' AS data_type, vehicle_id, t AS timestep_time, round(v, 6) AS vehicle_speed, round(acc, 6) AS vehicle_accel, round(jerk, 6) AS vehicle_jerk, round(odo, 6) AS vehicle_odometer, typ AS vehicle_type, CAST(trip_id AS VARCHAR) AS trip_id FROM typed
      UNION ALL SELECT 'RVST', vehicle_id, t, round(v, 6), round(acc, 6), round(jerk, 6), round(odo, 6), ft, CAST(trip_id AS VARCHAR) FROM other LEFT JOIN f USING (vehicle_id)""",
    "motion_points": f"""WITH {METHODS}, m AS (SELECT *, coalesce(v - lag(v) OVER w, 0) / 0.5 AS a FROM both_m WHERE vehicle_id IN ({CHOSEN}) WINDOW w AS (PARTITION BY data_type, vehicle_id ORDER BY t))
      SELECT vehicle_id, data_type, t AS timestep_time, round(v * 3.6, 6) AS vehicle_speed_plot, round(a, 6) AS vehicle_accel, round(coalesce(a - lag(a) OVER (PARTITION BY data_type, vehicle_id ORDER BY t), 0) / 0.5, 6) AS vehicle_jerk FROM m""",
    "track_points": f"WITH {METHODS} SELECT vehicle_id, data_type, t AS timestep_time, round(x, 6) AS vehicle_x, round(y, 6) AS vehicle_y FROM both_m WHERE vehicle_id IN ({CHOSEN})",
    "gt_report": f"""WITH {FLEET}, o AS (SELECT sum(CASE WHEN dt > 0 THEN v * dt ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t) AS odo FROM steps)
      SELECT min(dt) FILTER (dt > 0) AS dt_min, median(dt) FILTER (dt > 0) AS dt_median, max(dt) FILTER (dt > 0) AS dt_max, count(*) FILTER (dt <= 0) AS n_nonpos, count(*) AS rows_out, count(DISTINCT vehicle_id) AS n_vehicles, count(*) AS rows_in,
      'knots' AS speed_unit_in, 'm/s' AS speed_unit_out, false AS speed_converted, 'speed' AS prefer, 0.0 AS initial_speed, 'vehicle_accel,vehicle_odometer,vehicle_jerk' AS derived_cols, 3 AS n_warnings, 'vel' AS speed_from, 'mileage' AS odometer_from,
      (SELECT round(sum(odo), 6) FROM o) AS odometers, count(*) AS unknown_types FROM steps""",
    "sources_roundtrip": f"WITH {FCD} SELECT vehicle_id, t AS timestep_time, round(v, 6) AS vehicle_speed, lane AS vehicle_lane FROM fcd",
    "network_scan": """SELECT * FROM (VALUES ('link', 'a_0', ':j_0', NULL), ('link', ':j_0', 'b_0', NULL), ('link', 'b_0', 'c_0', NULL), ('lane', 'a_0', NULL, 10.5::DOUBLE), ('lane', ':j_0', NULL, NULL), ('lane', 'b_0', NULL, 20.0),
      ('outer', 'a_0', NULL, 10.5), ('outer', 'b_0', NULL, 20.0), ('flow', 'a>c', 'f3', NULL), ('flow', 'b>c', 'f4', NULL)) AS t(kind, a, b, x)""",
    "union_methods_dedupe": f"WITH {METHODS} SELECT data_type, vehicle_id, t AS timestep_time, round(v, 6) AS vehicle_speed, round(odo, 6) AS vehicle_odometer FROM both_m",
    "vehicle_type_fill": f"WITH {METHODS}, f AS (SELECT vehicle_id, arg_min(typ, t) AS ft FROM sumo WHERE typ IS NOT NULL GROUP BY ALL) SELECT data_type, vehicle_id, t AS timestep_time, coalesce(typ, ft) AS vehicle_type FROM both_m LEFT JOIN f USING (vehicle_id)",
    "xy_interpolate": f"""WITH {METHODS}, kn AS (SELECT vehicle_id, odo AS o, min(row(x, y)) AS p FROM sumo WHERE x IS NOT NULL GROUP BY ALL), k2 AS (SELECT vehicle_id, o, struct_extract(p, 1) AS x, struct_extract(p, 2) AS y FROM kn),
      sg AS (SELECT vehicle_id, CASE WHEN lag(o) OVER w IS NULL THEN -1e300 ELSE o END AS at_o, o, x AS x1, y AS y1, lead(o) OVER w AS o2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM k2 WINDOW w AS (PARTITION BY vehicle_id ORDER BY o)),
      sg2 AS (SELECT * FROM sg WHERE o2 IS NOT NULL), j AS (SELECT m.*, s.o, s.x1, s.y1, s.o2, s.x2, s.y2 FROM both_m m ASOF LEFT JOIN sg2 s ON m.vehicle_id = s.vehicle_id AND m.odo >= s.at_o)
      SELECT data_type, vehicle_id, t AS timestep_time, round(CASE WHEN o IS NOT NULL THEN x1 + (odo - o) / (o2 - o) * (x2 - x1) ELSE x END, 6) AS vehicle_x, round(CASE WHEN o IS NOT NULL THEN y1 + (odo - o) / (o2 - o) * (y2 - y1) ELSE y END, 6) AS vehicle_y FROM j""",
}
