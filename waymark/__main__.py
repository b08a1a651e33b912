"""python -m waymark STEP ...: each step reads CSV or XML files, runs an operator and writes its tables below an output folder."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.columns import number, require_columns, safe_file_name
from waymark.operators import envelope, merge, neighbors, optimize, smooth, standardize, topology, trips
from waymark.session import ship
from waymark.sources import network

log = logging.getLogger("waymark")
NUMBERS = ("timestep_time", "vehicle_speed", "vehicle_pos", "vehicle_odometer", "vehicle_accel", "vehicle_jerk", "vehicle_x", "vehicle_y", "length", "lane_length", "preceding_headway_distance", "following_headway_distance")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of traces, its known columns as numbers."""
    df = network.csv(spark, path)
    return df.withColumns({c: number(c) for c in NUMBERS if c in df.columns})


def written(df: DataFrame, folder: str, name: str, out_format: str = "csv") -> str:
    path = network.write_table(df, f"{folder.rstrip('/')}/{safe_file_name(name)}", out_format)
    log.info("wrote %s", path)
    return path


def convert(spark: SparkSession, a) -> list[str]:
    return network.convert_fcd(spark, a.input, a.out, not a.no_csv, a.parquet, a.prefix)


def net(spark: SparkSession, a) -> list[str]:
    inside = not a.no_internal
    links, lengths, flows = network.connections_xml(spark, a.input, inside), network.lanes_xml(spark, a.input, inside), network.flows_xml(spark, a.routes)
    return [written(t, a.out, name, a.format) for name, t in topology.topology_tables(topology.with_sinks(links, lengths), lengths, flows, a.max_steps).items()]


def near(spark: SparkSession, a) -> list[str]:
    rows = traces(spark, a.input)
    require_columns(rows, ["timestep_time", "vehicle_id", "vehicle_lane", "vehicle_speed", "vehicle_pos"])
    made = neighbors.neighbors(rows, traces(spark, a.links), traces(spark, a.lengths), a.hop, not a.no_lane_length)
    return [written(made, a.out, f"{a.prefix}_neighbors", a.format)]


def split(spark: SparkSession, a) -> list[str]:
    rows = traces(spark, a.input)
    require_columns(rows, ["vehicle_id", "timestep_time", "vehicle_speed"])
    made = trips.kinematics_forward(trips.split_trips(rows), pos="vehicle_pos" if "vehicle_pos" in rows.columns else None)
    return [written(made, a.out, f"{a.prefix}_trip_split", a.format)]


def ground_truth(spark: SparkSession, a) -> list[str]:
    made, report = standardize.standardize(network.csv(spark, a.input), a.unit, a.prefer, a.initial_speed, not a.no_clip, a.keep_jerk)
    folder = network.output_folder(a.out, "ground_truth")
    network.write_report(report, f"{folder}/report")
    return [written(made, folder, "ground_truth_std", a.format), f"{folder}/report"]


def smoothed(spark: SparkSession, a) -> list[str]:
    return [written(smooth.smooth_trips(traces(spark, a.input)), a.out, f"{a.prefix}_smooth", a.format)]


def optimized(spark: SparkSession, a) -> list[str]:
    rows = traces(spark, a.input)
    require_columns(rows, ["trip_id", "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_odometer"])
    one, two = optimize.run_all(rows, network.envelope_csv(spark, str(network.resource("jerk_envelope.csv", a.envelope)), "last"))
    both = merge.overwrite_merge(one, two)
    return [written(df, a.out, f"{a.prefix}_{name}", a.format) for name, df in (("stage1", one), ("stage2", two), ("all", both))]


def filtered(spark: SparkSession, a) -> list[str]:
    limits = network.envelope_csv(spark, str(network.resource("jerk_envelope.csv", a.envelope)), "widest", a.decimals)
    made = envelope.filter_cases(traces(spark, a.input), limits, a.dt if a.use_dt else None, a.decimals, not a.no_points)
    folder = network.output_folder(a.out, "badcase")
    stats = {k: v for k, v in made["stats"].first().asDict().items()}
    log.info("%s", network.snapshot({k: v for k, v in vars(a).items() if k != "run"}, stats))
    return [written(df, folder, f"{a.prefix}_{name}", a.format) for name, df in made.items()]


def merged(spark: SparkSession, a) -> list[str]:
    made = merge.overwrite_merge(traces(spark, a.input), traces(spark, a.stage2), policy=a.policy)
    return [written(made, network.output_folder(a.out, "merge"), f"{a.prefix}_{a.name}", a.format)]


def methods(spark: SparkSession, a) -> list[str]:
    named = dict(x.split("=", 1) for x in a.method)
    made = merge.merge_methods(network.csv(spark, a.input), {k: network.csv(spark, v) for k, v in named.items()}, a.dt, keep_trip_and_jerk=a.keep_trip_and_jerk)
    out = [written(made, a.out, "merged", a.format)]
    if a.figures:
        ids = merge.sample_vehicles([r[0] for r in made.select(F.col("vehicle_id")).distinct().collect()], a.figures, a.seed)  # one id a vehicle
        out += [written(merge.track_points(made, ids), a.out, "xy_tracks", a.format), written(merge.motion_points(made, ids, a.dt, a.unit), a.out, "speed_accel_jerk", a.format)]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("waymark", description=__doc__)
    sub = p.add_subparsers(dest="step", required=True)

    def step(name: str, run, *options: tuple[str, dict]) -> None:
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("out")
        s.add_argument("--prefix", default="FCD")
        s.add_argument("--format", choices=["csv", "parquet"], default="csv")
        for flag, more in options:
            s.add_argument(flag, **more)
        s.set_defaults(run=run)

    yes = {"action": "store_true"}
    step("convert", convert, ("--no-csv", yes), ("--parquet", yes))
    step("network", net, ("--routes", {"default": None}), ("--no-internal", yes), ("--max-steps", {"type": int, "default": 100_000}))
    step("neighbors", near, ("--links", {"required": True}), ("--lengths", {"required": True}), ("--hop", {"type": int, "choices": [0, 1, 2], "default": 2}), ("--no-lane-length", yes))
    step("trips", split)
    step("ground-truth", ground_truth, ("--unit", {"default": "m/s"}), ("--prefer", {"choices": ["speed", "accel"], "default": "speed"}), ("--initial-speed", {"type": float, "default": 0.0}), ("--no-clip", yes), ("--keep-jerk", yes))
    step("smooth", smoothed)
    step("optimize", optimized, ("--envelope", {"default": None}))
    step("filter", filtered, ("--envelope", {"default": None}), ("--decimals", {"type": int, "default": 1}), ("--use-dt", yes), ("--dt", {"type": float, "default": 1.0}), ("--no-points", yes))
    step("merge", merged, ("--stage2", {"required": True}), ("--policy", {"choices": ["notna_any", "notna_all3"], "default": "notna_any"}), ("--name", {"default": "rvst_all"}))
    step("methods", methods, ("--method", {"action": "append", "default": [], "metavar": "NAME=FILE"}), ("--dt", {"type": float, "default": 1.0}), ("--keep-trip-and-jerk", yes), ("--figures", {"type": int, "default": 0}), ("--seed", {"type": int, "default": 42}), ("--unit", {"default": "m/s"}))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """What was written."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)s | %(message)s")
    a = parser().parse_args(arguments)
    if getattr(a, "dt", 1.0) <= 0:
        raise ValueError("--dt must be above 0")
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    made = a.run(spark, a)
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
