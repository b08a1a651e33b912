"""Lane graph: links, lengths, degrees, reach and simple paths."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import first_outer_edge, is_internal, lane_to_edge, last_outer_edge


def best_flows(flows: DataFrame) -> DataFrame:
    """The flow with the most vehicles an hour for each pair of edges; the first id among equals."""
    w = Window.partitionBy("from_edge", "to_edge").orderBy(F.desc_nulls_last("vehs_per_hour"), "flow_id")
    return flows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("from_edge", "to_edge", "flow_id")


def with_sinks(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links and, for lanes that nothing leaves, a row with a null next lane."""
    unused = lengths.join(links, "lane_id", "left_anti").select("lane_id", F.lit(None).cast("string").alias("next_lane_id"))
    return links.select("lane_id", "next_lane_id").unionByName(unused).distinct()


def lane_links_full(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links with the lengths of both lanes."""
    ahead = lengths.select(F.col("lane_id").alias("next_lane_id"), F.col("length").alias("next_lane_length"))
    full = with_sinks(links, lengths).join(lengths.withColumnRenamed("length", "lane_length"), "lane_id", "left").join(ahead, "next_lane_id", "left")
    return full.select("lane_id", "next_lane_id", "lane_length", "next_lane_length").orderBy(F.asc_nulls_last("lane_id"), F.asc_nulls_last("next_lane_id"))


def lane_lengths(lengths: DataFrame) -> DataFrame:
    """One row a lane, in order; of several lengths the least counts."""
    return lengths.groupBy("lane_id").agg(F.min("length").alias("length")).orderBy("lane_id")


def degrees(links: DataFrame) -> DataFrame:
    real = links.where("next_lane_id is not null")
    nodes = links.select(F.col("lane_id").alias("node")).unionByName(real.select(F.col("next_lane_id").alias("node"))).distinct()
    out, into = real.groupBy(F.col("lane_id").alias("node")).agg(F.count(F.lit(1)).alias("o")), real.groupBy(F.col("next_lane_id").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def reach(links: DataFrame, lengths: DataFrame, hop: int = 2, forward: bool = True) -> DataFrame:
    """(lane, other, offset): the least distance from a lane's start to the start of lanes up to `hop` links ahead (or behind); itself at 0.

    A lane without a length counts 0; a null length makes what lies beyond unreachable.
    """
    real = links.where("next_lane_id is not null").select(F.col("lane_id").alias("a"), F.col("next_lane_id").alias("b")).distinct()
    size = lengths.groupBy("lane_id").agg(F.first("length").alias("length"), F.lit(True).alias("known"))
    edges = real if forward else real.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # The lane that is crossed: the one left when looking ahead, the one entered when looking behind.
    crossed = size.withColumnRenamed("lane_id", "a" if forward else "b")
    steps = edges.join(crossed, "a" if forward else "b", "left").select("a", "b", F.when(F.col("known"), F.col("length")).otherwise(0.0).alias("d")).where("d is not null")
    nodes = real.select("a").unionByName(real.select(F.col("b").alias("a"))).unionByName(lengths.select(F.col("lane_id").alias("a"))).distinct()
    now = nodes.select(F.col("a").alias("lane_id"), F.col("a").alias("other"), F.lit(0.0).alias("offset"))
    found = now
    for _ in range(hop):
        now = now.join(steps, now["other"] == steps["a"]).select("lane_id", F.col("b").alias("other"), (F.col("offset") + F.col("d")).alias("offset"))
        found = found.unionByName(now)
    return found.groupBy("lane_id", "other").agg(F.min("offset").alias("offset"))


class TooManyPaths(RuntimeError):
    """More path prefixes than max_steps."""


def simple_paths(links: DataFrame, max_steps: int = 100_000, on_limit: str = "raise") -> DataFrame:
    """Simple paths from lanes that nothing enters: to a sink, or to where the next lane is already on the path. Distinct, with
    path_id by lexicographic order. Without such a lane those that aren't one in, one out start, else all do.

    max_steps bounds the prefixes looked at. Beyond it the call fails, or with on_limit="cut" gives the paths closed so far and
    warns that they aren't all.
    """
    spark = links.sparkSession
    real = links.where("next_lane_id is not null").select(F.col("lane_id").alias("a"), F.col("next_lane_id").alias("b")).distinct()
    d = degrees(links)
    starts = d.where("in_degree = 0")
    if starts.isEmpty():
        starts = d.where("not (in_degree = 1 and out_degree = 1)")
    if starts.isEmpty():
        starts = d
    now, done, seen = starts.select(F.array("node").alias("path")), None, 0
    while True:
        grown = now.join(real, F.element_at("path", -1) == real["a"], "left")
        closed = grown.where("b is null or array_contains(path, b)").select("path").distinct()
        done = closed if done is None else done.unionByName(closed)
        now = grown.where("b is not null and not array_contains(path, b)").select(F.concat("path", F.array("b")).alias("path"))
        if spark.conf.get("spark.checkpoint.dir", None):
            if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
                spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
            now = now.checkpoint()
        n = now.count()
        seen += n
        if seen > max_steps:
            if on_limit != "cut":
                raise TooManyPaths(f"more than {max_steps} path prefixes")
            warnings.warn(f"paths are cut off after {max_steps} prefixes", stacklevel=2)
            break
        if not n:
            break
    return done.distinct().select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("path_id"), "path")  # max_steps rows at most


def edge_links(links: DataFrame) -> DataFrame:
    """Distinct links between edges, those within one left out."""
    pairs = links.where("next_lane_id is not null").select(lane_to_edge(F.col("lane_id")).alias("edge_id"), lane_to_edge(F.col("next_lane_id")).alias("next_edge_id"))
    return pairs.where("edge_id <> next_edge_id").distinct()


def path_tables(paths: DataFrame, lengths: DataFrame, links: DataFrame, flows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row for each path, one for each edge of a path): runs of lanes on the same edge become one, equal paths one.

    path_id counts the distinct paths from 0 in the order of the paths given, EdgeLane_seq a path's edges from 0. An end is strict
    where no link between edges enters the first edge or leaves the last; an edge without links is.
    """
    lanes = paths.select("path_id", F.posexplode("path").alias("pos", "lane_id"))
    lanes = lanes.join(lengths.groupBy("lane_id").agg(F.first("length").alias("length")), "lane_id", "left").withColumn("edge", lane_to_edge(F.col("lane_id")))
    w = Window.partitionBy("path_id").orderBy("pos")
    lanes = lanes.withColumn("block", F.sum(F.coalesce((F.lag("edge").over(w) != F.col("edge")).cast("int"), F.lit(1))).over(w))
    edges = lanes.groupBy("path_id", "block").agg(F.first("edge").alias("EdgeLane_id"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("EdgeLane_length"))
    signature = edges.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "EdgeLane_id"))), lambda x: x["EdgeLane_id"]).alias("edge_seq"))
    kept = signature.groupBy("edge_seq").agg(F.min("path_id").alias("path_id"))
    kept = kept.withColumn("new_id", (F.row_number().over(Window.orderBy("path_id")) - 1).cast("long"))  # as many rows as simple_paths allows
    order = Window.partitionBy("path_id").orderBy("block")
    long = edges.join(kept, "path_id").withColumn("path_id", F.col("new_id")).drop("new_id").withColumn("EdgeLane_seq", (F.row_number().over(order) - 1).cast("long"))
    long = long.withColumn("cum_length", F.sum("EdgeLane_length").over(order)).withColumn("cum_length_prev", F.coalesce(F.lag("cum_length").over(order), F.lit(0.0)))
    long = long.withColumn("from_edge", first_outer_edge(F.col("edge_seq"))).withColumn("to_edge", last_outer_edge(F.col("edge_seq")))
    long = long.join(best_flows(flows), ["from_edge", "to_edge"], "left") if flows is not None else long.withColumn("flow_id", F.lit(None).cast("string"))
    table = long.groupBy("path_id").agg(F.max("cum_length").alias("path_len"), F.count(F.lit(1)).alias("n_edge_lanes"), F.min_by("EdgeLane_id", "EdgeLane_seq").alias("start_edge_lane"), F.max_by("EdgeLane_id", "EdgeLane_seq").alias("end_edge_lane"))
    real = edge_links(links)
    entered = real.select(F.col("next_edge_id").alias("start_edge_lane"), F.lit(False).alias("is_strict_start_edge")).distinct()
    left = real.select(F.col("edge_id").alias("end_edge_lane"), F.lit(False).alias("is_strict_end_edge")).distinct()
    table = table.join(entered, "start_edge_lane", "left").join(left, "end_edge_lane", "left")
    flags = {c: F.coalesce(c, F.lit(True)) for c in ("is_strict_start_edge", "is_strict_end_edge")}
    return table.withColumns(flags).select("path_id", "path_len", "n_edge_lanes", "start_edge_lane", "end_edge_lane", *flags), long.drop("edge_seq")


def topology_tables(links: DataFrame, lengths: DataFrame, flows: DataFrame | None = None, max_steps: int = 100_000) -> dict[str, DataFrame]:
    """The four tables of a network: paths, paths_long, lane_links_full and lane_lengths."""
    table, long = path_tables(simple_paths(links, max_steps), lengths, links, flows)
    return {"paths": table, "paths_long": long, "lane_links_full": lane_links_full(links, lengths), "lane_lengths": lane_lengths(lengths)}


def outer_links(links: DataFrame) -> DataFrame:
    """Links between lanes that aren't internal."""
    return links.where(~is_internal(F.col("lane_id")) & ~is_internal(F.col("next_lane_id")))
