"""Who is ahead and who is behind: a strict as-of join across connected lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import lane_to_edge, renamed
from waymark.operators.topology import reach

SIDES = {"following": True, "preceding": False}  # the names that the data's users know: following_ is the one ahead
PLACED = "vehicle_lane is not null and vehicle_pos is not null"


def lane_table(lengths: DataFrame) -> DataFrame:
    """lane_id and length of a table that may name them vehicle_lane and lane_length."""
    return renamed(lengths, {"vehicle_lane": "lane_id", "lane_length": "length"})


def neighbors(fcd: DataFrame, links: DataFrame, lengths: DataFrame, hop: int = 2, merge_lane_length: bool = True) -> DataFrame:
    """fcd with lane length, edge and both neighbours: the nearest vehicle strictly ahead (behind) on reachable lanes at the same time.

    Of rows of a vehicle at the same time the first by lane and place counts. Every row is a candidate on its own lane and, by
    the reach table, which is as large as the lane graph, on the lanes it can be seen from. One exchange by time and lane
    brings candidates and rows together; candidates at one place collapse to one (the least id ahead, the greatest behind), and
    running last values over distinct places find the nearest on both sides, so no pairs are formed and nothing is joined back.
    """
    lengths = lane_table(lengths)
    w = Window.partitionBy("vehicle_id", "timestep_time").orderBy("vehicle_lane", "vehicle_pos", "vehicle_speed")
    base = fcd.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    who = F.struct("vehicle_id", F.col("vehicle_pos").alias("flow_pos"), "vehicle_speed", "vehicle_lane")
    nobody = F.lit(None).cast(base.select(who.alias("w")).schema["w"].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    nothing = F.lit(None).cast(base.select(row.alias("r")).schema["r"].dataType)
    placed = base.where(PLACED)
    seen = placed.select("timestep_time", F.col("vehicle_lane").alias("ego_lane"), F.col("vehicle_pos").alias("p"), who.alias("ahead"), who.alias("behind"), row.alias("ego"))
    for side, ahead in SIDES.items():
        lanes = reach(links, lengths, hop, ahead).where("lane_id <> other").select(F.col("lane_id").alias("ego_lane"), F.col("other").alias("vehicle_lane"), "offset")
        there = placed.join(lanes, "vehicle_lane")
        p = F.col("vehicle_pos") + F.col("offset") if ahead else F.col("vehicle_pos") - F.col("offset")
        seen = seen.unionByName(there.select("timestep_time", "ego_lane", p.alias("p"), (who if ahead else nobody).alias("ahead"), (nobody if ahead else who).alias("behind"), nothing.alias("ego")))
    met = seen.repartition("timestep_time", "ego_lane").groupBy("timestep_time", "ego_lane", "p").agg(F.min("ahead").alias("ahead"), F.max("behind").alias("behind"), F.collect_list("ego").alias("egos"))
    for side, ahead in SIDES.items():
        own = "ahead" if ahead else "behind"
        w = Window.partitionBy("timestep_time", "ego_lane").orderBy(F.desc("p") if ahead else F.asc("p")).rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn(side, F.last(F.when(F.col(own).isNotNull(), F.struct(F.col(own).alias("who"), "p")), ignorenulls=True).over(w))
    found = met.where(F.size("egos") > 0).select("p", *SIDES, F.explode("egos").alias("ego"))
    columns = {f"{side}_{c}": F.col(f"{side}.who.{c}") for side in SIDES for c in ("vehicle_id", "flow_pos", "vehicle_speed", "vehicle_lane")}
    columns |= {f"{side}_headway_distance": (F.col(f"{side}.p") - F.col("p")) * (1 if ahead else -1) for side, ahead in SIDES.items()}
    found = found.select("ego.*", *[c.alias(name) for name, c in columns.items()])
    out = found.unionByName(base.where(f"not ({PLACED})"), allowMissingColumns=True)
    if merge_lane_length:
        size = lengths.groupBy("lane_id").agg(F.first("length").alias("lane_length")).withColumnRenamed("lane_id", "vehicle_lane")
        out = out.join(size, "vehicle_lane", "left")
    return out if "vehicle_edge" in fcd.columns else out.withColumn("vehicle_edge", lane_to_edge(F.col("vehicle_lane")))
