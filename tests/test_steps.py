"""The command line's steps on small files."""

import json

from waymark.__main__ import main


def folder(path, text):
    path.write_text(text)
    return str(path)


def test_steps_read_run_and_write(spark, tmp_path):
    out = str(tmp_path / "out")
    net = folder(tmp_path / "net.xml", '<net><lane id="a_0" length="10"/><lane id="b_0" length="20"/><connection from="a" to="b" fromLane="0" toLane="0"/></net>')
    made = main(["network", net, out], spark)
    assert [p.rsplit("/", 1)[1] for p in made] == ["paths.csv", "paths_long.csv", "lane_links_full.csv", "lane_lengths.csv"]
    rows = "".join(f"{t}.0,v{k},a_0,{5 + (t % 2)},{k * 9 + 5 * t}\n" for t in range(8) for k in range(2))
    fcd = folder(tmp_path / "fcd.csv", "﻿timestep_time,vehicle_id,vehicle_lane,vehicle_speed,vehicle_pos\n" + rows)
    (near,) = main(["neighbors", fcd, out, "--links", f"{out}/lane_links_full.csv", "--lengths", f"{out}/lane_lengths.csv", "--format", "parquet"], spark)
    first = spark.read.parquet(near).where("vehicle_id = 'v0' and timestep_time = 0").first()
    assert (first.following_vehicle_id, first.following_headway_distance, first.lane_length) == ("v1", 9.0, 10.0)
    (split,) = main(["trips", fcd, out, "--format", "parquet"], spark)
    assert {r.trip_id for r in spark.read.parquet(split).collect()} == {1, 2}
    std = main(["ground-truth", fcd, out, "--unit", "kmh", "--format", "parquet"], spark)
    assert spark.read.parquet(std[0]).count() == 16 and spark.read.json(std[1]).first().speed_converted
    trips = "".join(f"{t},v,1,{10 + 0.1 * min(t, 7)},{10 * t + (0.05 * t * t if t < 8 else 0.7 * t - 2.45)}\n" for t in range(9))
    opt = folder(tmp_path / "trips.csv", "timestep_time,vehicle_id,trip_id,vehicle_speed,vehicle_odometer\n" + trips)
    limits = folder(tmp_path / "jerk_envelope.csv", "accel_round,q1,q99,q1_smooth,q99_smooth\n" + "".join(f"{k / 10},0,0,-0.05,0.05\n" for k in range(-41, 42)))
    stages = main(["optimize", opt, out, "--envelope", limits, "--format", "parquet"], spark)
    assert {r.s1_status for r in spark.read.parquet(stages[0]).collect()} == {"optimal"} and spark.read.parquet(stages[2]).count() == 9
    one = spark.read.parquet(stages[0]).drop("s1_status")
    one.coalesce(1).write.option("header", True).csv(f"{out}/one")
    tables = main(["filter", f"{out}/one", out, "--envelope", limits], spark)
    assert len(tables) == 6 and all("/15_badcase/" in p for p in tables)
    both = main(["merge", f"{out}/one", out, "--stage2", f"{out}/one", "--format", "parquet"], spark)
    assert both == [f"{out}/99_merge/FCD_rvst_all.parquet"] and {r.opt_source for r in spark.read.parquet(both[0]).collect()} == {"stage2"}
    (smooth,) = main(["smooth", opt, out, "--format", "parquet"], spark)
    assert spark.read.parquet(smooth).columns[-1] == "vehicle_odometer"
    base = folder(tmp_path / "base.csv", "timestep_time,vehicle_id,trip_id,vehicle_speed,coord_x,coord_y,vehicle_type\n" + "".join(f"{t},v,1,10,{t},{2 * t},car\n" for t in range(5)))
    merged = main(["methods", base, out, "--method", f"RVST={opt}", "--figures", "3", "--format", "parquet"], spark)
    assert len(merged) == 3 and {r.data_type for r in spark.read.parquet(merged[0]).collect()} == {"SUMO", "RVST"}
    assert json.loads(json.dumps(merged)) == merged
