"""Hand-made cases of the trajectory operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.columns import ALIASES, half_even, lane_to_edge, resolve_columns, safe_file_name, to_mps
from waymark.operators import envelope, merge, neighbors, optimize, qp, smooth, standardize, topology, trips
from waymark.sources import network


def trace(spark, speeds, vehicle="a"):
    return spark.createDataFrame([(vehicle, float(t), v, 0.0) for t, v in enumerate(speeds)], "vehicle_id string, timestep_time double, vehicle_speed double, vehicle_pos double")


def test_single_stop_goes_to_the_later_trip(spark):
    out = trips.segments(trace(spark, [0.0, 0.0, 3.0, 4.0, 0.0, 5.0, 0.0, 0.0])).orderBy("timestep_time").collect()
    assert [r.segment for r in out] == [-1, 1, 1, 1, 2, 2, 2, -1]


def test_all_rest_and_missing_speed(spark):
    both = trace(spark, [0.0, 0.0], "z").unionByName(trace(spark, [0.0, None, 0.0], "m"))
    out = {(r.vehicle_id, r.timestep_time): r.segment for r in trips.segments(both).collect()}
    assert [out["z", t] for t in (0.0, 1.0)] == [-1, -1] and [out["m", t] for t in (0.0, 1.0, 2.0)] == [1, 1, 1]


def test_half_even_and_edges(spark):
    r = spark.range(1).select(half_even(F.lit(0.25), 1).alias("a"), half_even(F.lit(0.35), 1).alias("b"), lane_to_edge(F.lit("x_y_0")).alias("c"), lane_to_edge(F.lit(":j_0")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (0.2, 0.4, "x_y", ":j_0")


def test_aliases(spark):
    df, used, warnings = resolve_columns(spark.createDataFrame([(1.0, "v", "3", 1.0, 2.0, 7.0)], "Time double, `veh id` string, v string, pos_x double, pos_y double, S double"))
    r = df.first()
    assert (r.timestep_time, r.vehicle_id, r.vehicle_speed, r.vehicle_x, r.vehicle_odometer, r.vehicle_type) == (1.0, "v", 3.0, 1.0, 7.0, None) and used["vehicle_accel"] is None and used["vehicle_odometer"] == "S"
    # Every name of the lists, alone; the first of two; a pair before singles, and single names without a pair.
    for standard, names in ALIASES.items():
        for name in names:
            assert resolve_columns(spark.createDataFrame([("1",)], f"`{name}` string"))[1][standard] == name
    assert resolve_columns(spark.createDataFrame([(1.0, 2.0)], "acceleration double, accel double"))[1]["vehicle_accel"] == "accel"
    assert resolve_columns(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, coord_x double"))[1]["vehicle_x"] == "x"
    assert resolve_columns(spark.createDataFrame([(1.0, 2.0)], "pos_x double, coord_x double"))[1]["vehicle_x"] == "pos_x"


def test_units_and_file_names(spark):
    for unit, factor in (("kmh", 1 / 3.6), ("KPH", 1 / 3.6), ("km/h", 1 / 3.6), ("mps", 1.0), ("m_s", 1.0), ("ms", 1.0), ("mph", 0.44704), ("furlongs", 1.0)):
        assert abs(spark.range(1).select(to_mps(F.lit(36.0), unit)).first()[0] - 36 * factor) < 1e-12
    assert (safe_file_name("a/b:c.d"), safe_file_name("a/b.c", dots=True), safe_file_name(" a / b. ", collapse=True)) == ("a_b_c.d", "a_b_c", "a_b")


def test_ingest_looks_at_values(spark):
    rows = [(0.0, "a", 1.0, None, None, None), (1.0, "a", float("inf"), None, None, None), (2.0, "a", 3.0, None, None, None), (None, "a", 3.0, None, None, None), (3.0, None, 3.0, None, None, None)]
    df = spark.createDataFrame(rows, "t double, id string, v double, s double, type string, j double")
    out, report = standardize.standardize(df, "km/h")
    got = [(r.vehicle_accel, r.vehicle_odometer, r.vehicle_type) for r in out.orderBy("timestep_time").collect()]
    assert got[0] == (0.0, 0.0, "unknown") and got[1][:2] == (None, 0.0) and got[2][0] is None and abs(got[2][1] - 3 / 3.6) < 1e-12
    r = report.first()
    assert (r.rows_in, r.rows_out, r.n_vehicles, r.speed_converted) == (5, 3, 1, True) and list(r.derived_cols) == ["vehicle_accel", "vehicle_odometer", "vehicle_jerk"]
    with pytest.raises(ValueError):
        standardize.standardize(df.withColumn("v", F.lit(None).cast("double")))


def test_speed_recursion(spark):
    rng = np.random.default_rng(3)
    acc = rng.normal(0, 2, 60)
    df = spark.createDataFrame([("a", float(t), float(x)) for t, x in enumerate(acc)], "vehicle_id string, timestep_time double, vehicle_accel double")
    got = [r.vehicle_speed for r in standardize.integrate_speed(df, 1.0).orderBy("timestep_time").collect()]
    v, want = 1.0, [1.0]
    for x in acc[1:]:
        v = max(0.0, v + x)
        want.append(v)
    assert np.allclose(got, want)


def test_neighbours_are_strict(spark):
    fcd = spark.createDataFrame([("a", 0.0, "l", 1.0, 5.0), ("b", 0.0, "l", 1.0, 5.0), ("c", 0.0, "l", 1.0, 9.0), ("d", 0.0, "m", 1.0, 1.0), ("e", 0.0, None, 1.0, 1.0)], "vehicle_id string, timestep_time double, vehicle_lane string, vehicle_speed double, vehicle_pos double")
    links, lengths = spark.createDataFrame([("l", "m"), ("m", None)], "lane_id string, next_lane_id string"), spark.createDataFrame([("l", 10.0)], "lane_id string, length double")
    out = {r.vehicle_id: r for r in neighbors.neighbors(fcd, links, lengths).collect()}
    assert (out["a"].following_vehicle_id, out["a"].preceding_vehicle_id) == ("c", None)
    assert (out["c"].following_vehicle_id, out["c"].following_headway_distance, out["c"].preceding_vehicle_id) == ("d", 2.0, "b")
    assert out["e"].following_vehicle_id is None and out["d"].preceding_vehicle_id == "c"


def test_neighbours_on_a_lane_that_the_graph_lacks(spark):
    fcd = spark.createDataFrame([("a", 0.0, "q", 1.0, 5.0), ("b", 0.0, "q", 1.0, 7.0)], "vehicle_id string, timestep_time double, vehicle_lane string, vehicle_speed double, vehicle_pos double")
    links, lengths = spark.createDataFrame([("l", "m")], "lane_id string, next_lane_id string"), spark.createDataFrame([("l", 10.0)], "vehicle_lane string, lane_length double")
    out = {r.vehicle_id: r for r in neighbors.neighbors(fcd, links, lengths).collect()}
    assert (out["a"].following_vehicle_id, out["b"].preceding_vehicle_id, out["a"].lane_length) == ("b", "a", None)
    assert neighbors.neighbors(fcd.where("false"), links, lengths).count() == 0


def test_cycle_without_start(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "lane_id string, next_lane_id string")
    assert sorted(tuple(r.path) for r in topology.simple_paths(links).collect()) == [("a", "b"), ("b", "a")]
    with pytest.raises(topology.TooManyPaths):
        topology.simple_paths(links, max_steps=1)
    with pytest.warns(UserWarning):
        assert topology.simple_paths(links, max_steps=1, on_limit="cut").count() == 0


def test_strict_ends_and_numbers_of_paths(spark):
    links = spark.createDataFrame([("a_0", "a_1"), ("a_1", "b_0"), ("a_0", "b_0"), ("c_0", "b_0")], "lane_id string, next_lane_id string")
    lengths = spark.createDataFrame([(x, 1.0) for x in ("a_0", "a_1", "b_0", "c_0")], "lane_id string, length double")
    paths, long = topology.path_tables(topology.simple_paths(links), lengths, links)
    assert sorted((r.path_id, r.start_edge_lane, r.is_strict_start_edge, r.end_edge_lane, r.is_strict_end_edge) for r in paths.collect()) == [(0, "a", True, "b", True), (1, "c", True, "b", True)]
    assert sorted((r.path_id, r.EdgeLane_seq) for r in long.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    made = topology.topology_tables(links, lengths)
    assert [r.lane_id for r in made["lane_lengths"].collect()] == ["a_0", "a_1", "b_0", "c_0"] and made["lane_links_full"].collect()[-1].lane_id == "c_0"


def test_trip_numbers_with_shared_prefixes_and_a_missing_vehicle(spark):
    rows = [(f"flow_0.{k}", float(t), float(t % 3)) for k in range(70) for t in range(7)]
    df = spark.createDataFrame(rows + [(None, 0.0, 1.0)], "vehicle_id string, timestep_time double, vehicle_speed double").repartition(5)
    got = trips.split_trips(df).collect()
    keys = sorted({(r.vehicle_id, r.segment) for r in got if r.vehicle_id is not None})
    assert len(got) == 491 and all(r.trip_id == (None if r.vehicle_id is None else 1 + keys.index((r.vehicle_id, r.segment))) for r in got)


def test_small_cases_pass_the_points_check(spark):
    rows = [(str(n), "v", float(t), float(t % 2) * 9, 1.0) for n in (1, 2, 3, 4, 5) for t in range(n)] + [("gap", "v", float(t), float(t % 2) * 9, 1.0 if t != 1 else None) for t in range(3)]
    df = spark.createDataFrame(rows, "trip_id string, vehicle_id string, timestep_time double, vehicle_accel double, vehicle_speed double")
    limits = spark.createDataFrame([(k / 10, -1.0, 1.0) for k in range(-41, 42)], "accel_round double, q1_smooth double, q99_smooth double")
    assert {r.trip_id for r in envelope.bad_cases_all_rows(df, limits).collect()} == {"3", "4", "5"}  # of `gap` two rows have a speed
    assert {r.trip_id for r in envelope.bad_cases_points(df, limits).collect()} == {"4", "5"}


def test_merge_sources_and_errors(spark):
    one = spark.createDataFrame([("a", 0.0, 1.0, None, "x"), ("a", 1.0, None, None, "x"), ("a", 2.0, None, 5.0, "x"), (None, None, 2.0, None, "x")], "vehicle_id string, timestep_time double, vehicle_jerk double, vehicle_speed double, opt_source string")
    two = spark.createDataFrame([("a", 2.0, 3.0), ("a", 2.0, 4.0), (None, None, 9.0)], "vehicle_id string, timestep_time double, vehicle_speed double")
    out = sorted((str(r.timestep_time), str(r.vehicle_speed), r.opt_source) for r in merge.overwrite_merge(one, two).collect())
    assert out == [("0.0", "None", "stage1"), ("1.0", "None", "none"), ("2.0", "3.0", "stage2"), ("2.0", "4.0", "stage2"), ("None", "9.0", "stage2")]
    for policy, stage in (("notna_all3", two), ("other", two), ("notna_any", two.drop("vehicle_speed"))):
        with pytest.raises(ValueError):
            merge.overwrite_merge(one, stage, policy=policy)


def test_method_columns_are_derived_only_where_they_have_no_value(spark):
    df = spark.createDataFrame([("a", "1", 0.0, 1.0, None, 7.0), ("a", "1", 1.0, None, None, None), ("a", "1", 2.0, 4.0, None, None)], "vehicle_id string, trip_id string, timestep_time double, car_speed double, vehicle_accel double, vehicle_odometer double")
    got = [tuple(r) for r in merge.standardize_method(df, "m").orderBy("timestep_time").select("vehicle_accel", "vehicle_jerk", "vehicle_odometer", "data_type").collect()]
    assert got == [(0.0, 0.0, 7.0, "m"), (0.0, 0.0, None, "m"), (0.0, 0.0, None, "m")]
    with pytest.raises(ValueError):
        merge.standardize_method(df, "m", simulation=True)


def test_savgol_keeps_cubics(spark):
    for n in (4, 5, 6, 7, 10, 11, 12, 30):
        x = np.arange(n) / 3
        y = 1 + x - x**2 + 0.1 * x**3
        df = spark.createDataFrame([("t", "v", float(k), float(v)) for k, v in enumerate(y)], "trip_id string, vehicle_id string, timestep_time double, value double")
        assert np.allclose([r.s for r in smooth.savgol(df, "value", "s").orderBy("timestep_time").collect()], y)


def test_interpolation_beyond_the_ends(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 10.0, 10.0, 20.0), ("a", 10.0, 11.0, 20.0), ("b", 1.0, 1.0, 1.0)], "vehicle_id string, vehicle_odometer double, vehicle_x double, vehicle_y double")
    rows = spark.createDataFrame([("a", 5.0, None, None), ("a", -5.0, None, None), ("a", 20.0, None, None), ("b", 3.0, 7.0, 8.0), ("c", 3.0, None, None)], knots.schema)
    out = {(r.vehicle_id, r.vehicle_odometer): (r.vehicle_x, r.vehicle_y) for r in merge.interpolate_xy(rows, knots).collect()}
    assert out == {("a", 5.0): (5.0, 10.0), ("a", -5.0): (-5.0, -10.0), ("a", 20.0): (20.0, 40.0), ("b", 3.0): (7.0, 8.0), ("c", 3.0): (None, None)}


def case(v, x, locked=(), **more):
    n = len(v)
    out = {"vehicle_speed": np.array(v, float), "vehicle_odometer": np.array(x, float), "vehicle_accel": np.zeros(n), "preceding_mileage_pos": np.full(n, np.nan), "following_mileage_pos": np.full(n, np.nan), "locked": np.isin(np.arange(n), [0, n - 1, *locked]).astype(float)}
    return out | more


def random_case(rng, n, near=True):
    """A trip that keeps to its bounds, so that its program has a solution, with locks inside and neighbours on some rows."""
    a = np.clip(rng.normal(0, 0.6, n), -1.5, 1.5)
    a[-1] = 0
    v = np.empty(n)
    v[0] = rng.uniform(6, 12)
    for k in range(1, n):
        a[k] = np.clip(a[k], 1.0 - v[k - 1], 18.0 - v[k - 1])
        v[k] = v[k - 1] + (a[k] if k < n - 1 else 0)
    x = 500 + np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)])
    free = rng.random(n) < 0.3
    ahead = np.where(free & near, x + 4.5 + rng.uniform(0, 3, n), np.nan)
    behind = np.where((rng.random(n) < 0.3) & near, x - 4.5 - rng.uniform(0, 3, n), np.nan)
    noisy = np.clip(v + np.where(np.isin(np.arange(n), [0, n - 1]), 0, rng.normal(0, 0.5, n)), 0, 20)
    return case(noisy, x, preceding_mileage_pos=ahead, following_mileage_pos=behind)


def dense(p, k):
    """One program's cost, equations and inequalities as plain matrices."""
    t, n = p.cost.shape[1:]
    eq, rhs, ineq, most = [], [], [], []
    row = lambda: np.zeros((t, n))
    for i in range(t):
        for j in range(n):
            if p.fixed[k, i, j]:
                r = row()
                r[i, j] = 1
                eq.append(r.ravel())
                rhs.append(p.value[k, i, j])
        if p.moves[k, i]:
            for e, f in zip(p.e, p.f):
                r = row()
                r[i], r[i - 1] = e, f
                eq.append(r.ravel())
                rhs.append(0.0)
        for q in np.flatnonzero(p.active[k, i]):
            r = row()
            r[i] = p.c[k, i, q]
            if i:
                r[i - 1] += p.d[k, i, q]
            ineq.append(r.ravel())
            most.append(p.limit[k, i, q])
    return 2 * p.cost[k].ravel(), p.slope[k].ravel(), np.array(eq), np.array(rhs), np.array(ineq), np.array(most)


def stationary(p, k, s):
    """How far the cost's gradient is from a combination of equations and non-negative ones of the inequalities that bind."""
    h, g, eq, _, ineq, most = dense(p, k)
    x = s[k].ravel()
    bind = ineq[most - ineq @ x < 1e-3]
    for _ in range(len(bind) + 1):  # drop what would pull the wrong way
        m = np.concatenate([eq, bind]).T
        y = np.linalg.lstsq(m, -(h * x + g), rcond=None)[0]
        lam = y[len(eq) :]
        if not len(lam) or lam.min() > -1e-5:
            break
        bind = np.delete(bind, lam.argmin(), 0)
    return np.abs(h * x + g + m @ y).max()


def test_programs_of_whole_trips_are_feasible_and_stationary():
    rng = np.random.default_rng(5)
    cases = [random_case(rng, n) for n in (2, 3, 3, 5, 8, 13, 21, 40) for _ in range(4)]
    trips_ = optimize.Trips.of(cases)
    for make in (optimize.stage1, optimize.stage2):
        p = make(trips_, 2.0)
        s, status = qp.solve(p)
        assert (status == qp.OPTIMAL).mean() > 0.7 and qp.residual(p, s)[status == qp.OPTIMAL].max() < 1e-6
        assert (status[[c["preceding_mileage_pos"].size > 2 and np.isnan(c["preceding_mileage_pos"]).all() and np.isnan(c["following_mileage_pos"]).all() for c in cases]] == qp.OPTIMAL).all()
        for k in np.flatnonzero(status == qp.OPTIMAL):
            assert stationary(p, k, s) < 1e-3
        # Solved one by one, without the free steps at the end, each gives the same.
        for k in range(0, len(cases), 5):
            q = make(optimize.Trips.of([cases[k]]), 2.0)
            alone, told = qp.solve(q)
            n = len(cases[k]["vehicle_speed"])
            assert told[0] == status[k] and (told[0] != qp.OPTIMAL or np.abs(alone[0] - s[k, :n]).max() < 1e-4)


def solved(cases, stage=1, **limits):
    if stage == 1:
        return optimize.solve_cases(cases, lambda t: qp.solve(optimize.stage1(t, 2.0)), optimize.VALUES[1:])
    knots = np.linspace(-4.1, 4.1, 83)
    return optimize.solve_cases(cases, lambda t: optimize.solve_stage2(t, 2.0, knots, np.full(83, -limits["width"]), np.full(83, limits["width"])), optimize.VALUES)


def test_what_cannot_be_met_is_proved():
    steady = case([10.0] * 6, [10.0 * k for k in range(6)])
    two, fast, far = case([5.0, 9.0], [0.0, 5.0]), case([25.0] * 5, [25.0 * k for k in range(5)]), case([10.0] * 5, [10.0 * k for k in range(4)] + [99.0])
    jam = case([10.0] * 6, [10.0 * k for k in range(6)], preceding_mileage_pos=np.array([np.nan, np.nan, np.nan, np.nan, np.nan, 51.0]))
    got = solved([steady, two, fast, far, jam, case([1.0], [0.0]), case([1.0, np.nan], [0.0, 1.0])])
    assert [s for _, s in got] == ["optimal", *["infeasible"] * 6]
    assert np.allclose(got[0][0]["vehicle_accel"], 0, atol=1e-6) and np.allclose(got[0][0]["vehicle_speed"], 10, atol=1e-6) and got[1][0] == {}
    got = solved([steady, two, fast], 2, width=1.0)
    assert [s for _, s in got] == ["optimal", "infeasible", "infeasible"] and np.allclose(got[0][0]["vehicle_jerk"], 0, atol=1e-5)


def test_second_stage_keeps_to_the_envelope():
    rng = np.random.default_rng(8)
    knots = np.linspace(-4.1, 4.1, 83)
    low, high = -0.6 - 0.2 * np.cos(2 * knots) - 0.05 * np.abs(knots), 0.6 + 0.2 * np.sin(3 * knots) + 0.05 * np.abs(knots)
    trips_ = optimize.Trips.of([random_case(rng, n, False) for n in (6, 12, 30) for _ in range(6)])
    first, _ = qp.solve(optimize.stage1(trips_, 2.0))
    trips_.a[:] = first[..., 0]
    s, status = optimize.solve_stage2(trips_, 2.0, knots, low, high)
    assert (status == qp.OPTIMAL).mean() > 0.5
    p = optimize.stage2(trips_, 2.0)
    for k in np.flatnonzero(status == qp.OPTIMAL):
        n = trips_.n[k] - 1
        a, j = s[k, :n, 1], s[k, :n, 0]
        assert (j <= np.interp(a, knots, high) + 1e-5).all() and (j >= np.interp(a, knots, low) - 1e-5).all() and np.abs(a).max() <= 4.1 + 1e-5
    assert qp.residual(p, s)[status == qp.OPTIMAL].max() < 1e-6


def test_run_all(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        c = random_case(rng, 9, False)
        rows += [(str(k), f"v{k}", float(t), float(v), float(x)) for t, (v, x) in enumerate(zip(c["vehicle_speed"], c["vehicle_odometer"]))]
    rows += [("idle", "w", float(t), 0.0, 1.0) for t in range(3)] + [("one", "z", 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "trip_id string, vehicle_id string, timestep_time double, vehicle_speed double, vehicle_odometer double")
    limits = spark.createDataFrame([(k / 10, -0.5, 0.5) for k in range(-41, 42)], "accel_round double, q1_smooth double, q99_smooth double")
    one, two = optimize.run_all(df, limits)
    assert {r.trip_id for r in one.collect()} == {*map(str, range(12)), "one"}
    bad = {r.trip_id for r in envelope.bad_cases_all_rows(one, limits).collect()}
    assert {r.trip_id for r in two.collect()} == bad and bad
    merged = merge.overwrite_merge(one, two)
    assert merged.count() == one.count()
    assert optimize.run_all(df, limits.withColumn("q1_smooth", F.lit(-99.0)).withColumn("q99_smooth", F.lit(99.0)))[1].count() >= 0


def test_envelope_files(spark, tmp_path):
    file = tmp_path / "e.csv"
    file.write_bytes("\ufeffaccel_round,q1,q99,q1_smooth,q99_smooth\n0.25,0,0,-1,1\n0.2,0,0,-3,0.5\nx,0,0,1,1\n0.3,0,0,-2,2\n".encode())
    read = lambda how: sorted(tuple(r) for r in network.envelope_csv(spark, str(file), how).collect())
    assert read("widest") == [(0.2, -3.0, 1.0), (0.3, -2.0, 2.0)] and read("last") == [(0.2, -3.0, 0.5), (0.3, -2.0, 2.0)] and len(read("all")) == 3


def test_network_files(spark, tmp_path):
    net = tmp_path / "net.xml"
    net.write_text('<net><edge id="a"><lane id="a_0" length="10.5"/></edge><edge id="b"><lane id="b_0" length="x"/></edge><connection from="a" to="b" fromLane="0" toLane="0" via=":j_0"/><connection from="b" to="c" fromLane="0" toLane="0"/></net>')
    assert {tuple(r) for r in network.connections_xml(spark, str(net)).collect()} == {("a_0", ":j_0"), (":j_0", "b_0"), ("b_0", "c_0")}
    assert {tuple(r) for r in network.connections_xml(spark, str(net), False).collect()} == {("b_0", "c_0")}
    assert {tuple(r) for r in network.lanes_xml(spark, str(net)).collect()} == {("a_0", 10.5), ("b_0", None)}
    fcd = tmp_path / "fcd.xml"
    fcd.write_text('<fcd-export><timestep time="1.0"><vehicle id="v" lane="a_0" pos="2.5" speed="3"/></timestep></fcd-export>')
    assert network.fcd_xml(spark, str(fcd)).first()[:5] == (1.0, "v", "a_0", 2.5, 3.0)
