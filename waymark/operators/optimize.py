"""Speed profiles by per-trip optimisation.

Stage 1 is a convex quadratic program and has one optimum. Stage 2 adds the jerk envelope, which isn't convex: each step
keeps to one segment of the envelope, the convex program for these segments is solved, steps whose acceleration has left their
segment move on, and so forth; the result is a local optimum and says so. Trips of like length are solved side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import number
from waymark.operators import qp
from waymark.operators.envelope import bad_cases_all_rows


@dataclass(frozen=True)
class OptimizeConfig:
    """Limits, weights and column names of both stages."""

    v_max: float = 20.0
    a_min: float = -4.0
    a_max: float = 5.0
    j_min: float = -5.0
    j_max: float = 4.0
    w_a: float = 5.0
    w_v: float = 1.0
    w_x: float = 0.0
    lock_zero: bool = True
    decimals: int = 1
    ahead: str = "preceding"
    behind: str = "following"


DEFAULT = OptimizeConfig()
STATUS = {qp.OPTIMAL: "optimal", qp.INFEASIBLE: "infeasible", qp.FAILED: "failed"}
KEYS = ["trip_id", "vehicle_id", "timestep_time"]
VALUES = ["vehicle_jerk", "vehicle_accel", "vehicle_speed", "vehicle_odometer"]
OUT = "trip_id string, vehicle_id string, timestep_time double, vehicle_jerk double, vehicle_accel double, vehicle_speed double, vehicle_odometer double, status string"
CELLS = 20_000  # time steps of the trips solved at once


def safe_distance(df: DataFrame, ahead: str = "preceding_headway_distance", behind: str = "following_headway_distance", default: float = 2.0) -> DataFrame:
    """x_safe: the least headway of all rows, or the default."""
    return df.agg(F.coalesce(F.least(F.min(number(ahead)), F.min(number(behind))), F.lit(default)).alias("x_safe"))


def prepare(df: DataFrame, config: OptimizeConfig = DEFAULT) -> DataFrame:
    """Typed keys, rows without a time dropped, one row for each vehicle and time, places of the neighbours, locks.

    Locked are rows that stand still (unless lock_zero is off, which leaves all rows of a trip free but its ends).
    """
    w = Window.partitionBy("vehicle_id", "timestep_time").orderBy("trip_id", "vehicle_odometer", "vehicle_speed")
    out = df.withColumns({"trip_id": F.col("trip_id").cast("string"), "vehicle_id": F.col("vehicle_id").cast("string"), "timestep_time": number("timestep_time")})
    out = out.where("timestep_time is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    for name, side, sign in (("preceding", config.ahead, 1), ("following", config.behind, -1)):
        has = f"{side}_vehicle_id" in df.columns and f"{side}_headway_distance" in df.columns
        place = F.when(F.col(f"{side}_vehicle_id").isNotNull(), F.col("vehicle_odometer") + sign * number(f"{side}_headway_distance")) if has else F.lit(None).cast("double")
        out = out.withColumn(f"{name}_mileage_pos", place)
    trip = Window.partitionBy("trip_id", "vehicle_id").orderBy("timestep_time")
    ends = F.lag(F.lit(1)).over(trip).isNull() | F.lead(F.lit(1)).over(trip).isNull()
    still = F.coalesce(F.col("vehicle_speed") == 0, F.lit(False)) if config.lock_zero else F.lit(False)
    return out.withColumn("locked", still | ends)


@dataclass
class Trips:
    """Columns of B trips as (B, T) arrays; what lies beyond a trip's n rows is 0."""

    n: np.ndarray
    v: np.ndarray
    x: np.ndarray  # from the trip's first place
    first: np.ndarray
    a: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray
    locked: np.ndarray
    inside: np.ndarray

    @classmethod
    def of(cls, cases: list[dict[str, np.ndarray]]) -> "Trips":
        n = np.array([len(c["vehicle_speed"]) for c in cases])
        shape = len(cases), int(n.max())

        def filled(name: str, empty: float = 0.0) -> np.ndarray:
            out = np.full(shape, empty)
            for k, c in enumerate(cases):
                out[k, : n[k]] = c[name]
            return out

        first = np.array([c["vehicle_odometer"][0] for c in cases])
        inside = np.arange(shape[1]) < n[:, None]
        place = lambda name: filled(name, np.nan) - first[:, None]
        return cls(n, filled("vehicle_speed"), np.where(inside, place("vehicle_odometer"), 0.0), first, np.nan_to_num(filled("vehicle_accel")), place("preceding_mileage_pos"), place("following_mileage_pos"), filled("locked").astype(bool), inside)

    def last(self) -> np.ndarray:
        return np.arange(self.v.shape[1]) == self.n[:, None] - 1


def bounds(trips: Trips, x_safe: float, config: OptimizeConfig, n: int, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c, d, limit and active of the inequalities that both stages have; at: which component is which."""
    b, t = trips.v.shape
    rows: list[tuple[dict[str, float], dict[str, float], np.ndarray | float, np.ndarray]] = []
    yes, later = trips.inside, trips.inside & (np.arange(t) > 0)
    limits = [("a", config.a_min, config.a_max), ("v", 0.0, config.v_max)] + ([("j", config.j_min, config.j_max)] if "j" in at else [])
    for name, low, high in limits:
        rows += [({name: 1.0}, {}, high, yes), ({name: -1.0}, {}, -low, yes)]
    if "j" not in at:
        rows += [({"x": -1.0}, {"x": 1.0}, 0.0, later), ({"a": 1.0}, {"a": -1.0}, config.j_max, later), ({"a": -1.0}, {"a": 1.0}, -config.j_min, later)]
    rows.append(({"x": 1.0, "v": 0.1}, {}, np.nan_to_num(trips.ahead) - x_safe, yes & ~np.isnan(trips.ahead)))
    rows.append(({"x": -1.0}, {}, -np.nan_to_num(trips.behind) - x_safe - 0.1 * config.v_max, yes & ~np.isnan(trips.behind)))
    p = len(rows)
    c, d, limit, active = np.zeros((b, t, p, n)), np.zeros((b, t, p, n)), np.zeros((b, t, p)), np.zeros((b, t, p), bool)
    for k, (now, before, most, on) in enumerate(rows):
        for name, x in now.items():
            c[:, :, k, at[name]] = x * on
        for name, x in before.items():
            d[:, :, k, at[name]] = x * on
        limit[:, :, k], active[:, :, k] = np.where(on, most, 0.0), on
    return c, d, limit, active


def reach_of(trips: Trips, config: OptimizeConfig, at: dict[str, int]) -> np.ndarray:
    """A component's size in any feasible point: the first place is fixed and speeds are bounded."""
    out = np.zeros((len(trips.n), len(at)))
    far = np.maximum(1.0, (config.v_max + 5) * (trips.n + 1))
    for name, k in at.items():
        out[:, k] = far if name == "x" else max(abs(config.a_min), abs(config.a_max), abs(config.j_min), abs(config.j_max)) if name in "aj" else config.v_max
    return out


def stage1(trips: Trips, x_safe: float, config: OptimizeConfig = DEFAULT) -> qp.Programs:
    """The first stage's programs over (a, v, x)."""
    at = {"a": 0, "v": 1, "x": 2}
    b, t = trips.v.shape
    c, d, limit, active = bounds(trips, x_safe, config, 3, at)
    cost, slope = np.zeros((b, t, 3)), np.zeros((b, t, 3))
    cost[..., 0], cost[..., 1], cost[..., 2] = config.w_a * trips.inside, config.w_v * trips.inside, config.w_x * trips.inside
    slope[..., 1], slope[..., 2] = -2 * cost[..., 1] * trips.v, -2 * cost[..., 2] * trips.x
    cost[~trips.inside] = 1.0
    lock = trips.locked & trips.inside
    fixed = np.stack([trips.last(), lock, lock], 2)
    value = np.where(fixed, np.stack([np.zeros_like(trips.v), trips.v, trips.x], 2), 0.0)
    e, f = np.array([[-1.0, 1, 0], [-0.5, 0, 1]]), np.array([[0.0, -1, 0], [0, -1, -1]])
    moves = trips.inside & (np.arange(t) > 0)
    start = np.stack([np.zeros_like(trips.v), np.clip(trips.v, 0, config.v_max), trips.x], 2)
    return qp.Programs(cost, slope, e, f, moves, fixed, value, c, d, limit, active, reach_of(trips, config, at), start)


def stage2(trips: Trips, x_safe: float, config: OptimizeConfig = DEFAULT) -> qp.Programs:
    """The second stage's programs over (j, a, v, x), without the envelope: four rows a step wait for it."""
    at = {"j": 0, "a": 1, "v": 2, "x": 3}
    b, t = trips.v.shape
    c, d, limit, active = bounds(trips, x_safe, config, 4, at)
    pad = lambda x: np.concatenate([x, np.zeros((b, t, 4, *x.shape[3:]), x.dtype)], 2)
    c, d, limit, active = pad(c), pad(d), pad(limit), pad(active)
    lock = trips.locked & trips.inside
    cost, slope = np.zeros((b, t, 4)), np.zeros((b, t, 4))
    free = trips.inside & ~lock
    cost[..., 1], cost[..., 2], cost[..., 3] = config.w_a * trips.inside, config.w_v * free, config.w_x * free
    slope[..., 2], slope[..., 3] = -2 * cost[..., 2] * trips.v, -2 * cost[..., 3] * trips.x
    cost[~trips.inside] = 1.0
    none = np.zeros_like(lock)
    fixed = np.stack([trips.last(), none, lock, lock], 2)
    value = np.where(fixed, np.stack([np.zeros_like(trips.v), np.zeros_like(trips.v), trips.v, trips.x], 2), 0.0)
    e = np.array([[0.0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    f = np.array([[-1.0, -1, 0, 0], [-0.5, -1, -1, 0], [-1 / 6, -0.5, -1, -1]])
    moves = trips.inside & (np.arange(t) > 0)
    start = np.stack([np.zeros_like(trips.v), np.clip(trips.a, config.a_min, config.a_max), np.clip(trips.v, 0, config.v_max), trips.x], 2)
    return qp.Programs(cost, slope, e, f, moves, fixed, value, c, d, limit, active, reach_of(trips, config, at), start)


def with_envelope(p: qp.Programs, on: np.ndarray, segment: np.ndarray, knots: np.ndarray, jmin: np.ndarray, jmax: np.ndarray, within: bool) -> qp.Programs:
    """p with the envelope's lines of each step's segment, and with the segment's ends as bounds of acceleration if within."""
    p = p.part(np.arange(len(p.cost)))
    up, down = np.diff(jmax) / np.diff(knots), np.diff(jmin) / np.diff(knots)
    c, limit, active = p.c, p.limit, p.active
    c[:, :, -4:] = 0
    c[:, :, -4, 0], c[:, :, -4, 1], limit[:, :, -4] = on, -up[segment] * on, (jmax[segment] - up[segment] * knots[segment]) * on
    c[:, :, -3, 0], c[:, :, -3, 1], limit[:, :, -3] = -1.0 * on, down[segment] * on, (down[segment] * knots[segment] - jmin[segment]) * on
    c[:, :, -2, 1], limit[:, :, -2] = 1.0 * on * within, knots[segment + 1] * on * within
    c[:, :, -1, 1], limit[:, :, -1] = -1.0 * on * within, -knots[segment] * on * within
    active[:, :, -4:-2], active[:, :, -2:] = on[..., None], (on & within)[..., None]
    return p


def solve_stage2(trips: Trips, x_safe: float, knots: np.ndarray, jmin: np.ndarray, jmax: np.ndarray, config: OptimizeConfig = DEFAULT, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(states, status): INFEASIBLE where even the program without the envelope is proved empty, FAILED where no feasible choice of
    segments was found, else a local optimum.

    Two starts, the accelerations of stage 1 and those without the envelope, are followed. A round solves with the lines of the
    present segments; where that gives accelerations inside other segments, those are next. Once they agree the segments' ends
    become bounds, and steps that come to rest at one try the segment beyond it for as long as the cost falls.
    """
    base = stage2(trips, x_safe, config)
    free, status = qp.solve(base)
    on = trips.inside & ~trips.last()
    place = lambda a: np.clip(np.searchsorted(knots, a, "right") - 1, 0, len(knots) - 2)
    best, cost = base.start.copy(), np.full(len(trips.n), np.inf)

    def allowed(s: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Whether the true envelope holds."""
        a, j = s[..., 1], s[..., 0]
        good = (j <= np.interp(a, knots, jmax) + 1e-6) & (j >= np.interp(a, knots, jmin) - 1e-6) & (a >= knots[0] - 1e-6) & (a <= knots[-1] + 1e-6)
        return (good | ~on).all(1)

    for start in (trips.a, free[..., 1]):
        segment = place(start)
        going = np.flatnonzero(status != qp.INFEASIBLE)
        for _ in range(rounds):
            if not len(going):
                break
            s, told = qp.solve(with_envelope(base.part(going), on[going], segment[going], knots, jmin, jmax, False))
            ok = told == qp.OPTIMAL
            new = place(s[..., 1])
            value = worth_of(base, going, s)
            better = ok & allowed(s, on[going]) & (value < cost[going] - 1e-9)
            best[going[better]], cost[going[better]] = s[better], value[better]
            moved = ok & (new != segment[going]).any(1)
            segment[going[ok]] = new[ok]
            going = going[moved]
        going = np.flatnonzero(np.isfinite(cost))
        segment[going] = place(best[going][..., 1])
        for _ in range(rounds):
            if not len(going):
                break
            s, told = qp.solve(with_envelope(base.part(going), on[going], segment[going], knots, jmin, jmax, True))
            value = worth_of(base, going, s)
            better = (told == qp.OPTIMAL) & (value < cost[going] - 1e-9)
            best[going[better]], cost[going[better]] = s[better], value[better]
            now = segment[going]
            move = np.where(s[..., 1] >= knots[now + 1] - 1e-6, 1, np.where(s[..., 1] <= knots[now] + 1e-6, -1, 0)) * on[going]
            segment[going] = np.clip(now + move, 0, len(knots) - 2)
            going = going[better & (move != 0).any(1)]
    return best, np.where(np.isfinite(cost), qp.OPTIMAL, np.where(status == qp.INFEASIBLE, qp.INFEASIBLE, qp.FAILED))


def worth_of(p: qp.Programs, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (p.cost[k] * s * s + p.slope[k] * s).sum((1, 2))


def solve_cases(cases: list[dict[str, np.ndarray]], solver: Callable[[Trips], tuple[np.ndarray, np.ndarray]], names: list[str]) -> list[tuple[dict[str, np.ndarray], str]]:
    """What the solver gives for each case, by column, and its status. Cases of like length are solved at once; those of one row or
    with a missing speed or place aren't solved."""
    out: list = [({}, "infeasible")] * len(cases)
    usable = [k for k, c in enumerate(cases) if len(c["vehicle_speed"]) > 1 and not np.isnan(c["vehicle_speed"]).any() and not np.isnan(c["vehicle_odometer"]).any()]
    usable.sort(key=lambda k: len(cases[k]["vehicle_speed"]))
    at = 0
    while at < len(usable):
        least = len(cases[usable[at]]["vehicle_speed"])
        end = at
        while end < len(usable) and len(cases[usable[end]]["vehicle_speed"]) <= least + least // 8 and (end == at or (end - at + 1) * len(cases[usable[end]]["vehicle_speed"]) <= CELLS):
            end += 1
        group = usable[at:end]
        trips = Trips.of([cases[k] for k in group])
        states, status = solver(trips)
        for i, k in enumerate(group):
            n = trips.n[i]
            got = {name: states[i, :n, c] + (trips.first[i] if name == "vehicle_odometer" else 0.0) for c, name in enumerate(names)} if status[i] == qp.OPTIMAL else {}
            out[k] = got, STATUS[int(status[i])]
        at = end
    return out


NEEDED = ["vehicle_speed", "vehicle_odometer", "vehicle_accel", "preceding_mileage_pos", "following_mileage_pos", "locked"]


def _solved(df: DataFrame, solver: Callable[[Trips], tuple[np.ndarray, np.ndarray]], names: list[str]) -> DataFrame:
    """The solver's values of all trips: one exchange by trip into as many partitions as the session has for shuffles, whose sorted
    rows are cut into trips as they come."""
    spark = df.sparkSession
    rows = df if "vehicle_accel" in df.columns else df.withColumn("vehicle_accel", F.lit(None).cast("double"))
    rows = rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in NEEDED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            trip, vehicle = (frame[c].to_numpy(object) for c in KEYS[:2])
            edges = np.concatenate([[0], np.flatnonzero((trip[1:] != trip[:-1]) | (vehicle[1:] != vehicle[:-1])) + 1, [len(frame)]])
            columns = {c: frame[c].to_numpy(float) for c in NEEDED}
            cases = [{c: v[a:b] for c, v in columns.items()} for a, b in zip(edges, edges[1:])]
            found = solve_cases(cases, solver, names)
            none = [np.full(b - a, np.nan) for a, b in zip(edges, edges[1:])]
            made = {c: np.concatenate([got.get(c, empty) for (got, _), empty in zip(found, none)]) for c in VALUES}
            return pd.DataFrame({**{k: frame[k] for k in KEYS}, **made, "status": np.repeat([s for _, s in found], np.diff(edges))})

        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < 4 * CELLS:
                continue
            frame = pd.concat(held, ignore_index=True)
            same = (frame["trip_id"].to_numpy(object) == frame["trip_id"].iat[-1]) & (frame["vehicle_id"].to_numpy(object) == frame["vehicle_id"].iat[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last trip may go on
            if cut:
                yield whole(frame[:cut])
            held, size = [frame[cut:].reset_index(drop=True)], len(frame) - cut
        if held and sum(map(len, held)):
            yield whole(pd.concat(held, ignore_index=True))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "trip_id", "vehicle_id").sortWithinPartitions(*KEYS).mapInPandas(run, OUT)


def _merged(df: DataFrame, solved: DataFrame, status: str) -> DataFrame:
    """df with the solver's values where it has them; null keys meet too."""
    new = solved.select(*[F.col(k).alias(f"_k_{k}") for k in KEYS], *[F.when(~F.isnan(c), F.col(c)).alias(f"_{c}") for c in VALUES], F.col("status").alias(status))
    on = [df[k].eqNullSafe(new[f"_k_{k}"]) for k in KEYS]
    out = df.join(new, on[0] & on[1] & on[2], "left")
    return out.select(*[c for c in df.columns if c not in VALUES], *[F.coalesce(f"_{c}", c if c in df.columns else F.lit(None).cast("double")).alias(c) for c in VALUES], status)


def moving(df: DataFrame) -> DataFrame:
    """Rows of trips that move at all."""
    moves = F.max(F.coalesce(F.col("vehicle_speed"), F.lit(0.0)) != 0).over(Window.partitionBy("trip_id"))
    return df.withColumn("_m", moves).where("_m").drop("_m")


def x_safe_of(ready: DataFrame, x_safe: float | None, config: OptimizeConfig) -> float:
    if x_safe is not None:
        return x_safe
    names = [f"{side}_headway_distance" for side in (config.ahead, config.behind)]
    return safe_distance(ready, *names).first()[0] if set(names) <= set(ready.columns) else 2.0


def run_stage1(df: DataFrame, x_safe: float | None = None, config: OptimizeConfig = DEFAULT) -> DataFrame:
    """Trips that move, with stage 1's acceleration, speed and odometer, and s1_status; unsolved trips keep theirs."""
    ready = prepare(df, config)
    distance = x_safe_of(ready, x_safe, config)
    ready = moving(ready)
    solver = lambda trips: qp.solve(stage1(trips, distance, config))
    return _merged(ready, _solved(ready, solver, VALUES[1:]), "s1_status")


def envelope_knots(envelope: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The envelope's keys in order and its limits: a fixed table of 83 rows or so."""
    rows = sorted({float(r[0]): (float(r[1]), float(r[2])) for r in envelope.select(number("accel_round"), number("q1_smooth"), number("q99_smooth")).dropna().collect()}.items())
    return tuple(np.array(x) for x in zip(*[(k, lo, hi) for k, (lo, hi) in rows]))


def run_stage2(stage1_rows: DataFrame, bad: DataFrame, envelope: DataFrame, x_safe: float | None = 2.0, config: OptimizeConfig = DEFAULT) -> DataFrame:
    """Rows of the bad cases with stage 2's values and s2_status (optimal means a local optimum); no bad case gives no rows."""
    knots, jmin, jmax = envelope_knots(envelope)
    chosen = moving(stage1_rows.join(bad, ["trip_id", "vehicle_id"], "left_semi"))
    distance = x_safe_of(stage1_rows, x_safe, config)
    ready = prepare(chosen.drop("preceding_mileage_pos", "following_mileage_pos", "locked"), config)
    solver = lambda trips: solve_stage2(trips, distance, knots, jmin, jmax, config)
    return _merged(ready, _solved(ready, solver, VALUES), "s2_status")


def run_all(df: DataFrame, envelope: DataFrame, x_safe: float | None = None, config: OptimizeConfig = DEFAULT, keep=lambda stage: stage.persist()) -> tuple[DataFrame, DataFrame]:
    """(stage 1 of all trips, stage 2 of those whose jerk leaves the envelope). `keep` holds stage 1 for its two readers: a cache,
    or a function that writes and rereads it."""
    distance = x_safe_of(prepare(df, config), x_safe, config)
    one = keep(run_stage1(df, distance, config))
    return one, run_stage2(one, bad_cases_all_rows(one, envelope, config.decimals), envelope, distance, config)
