"""Fixed points on edge tables, many graphs (fits) together.

All operators take ``by`` columns. Graphs that fit a task are iterated in numpy, larger ones by one
equi-join and one aggregation a step with the lineage cut as it grows (see ``pergraph``). ``steps``
steps are made; with ``tolerance`` a graph ends earlier, when no value moves by more (a large graph
looks every ``CHECK`` steps). Node tables have one row per node, edge tables src, dst and a weight
or cost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import clip
from fellscape.operators.pergraph import coded, solve
from fellscape.session import cut

#: Steps that are planned into one job before the lineage is cut.
CHECK = 4


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], value: str, keys: Sequence[str], steps: int, tolerance: float | None = None) -> DataFrame:
    """``state`` after ``steps`` steps, or earlier when no value moved by more than ``tolerance``."""
    state = cut(state)
    done = 0
    while done < steps:
        before = state
        for _ in range(min(CHECK, steps - done)):
            previous, state = state, step(state)
            done += 1
        state = cut(state)
        if tolerance is not None:
            last = state.join(before.select(*keys, F.col(value).alias("_old")), list(keys))
            moved = last.agg(F.max(F.abs(F.col(value) - F.col("_old")))).first()[0]
            if moved is None or moved <= tolerance:
                break
    return state


def row_normalized(edges: DataFrame, weight: str, by: Sequence[str] = (), name: str = "p") -> DataFrame:
    """Edges with the weight's share of its source's total; sources without weight keep 0."""
    total = edges.groupBy(*by, "src").agg(F.sum(weight).alias("_t"))
    return edges.join(total, [*by, "src"]).withColumn(name, F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(0.0)).drop("_t")


def softmax_edges(edges: DataFrame, score: str, by: Sequence[str] = (), bound: float = 60.0, name: str = "p") -> DataFrame:
    """Edges with the max-shifted softmax of a score over each source's edges."""
    top = edges.groupBy(*by, "src").agg(F.max(score).alias("_m"))
    return row_normalized(edges.join(top, [*by, "src"]).withColumn("_w", F.exp(clip(F.col(score) - F.col("_m"), -bound, bound))), "_w", by, name).drop("_w", "_m")


def _settle(x: np.ndarray, step: Callable[[np.ndarray], np.ndarray], steps: int, tolerance: float | None) -> np.ndarray:
    """``x`` after ``steps`` steps, or earlier when nothing moved by more than ``tolerance``."""
    for _ in range(steps):
        new = step(x)
        still = tolerance is not None and np.abs(new - x).max(initial=0.0) <= tolerance
        x = new
        if still:
            break
    return x


def committor(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), steps: int = 256, tolerance: float | None = 1e-9) -> DataFrame:
    """(by, idx, q): probability of reaching a target before a source.

    ``nodes``: idx, role ("source", "target" or null); ``edges``: src, dst, weight. Jacobi from
    0.5 with sources at 0 and targets at 1; a node without weighted out-edges keeps its start.
    """
    p = row_normalized(edges, "weight", by).select(*by, "src", "dst", "p")

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("idx")
        ids, u, v, known = coded(n, e)
        w = e["p"].to_numpy(float)[known]
        role = n["role"].to_numpy(object)
        moves = (np.bincount(u, w, len(ids)) > 0) & pd.isna(role)
        start = np.where(role == "source", 0.0, np.where(role == "target", 1.0, 0.5)).astype(float)
        q = _settle(start, lambda x: np.where(moves, np.bincount(u, w * x[v], len(ids)), x), steps, tolerance)
        return pd.DataFrame({"idx": ids, "q": q})

    def loop(nodes: DataFrame, p: DataFrame, by: list[str]) -> DataFrame:
        fixed = F.when(F.col("role") == "source", 0.0).when(F.col("role") == "target", 1.0)
        start = nodes.select(*by, "idx", "role", F.coalesce(fixed, F.lit(0.5)).alias("q"))

        def step(s: DataFrame) -> DataFrame:
            mean = p.join(s.select(*by, F.col("idx").alias("dst"), "q"), [*by, "dst"]).groupBy(*by, F.col("src").alias("idx")).agg(F.sum(F.col("p") * F.col("q")).alias("m"), F.sum("p").alias("w"))
            met = s.join(mean, [*by, "idx"], "left")
            moved = F.when(F.col("role").isNotNull() | F.col("w").isNull() | (F.col("w") <= 0), F.col("q")).otherwise(F.col("m"))
            return met.select(*by, "idx", "role", moved.alias("q"))

        return iterate(start, step, "q", [*by, "idx"], steps, tolerance)

    return solve(nodes.select(*by, "idx", "role"), p, by, kernel, "idx BIGINT, q DOUBLE", loop)


def mean_first_passage(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), temperature: float = 1.0, steps: int = 400, tolerance: float | None = 1e-5) -> DataFrame:
    """(by, idx, h): expected steps to the nodes flagged ``attractor``, transition weights exp(-W/T).

    Jacobi h = 1 + P h from the number of nodes; attractors are 0, nodes without out-edges keep their start.
    """
    weight = F.exp(-clip(F.col("work") / temperature, -50.0, 50.0))
    p = row_normalized(edges.withColumn("_w0", weight), "_w0", by).select(*by, "src", "dst", "p")

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("idx")
        ids, u, v, known = coded(n, e)
        w, rest = e["p"].to_numpy(float)[known], n["attractor"].to_numpy(bool)
        moves = (np.bincount(u, minlength=len(ids)) > 0) & ~rest
        start = np.where(rest, 0.0, float(len(ids)))
        h = _settle(start, lambda x: np.where(moves, 1 + np.bincount(u, w * x[v], len(ids)), x), steps, tolerance)
        return pd.DataFrame({"idx": ids, "h": h})

    def loop(nodes: DataFrame, p: DataFrame, by: list[str]) -> DataFrame:
        n = nodes.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
        start = nodes.join(n, by).select(*by, "idx", "attractor", F.when(F.col("attractor"), 0.0).otherwise(F.col("n")).alias("h"))

        def step(s: DataFrame) -> DataFrame:
            mean = p.join(s.select(*by, F.col("idx").alias("dst"), "h"), [*by, "dst"]).groupBy(*by, F.col("src").alias("idx")).agg(F.sum(F.col("p") * F.col("h")).alias("m"))
            met = s.join(mean, [*by, "idx"], "left")
            return met.select(*by, "idx", "attractor", F.when(F.col("attractor") | F.col("m").isNull(), F.col("h")).otherwise(1 + F.col("m")).alias("h"))

        return iterate(start, step, "h", [*by, "idx"], steps, tolerance)

    return solve(nodes.select(*by, "idx", "attractor"), p, by, kernel, "idx BIGINT, h DOUBLE", loop)


def _pushed(start: Callable, steps: int, tolerance: float | None) -> Callable:
    """Kernel: mass pushed along edges p; nodes without outgoing probability keep theirs."""

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("idx")
        ids, u, v, known = coded(n, e)
        w = e["p"].to_numpy(float)[known]
        stays = np.bincount(u, w, len(ids)) <= 0
        mass = _settle(start(n), lambda x: np.bincount(v, w * np.where(stays, 0.0, x)[u], len(ids)) + np.where(stays, x, 0.0), steps, tolerance)
        return pd.DataFrame({"idx": ids, "mass": mass})

    return kernel


def push_mass(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), steps: int = 80) -> DataFrame:
    """(by, idx, mass): mass pushed along row-stochastic edges (column p); dead ends keep theirs."""

    def loop(nodes: DataFrame, p: DataFrame, by: list[str]) -> DataFrame:
        out = p.groupBy(*by, F.col("src").alias("idx")).agg(F.sum("p").alias("out"))
        start = nodes.join(out, [*by, "idx"], "left").select(*by, "idx", (F.coalesce("out", F.lit(0.0)) <= 0).alias("dead"), "mass")

        def step(s: DataFrame) -> DataFrame:
            came = p.join(s.where("not dead").select(*by, F.col("idx").alias("src"), "mass"), [*by, "src"]).groupBy(*by, F.col("dst").alias("idx")).agg(F.sum(F.col("p") * F.col("mass")).alias("m"))
            met = s.join(came, [*by, "idx"], "left")
            return met.select(*by, "idx", "dead", (F.coalesce("m", F.lit(0.0)) + F.when(F.col("dead"), F.col("mass")).otherwise(0.0)).alias("mass"))

        return iterate(start, step, "mass", [*by, "idx"], steps)

    kernel = _pushed(lambda n: n["mass"].to_numpy(float), steps, None)
    return solve(nodes.select(*by, "idx", "mass"), edges.select(*by, "src", "dst", "p"), by, kernel, "idx BIGINT, mass DOUBLE", loop)


def stationary(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), steps: int = 256, tolerance: float | None = 1e-8) -> DataFrame:
    """(by, idx, mass): power iteration from the uniform distribution; dead ends have a self loop."""

    def loop(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
        n = nodes.groupBy(*by).agg(F.count("*").alias("n"))
        start = nodes.join(n, by).select(*by, "idx", (1.0 / F.col("n")).alias("mass"))
        out = edges.groupBy(*by, F.col("src").alias("idx")).agg(F.sum("p").alias("out"))
        loops = nodes.join(out.where("out > 0"), [*by, "idx"], "left_anti").select(*by, F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(1.0).alias("p"))
        p = cut(edges.select(*by, "src", "dst", "p").unionByName(loops))

        def step(s: DataFrame) -> DataFrame:
            came = p.join(s.select(*by, F.col("idx").alias("src"), "mass"), [*by, "src"]).groupBy(*by, F.col("dst").alias("idx")).agg(F.sum(F.col("p") * F.col("mass")).alias("m"))
            return s.join(came, [*by, "idx"], "left").select(*by, "idx", F.coalesce("m", F.lit(0.0)).alias("mass"))

        return iterate(start, step, "mass", [*by, "idx"], steps, tolerance)

    kernel = _pushed(lambda n: np.full(len(n), 1.0 / max(1, len(n))), steps, tolerance)
    return solve(nodes.select(*by, "idx"), edges.select(*by, "src", "dst", "p"), by, kernel, "idx BIGINT, mass DOUBLE", loop)


def spectrum_summary(mass: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entropy rate of the chain and entropy of its stationary distribution."""
    by = list(by)
    per = edges.where("p > 0").groupBy(*by, F.col("src").alias("idx")).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    met = mass.join(per, [*by, "idx"], "left")
    return met.groupBy(*by).agg(F.sum(F.col("mass") * F.coalesce("h", F.lit(0.0))).alias("entropy_rate"), (-F.sum(F.when(F.col("mass") > 0, F.col("mass") * F.log("mass")).otherwise(0.0))).alias("entropy"))


def shortest_costs(sources: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, idx, cost, via): least cost from any source, with the predecessor.

    Bellman-Ford until nothing improves; costs may be negative, a cycle of negative cost, where that
    never happens, is an error. Of equal costs the way of fewer edges stands, then the smaller predecessor,
    so the predecessors form no cycle. Sources have none unless something is cheaper than 0. Unreached
    nodes have no row.
    """
    e = edges.groupBy(*by, "src", "dst").agg(F.min("cost").alias("c"))

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[n["idx"], e["src"], e["dst"]].astype(np.int64))
        u, v, c = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), e["c"].to_numpy(float)
        cost = np.full(len(ids), np.inf)
        start = np.searchsorted(ids, n["idx"])
        cost[start] = 0.0
        for _ in range(len(ids) + 1):
            new = cost.copy()
            np.minimum.at(new, v, cost[u] + c)
            if (new == cost).all():
                break
            cost = new
        else:
            raise ValueError("a cycle of negative cost")
        tight = np.isfinite(cost[u]) & (cost[u] + c == cost[v])
        u, v = u[tight], v[tight]
        hops, level = np.full(len(ids), len(ids) + 1), 0
        hops[start[cost[start] == 0.0]] = 0
        while True:  # levels over the edges of least ways
            new = np.unique(v[(hops[u] == level) & (hops[v] > level + 1)])
            if not len(new):
                break
            level += 1
            hops[new] = level
        via = np.full(len(ids), np.iinfo(np.int64).max)
        down = hops[u] + 1 == hops[v]
        np.minimum.at(via, v[down], ids[u[down]])
        got, none = np.isfinite(cost), via == np.iinfo(np.int64).max
        return pd.DataFrame({"idx": ids, "cost": cost, "via": pd.Series(np.where(none, 0, via), dtype="Int64").mask(none)})[got]

    def loop(sources: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
        start = sources.select(*by, "idx", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("via")).distinct()
        ends = e.select(*by, "src").union(e.select(*by, "dst")).distinct()
        most = (ends.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) + 1
        best, front, done = cut(start), cut(start), 0
        while not front.isEmpty():  # only nodes with a better way send on
            if done > 2 * most:
                raise ValueError("a cycle of negative cost")
            came = e.join(front.select(*by, F.col("idx").alias("src"), "cost", "hops"), [*by, "src"])
            came = came.groupBy(*by, F.col("dst").alias("idx")).agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("via"))).alias("n"))
            met = best.select(*by, "idx", F.struct("cost", "hops", "via").alias("o")).join(came, [*by, "idx"], "full")
            way = lambda s: F.struct(F.col(f"{s}.cost"), F.col(f"{s}.hops"))
            better = F.col("n").isNotNull() & (F.col("o").isNull() | (way("n") < way("o")))
            new = cut(met.select(*by, "idx", F.least("o", "n").alias("b"), better.alias("better")).select(*by, "idx", "b.cost", "b.hops", "b.via", "better"))
            best, front, done = new.drop("better"), new.where("better"), done + 1
        return best

    return solve(sources.select(*by, "idx"), e, by, kernel, "idx BIGINT, cost DOUBLE, via BIGINT", loop)


def least_paths(costs: DataFrame, targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, target, cost, path): the way of least cost to each target, read back over ``via`` of ``shortest_costs``.

    A target that was not reached has a null cost and an empty path. One step of all ways at a time.
    """
    by = list(by)
    known = costs.select(*by, "idx", "cost", "via")
    ways = targets.select(*by, F.col("idx").alias("target")).distinct().join(known.withColumnRenamed("idx", "target"), [*by, "target"], "left")
    path = F.when(F.col("cost").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("target"))
    state = cut(ways.select(*by, "target", "cost", path.alias("path"), F.col("via").alias("at")))
    while not state.where("at is not null").isEmpty():
        up = known.select(*by, F.col("idx").alias("at"), F.col("via").alias("next"))
        state = cut(state.join(up, [*by, "at"], "left").select(*by, "target", "cost", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path"), F.col("next").alias("at")))
    return state.select(*by, "target", "cost", "path")


def greedy_walk(starts: DataFrame, edges: DataFrame, by: Sequence[str] = (), steps: int = 16) -> DataFrame:
    """(by, start, path): from each start always the out-edge of the greatest score, without revisits."""
    by = list(by)
    e = cut(edges.select(*by, "src", "dst", "score"))
    state = starts.select(*by, F.col("idx").alias("start"), F.col("idx").alias("at"), F.array("idx").alias("path"))
    for turn in range(steps):
        ways = state.join(e.withColumnRenamed("src", "at"), [*by, "at"], "left")
        ok = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        pick = ways.groupBy(*by, "start", "path").agg(F.max(F.when(ok, F.struct("score", (-F.col("dst")).alias("d")))).alias("n"))
        to = -F.col("n.d")
        state = pick.select(*by, "start", F.when(F.col("n").isNull(), F.element_at("path", -1)).otherwise(to).alias("at"), F.when(F.col("n").isNull(), F.col("path")).otherwise(F.concat("path", F.array(to))).alias("path"))
        if turn % CHECK == CHECK - 1:
            state = cut(state)
    return state.select(*by, "start", "path")


def random_walk(starts: DataFrame, edges: DataFrame, by: Sequence[str] = (), steps: int = 16, seed: int = 7) -> DataFrame:
    """(by, start, step, at): walks along row-stochastic edges, steps drawn by portable hashes."""
    from pyspark.sql import Window

    from fellscape.functions.scalar import hash_uniform

    by = list(by)
    w = Window.partitionBy(*by, "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    e = cut(edges.where("p > 0").select(*by, "src", "dst", "p").withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p")))
    state = cut(starts.select(*by, F.col("idx").alias("start"), F.lit(0).alias("step"), F.col("idx").alias("at")))
    out = state
    for k in range(1, steps + 1):
        u = hash_uniform(F.lit(seed), "start", F.lit(k))
        met = state.withColumn("u", u).join(e.withColumnRenamed("src", "at"), [*by, "at"], "left").where("dst is null or (u >= lo and u < hi)")
        state = met.select(*by, "start", F.lit(k).alias("step"), F.coalesce("dst", "at").alias("at"))
        if k % CHECK == 0:
            state = cut(state)
        out = out.unionByName(state)
    return out


def weak_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, idx, component): smallest node reached over edges in either direction, by label spreading with shortcuts until nothing changes."""

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, u, v, _ = coded(n, e)
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                return pd.DataFrame({"idx": ids, "component": ids[label]})
            label = new

    def loop(nodes: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
        two = cut(e.where("src <> dst").select(*by, F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct())
        state = cut(nodes.withColumn("component", F.col("idx")))
        while True:
            near = two.join(state.select(*by, F.col("idx").alias("dst"), "component"), [*by, "dst"]).groupBy(*by, F.col("src").alias("idx")).agg(F.min("component").alias("c"))
            low = state.join(near, [*by, "idx"], "left").select(*by, "idx", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
            jump = low.select(*by, F.col("idx").alias("component"), F.col("component").alias("c2"))
            new = cut(low.join(jump, [*by, "component"], "left").select(*by, "idx", "old", F.coalesce("c2", "component").alias("component")))
            state = new.drop("old")
            if new.where("component <> old").isEmpty():
                return state

    nodes = edges.select(*by, F.explode(F.array("src", "dst")).alias("idx")).distinct()
    return solve(nodes, edges.select(*by, "src", "dst"), by, kernel, "idx BIGINT, component BIGINT", loop)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): nodes reached from each start along directed edges, the start included; until no new one comes."""
    e = cut(edges.select("source", "target").distinct())
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    front = seen
    while not front.isEmpty():
        new = front.join(e, front.node == e.source).select("start", F.col("target").alias("node")).distinct()
        front = cut(new.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen
