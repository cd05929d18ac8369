"""Entropic optimal transport on a cost table or between successive snapshots, and what is read off its plan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.session import cut


def _lse(df: DataFrame, key: str, x) -> DataFrame:
    """(key, l): log-sum-exp of x per key, shifted by the maximum."""
    rows = df.select(key, x.alias("x"))
    top = F.max("x").over(Window.partitionBy(key))
    return rows.withColumn("m", top).groupBy(key, "m").agg((F.col("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("l")).select(key, "l")


def sinkhorn(costs: DataFrame, a: DataFrame, b: DataFrame, epsilon: float = 0.1, steps: int = 50, tolerance: float | None = None, damping: float = 1.0, relax: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, f, g): plan (i, j, cost, p) with its dual potentials.

    ``costs``: i, j, cost; ``a``: i, mass; ``b``: j, mass (both normalized here). One step updates
    f, then g; ``damping`` below 1 mixes the update with the old potential (its fixed point is
    that of the balanced problem). ``relax`` is the price of leaving the marginals in the
    Kullback-Leibler sense (unbalanced transport); None keeps them. With ``tolerance`` the greatest marginal violation is read every
    5 steps.
    """
    total_a, total_b = a.agg(F.sum("mass").alias("t")), b.agg(F.sum("mass").alias("t"))
    la = a.crossJoin(total_a).where("mass > 0").select("i", F.log(F.col("mass") / F.col("t")).alias("la"))  # one-row side
    lb = b.crossJoin(total_b).where("mass > 0").select("j", F.log(F.col("mass") / F.col("t")).alias("lb"))
    c = cut(costs.join(la, "i").join(lb, "j").select("i", "j", "cost", "la", "lb"))
    f = cut(c.select("i").distinct().withColumn("f", F.lit(0.0)))
    g = cut(c.select("j").distinct().withColumn("g", F.lit(0.0)))
    keep = 1.0 if relax is None else relax / (relax + epsilon)
    for k in range(1, steps + 1):
        row = c.join(g, "j")
        new = _lse(row, "i", (F.col("g") - F.col("cost")) / epsilon).join(c.select("i", "la").distinct(), "i")
        f = f.join(new, "i").select("i", (damping * keep * epsilon * (F.col("la") - F.col("l")) + (1 - damping) * F.col("f")).alias("f"))
        col = c.join(f, "i")
        new = _lse(col, "j", (F.col("f") - F.col("cost")) / epsilon).join(c.select("j", "lb").distinct(), "j")
        g = g.join(new, "j").select("j", (damping * keep * epsilon * (F.col("lb") - F.col("l")) + (1 - damping) * F.col("g")).alias("g"))
        f, g = cut(f), cut(g)
        if tolerance is not None and k % 5 == 0:
            p = _plan(c, f, g, epsilon)
            off = p.groupBy("i", "la").agg(F.sum("p").alias("s")).agg(F.max(F.abs(F.col("s") - F.exp("la")))).first()[0]
            if off is None or off <= tolerance:
                break
    return _plan(c, f, g, epsilon).select("i", "j", "cost", "p"), f, g


def _plan(c: DataFrame, f: DataFrame, g: DataFrame, epsilon: float) -> DataFrame:
    return c.join(f, "i").join(g, "j").withColumn("p", F.exp((F.col("f") + F.col("g") - F.col("cost")) / epsilon))


def squared_costs(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    """(i, j, cost): squared Euclidean cost of every source and target.

    The dense table is the definition of the problem; ``b`` should be a bounded set of targets.
    """
    d = F.lit(0.0)
    for x in dims:
        d = d + (F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2
    left = a.select("i", *[F.col(x).alias(f"a_{x}") for x in dims])
    right = b.select("j", *[F.col(x).alias(f"b_{x}") for x in dims])
    return left.crossJoin(right).select("i", "j", d.alias("cost"))


#: Source-target pairs whose costs a task holds at once.
BLOCK_PAIRS = 1 << 21


def _potentials(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray, epsilon: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(f, g, violation): dual potentials over epsilon, with costs made block by block and never kept."""
    f, g = np.zeros(len(x)), np.zeros(len(y))

    def lse(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(a)), max(1, BLOCK_PAIRS // max(1, len(b)))
        for s in range(0, len(a), step):
            z = h[None] - ((a[s : s + step, None] - b[None]) ** 2).sum(2) / epsilon
            top = z.max(1)
            out[s : s + step] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return out

    off = np.inf
    for _ in range(steps):
        rows = lse(x, y, g)
        off = float(np.abs(np.exp(f + rows) - np.exp(la)).max())
        if off <= tolerance:  # columns are exact after their update
            break
        f = la - rows
        g = lb - lse(y, x, f)
    return f, g, off


def snapshot_transport(cells: DataFrame, snapshot: str, dims: Sequence[str], epsilon: float = 0.05, steps: int = 500, tolerance: float = 1e-6, draws: int = 0, t: float = 0.5, seed: int = 1) -> DataFrame:
    """Couples all cells of every two successive snapshots; one transition a task, transitions in parallel.

    ``cells``: the snapshot, idx, mass and ``dims``. Masses are normalized per snapshot, null or zero masses
    take no part; ``epsilon`` is in units of the transition's mean cost. Without ``draws``: (source, target,
    idx, mass, cost, entropy, t_*, violation), the share of the plan of every source and its mean target;
    ``violation`` is the greatest error of a marginal, at most ``tolerance`` unless ``steps`` were too few. With ``draws``:
    (source, target, draw, z_*), positions at time ``t`` of pairs drawn from the plan by hashes.
    """
    import hashlib

    dims = list(dims)
    names = cells.select(snapshot).dropna().distinct()  # a row for each snapshot
    after = F.lead(snapshot).over(Window.orderBy(snapshot))
    steps_of = F.broadcast(names.select(F.col(snapshot).alias("source"), after.alias("target")).where("target is not null"))
    kept = cells.where("mass > 0")
    side = lambda end, k: kept.withColumn(end, F.col(snapshot)).join(steps_of, end).select("source", "target", F.lit(k).alias("_side"), "idx", "mass", *dims)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[frame["_side"] == k].sort_values("idx") for k in (0, 1))
        x, y = (d[dims].to_numpy(float) for d in (a, b))
        pa, pb = (d["mass"].to_numpy(float) / d["mass"].sum() for d in (a, b))
        mean = float(pa @ (x**2).sum(1) + pb @ (y**2).sum(1) - 2 * (pa @ x) @ (pb @ y))
        eps = epsilon * max(mean, 1e-300)
        f, g, off = _potentials(x, y, np.log(pa), np.log(pb), eps, steps, tolerance)
        n, step = len(x), max(1, BLOCK_PAIRS // max(1, len(y)))
        mass, cost, entropy, mapped = np.empty(n), np.empty(n), np.empty(n), np.empty((n, len(dims)))

        def plan(s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
            c = ((x[s:e, None] - y[None]) ** 2).sum(2)
            return np.exp(f[s:e, None] + g[None] - c / eps), c

        for s in range(0, n, step):
            p, c = plan(s, s + step)
            e = slice(s, s + step)
            mass[e], cost[e] = p.sum(1), (p * c).sum(1)
            entropy[e] = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
            mapped[e] = (p @ y) / np.maximum(mass[e], 1e-300)[:, None]
        if not draws:
            out = pd.DataFrame({"idx": a["idx"].to_numpy(), "mass": mass, "cost": cost, "entropy": entropy}).assign(**{f"t_{d}": mapped[:, k] for k, d in enumerate(dims)}, violation=off)
        else:
            u = np.array([int(hashlib.md5(f"{seed}:{key[0]}:{k}".encode()).hexdigest()[:8], 16) / 2.0**32 for k in range(draws)])
            upto = np.cumsum(mass)
            at = np.minimum(np.searchsorted(upto, u * upto[-1], side="right"), n - 1)
            z = np.empty((draws, len(dims)))
            for k, i in enumerate(at):
                run_ = np.cumsum(plan(i, i + 1)[0][0])
                j = min(int(np.searchsorted(run_, u[k] * upto[-1] - (upto[i] - mass[i]), side="right")), len(y) - 1)
                z[k] = (1 - t) * x[i] + t * y[j]
            out = pd.DataFrame({"draw": np.arange(draws)}).assign(**{f"z_{d}": z[:, k] for k, d in enumerate(dims)})
        out.insert(0, "target", key[1])
        out.insert(0, "source", key[0])
        return out

    kind = cells.schema[snapshot].dataType.simpleString()
    rest = "draw BIGINT, " + ", ".join(f"z_{d} DOUBLE" for d in dims) if draws else "idx BIGINT, mass DOUBLE, cost DOUBLE, entropy DOUBLE, " + ", ".join(f"t_{d} DOUBLE" for d in dims) + ", violation DOUBLE"
    rows = side("source", 0).unionByName(side("target", 1))
    return rows.groupBy("source", "target").applyInPandas(run, f"source {kind}, target {kind}, {rest}")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Transport cost, entropy of the plan and its mass."""
    p = F.col("p")
    return plan.agg(F.sum(p * F.col("cost")).alias("cost"), (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"), F.sum(p).alias("mass"))


def barycentric_map(plan: DataFrame, targets: DataFrame, dims: list[str]) -> DataFrame:
    """(i, t_*): mean target position of each source, weighted by the plan's row."""
    met = plan.join(targets.select("j", *dims), "j")
    return met.groupBy("i").agg(*[(F.sum(F.col("p") * F.col(x)) / F.sum("p")).alias(f"t_{x}") for x in dims])


def implied_velocity(mapped: DataFrame, sources: DataFrame, dims: list[str], dt: float) -> DataFrame:
    """(i, u_*): displacement to the mapped position per time."""
    return mapped.join(sources.select("i", *dims), "i").select("i", *[((F.col(f"t_{x}") - F.col(x)) / dt).alias(f"u_{x}") for x in dims])


def displaced(plan: DataFrame, sources: DataFrame, targets: DataFrame, dims: list[str], t: float, draws: int, seed: int = 1) -> DataFrame:
    """(draw, z_*): positions at time t of pairs drawn from the plan by inverse distribution over (i, j).

    Draws are hash-uniform numbers; ranges of the running sum are met by a bucketed range join.
    """
    from fellscape.functions.scalar import hash_uniform

    buckets = 256
    per_row = plan.groupBy("i").agg(F.sum("p").alias("m"))
    over = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row a source
    first = per_row.withColumn("upto", F.sum("m").over(over)).select("i", (F.col("upto") - F.col("m")).alias("base"))
    inner = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    total = per_row.agg(F.sum("m").alias("total"))
    runs = plan.join(first, "i").crossJoin(total).withColumn("hi", (F.col("base") + F.sum("p").over(inner)) / F.col("total"))
    runs = runs.withColumn("lo", F.col("hi") - F.col("p") / F.col("total")).where("hi > lo")
    spread = F.explode(F.sequence(F.floor(F.col("lo") * buckets).cast("int"), F.floor(F.col("hi") * buckets).cast("int")))
    u = plan.sparkSession.range(draws).select(F.col("id").alias("draw"), hash_uniform(F.lit(seed), "id").alias("u"))
    u = u.withColumn("bucket", F.floor(F.col("u") * buckets).cast("int"))
    hit = u.join(runs.withColumn("bucket", spread).select("bucket", "i", "j", "lo", "hi"), "bucket").where("u >= lo and u < hi")
    met = hit.join(sources.select("i", *[F.col(x).alias(f"s_{x}") for x in dims]), "i").join(targets.select("j", *[F.col(x).alias(f"e_{x}") for x in dims]), "j")
    return met.select("draw", *[((1 - t) * F.col(f"s_{x}") + t * F.col(f"e_{x}")).alias(f"z_{x}") for x in dims])
