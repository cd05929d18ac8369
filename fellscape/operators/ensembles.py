"""Replicates and scenarios as a column: one plan runs all of them together.

A replicate is a value of ``rep``; subsets and resamples are drawn by portable hashes of (seed, rep,
key), so no replicate is a loop of its own and any engine draws the same.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import clipped_exp, hash_uniform
from fellscape.operators import fixpoint as X
from fellscape.operators import topology as T
from fellscape.operators.edges import with_ends
from fellscape.operators.stats import average_rank, spearman_ordinal


def _reps(df: DataFrame, count: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def subsets(rows: DataFrame, key: str, count: int, share: float, seed: int = 5) -> DataFrame:
    """Rows of every replicate: each kept with probability ``share``."""
    return _reps(rows, count).where(hash_uniform(F.lit(seed), "rep", key) < share)


def commitment_ensemble(nodes: DataFrame, edges: DataFrame, by: Sequence[str], count: int = 8, share: float = 0.8, steps: int = 256, seed: int = 5) -> DataFrame:
    """(by, rep, idx, q): committors of subsets of the nodes.

    ``nodes``: by, idx, role, energy; ``edges``: by, src, dst. Edges stay where both ends are in
    the subset; all replicates and graphs are iterated together.
    """
    by = list(by)
    kept = subsets(nodes, "idx", count, share, seed)
    ends = with_ends(_reps(edges.select(*by, "src", "dst"), count), kept, ["energy"], [*by, "rep"])
    weight = clipped_exp(-(F.col("b_energy") - F.col("a_energy")), 40.0)
    return X.committor(kept.select(*by, "rep", "idx", "role"), ends.withColumn("weight", weight), [*by, "rep"], steps, None)


def ensemble_summary(q: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, idx, n, mean, sd): pooled commitment of every node over the replicates that hold it."""
    return q.groupBy(*by, "idx").agg(F.count("*").alias("n"), F.avg("q").alias("mean"), F.coalesce(F.stddev_samp("q"), F.lit(0.0)).alias("sd"))


def rank_agreement(q: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rep_a, rep_b, n, rho): rank correlation of two replicates on the nodes they share; NaN-free, 0 for constants."""
    by = list(by)
    a = q.select(*by, "idx", F.col("rep").alias("rep_a"), F.col("q").alias("qa"))
    b = q.select(*by, "idx", F.col("rep").alias("rep_b"), F.col("q").alias("qb"))
    met = a.join(b, [*by, "idx"]).where("rep_a < rep_b")
    pair = [*by, "rep_a", "rep_b"]
    r = met.withColumn("x", average_rank("qa", pair)).withColumn("y", average_rank("qb", pair))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return r.groupBy(*pair).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("x", "y") / spread).otherwise(0.0).alias("rho"))


def bootstrap_energy(sources: DataFrame, edges: DataFrame, graph: str, count: int = 8, share: float = 0.8, seed: int = 6) -> DataFrame:
    """(graph, idx, n, sd): spread of propagated energies when every edge is kept with probability ``share``."""
    kept = _reps(edges, count).where(hash_uniform(F.lit(seed), "rep", "src", "dst") < share)
    tag = F.concat_ws("\t", F.col(graph).cast("string"), F.col("rep").cast("string"))
    energy = T.propagate_energy(_reps(sources, count).withColumn("_g", tag), kept.withColumn("_g", tag), "_g")
    name = F.split("_g", "\t")[0].alias(graph)
    return energy.where("reached").groupBy(name, "idx").agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("energy"), F.lit(0.0)).alias("sd"))


def resolved_barrier(q: DataFrame, by: Sequence[str], count: int = 20, points: int = 60, bandwidth: float = 0.08, seed: int = 8) -> DataFrame:
    """(by, raw, corrected, standard_error): barrier of the commitment profile, 2 raw - mean of bootstraps.

    Replicate 0 has every node once; in the others a node counts as often as a Poisson(1) number
    of its hash. Nodes are counted in 2^-10 wide bins first. The barrier is the greatest free
    energy between the 5 % and 95 % points of the grid.
    """
    by = list(by)
    u = hash_uniform(F.lit(seed), "rep", "idx")
    times = F.lit(0)
    total = 0.0
    for k in range(6):  # Poisson(1) by its distribution function
        total += float(np.exp(-1.0) / np.prod(np.arange(1, k + 1)))
        times = times + (u >= total).cast("int")
    rows = _reps(q.select(*by, "idx", "q"), count + 1).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(times)).where("w > 0")
    binned = rows.groupBy(*by, "rep", F.round(F.col("q") * 1024).alias("b")).agg(F.sum("w").alias("n"))
    grid = binned.select(*by, "rep", (F.col("b") / 1024.0).alias("m"), "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("at"))
    x = F.col("at") / float(points - 1)
    k = lambda m: F.exp(-((x - m) ** 2) / (2 * bandwidth**2))
    mass = F.sum(F.col("n") * (k(F.col("m")) + k(-F.col("m")) + k(2 - F.col("m")))) / F.sum("n")
    f = grid.groupBy(*by, "rep", "at").agg((-F.log(F.greatest(mass, F.lit(1e-12)))).alias("f"))
    lo, hi = int(0.05 * (points - 1)), int(0.95 * (points - 1))
    top = f.groupBy(*by, "rep").agg((F.max(F.when(F.col("at").between(lo, hi), F.col("f"))) - F.min("f")).alias("barrier"))
    raw, boot = F.max(F.when(F.col("rep") == 0, F.col("barrier"))), F.avg(F.when(F.col("rep") > 0, F.col("barrier")))
    return top.groupBy(*by).agg(raw.alias("raw"), (2 * raw - boot).alias("corrected"), F.coalesce(F.stddev_samp(F.when(F.col("rep") > 0, F.col("barrier"))), F.lit(0.0)).alias("standard_error"))


def robustness(nodes: DataFrame, edges: DataFrame, by: Sequence[str], temperatures: Sequence[float], steps: int = 256) -> DataFrame:
    """(by, scenario, n, rho, verdict): commitment under other temperatures against the first, by ordinal ranks.

    Verdicts by fixed thresholds: stable from 0.70, mixed from 0.35, else fragile.
    """
    by = list(by)
    scen = F.explode(F.array(*[F.struct(F.lit(i).alias("rep"), F.lit(float(t)).alias("t")) for i, t in enumerate(temperatures)]))
    all_nodes = nodes.withColumn("s", scen).select(*nodes.columns, "s.rep")
    ends = with_ends(edges.select(*by, "src", "dst"), nodes, ["energy"], by).withColumn("s", scen)
    weight = clipped_exp(-(F.col("b_energy") - F.col("a_energy")) / F.col("s.t"), 40.0)
    q = X.committor(all_nodes.select(*by, "rep", "idx", "role"), ends.withColumn("rep", F.col("s.rep")).withColumn("weight", weight), [*by, "rep"], steps, None)
    base = q.where("rep = 0").select(*by, "idx", F.col("q").alias("base"))
    met = q.where("rep > 0").join(base, [*by, "idx"]).withColumnRenamed("rep", "scenario")
    rho = spearman_ordinal(met.withColumn("q", F.round("q", 9)).withColumn("base", F.round("base", 9)), "base", "q", "idx", [*by, "scenario"])
    return rho.withColumn("verdict", F.when(F.col("rho") >= 0.70, "stable").when(F.col("rho") >= 0.35, "mixed").otherwise("fragile"))


def noise_matched(points: DataFrame, pairs: DataFrame, dims: int, graph: str, count: int = 16, seed: int = 9) -> DataFrame:
    """(graph, observed, null_mean, null_sd, z): cyclic share against potential flows with the data's own noise.

    ``points``: graph, idx, x0.., v0..; ``pairs``: graph, i, j. The potential of the observed flow gives a
    local least-squares gradient (ridge 1e-8) at every point; residual velocities are redrawn from a
    point's neighbours with a random sign. z has a systematic floor of 0.01. Replicates run in
    parallel, one graph and replicate a task.
    """
    xs, vs = [f"x{k}" for k in range(dims)], [f"v{k}" for k in range(dims)]
    none = lambda n, t: [F.lit(None).cast(t).alias(c) for c in n]
    rows = points.select(graph, "idx", *xs, *vs, *none(["i", "j"], "bigint")).unionByName(pairs.select(graph, *none(["idx"], "bigint"), *none([*xs, *vs], "double"), "i", "j"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rep = int(frame["rep"].iloc[0])
        p = frame[frame["idx"].notna()].sort_values("idx")
        ids = p["idx"].to_numpy(np.int64)
        x, v = p[xs].to_numpy(float), p[vs].to_numpy(float)
        e = frame[frame["i"].notna()].sort_values(["i", "j"])
        i, j = (np.searchsorted(ids, e[c].to_numpy(np.int64)) for c in "ij")
        n = len(ids)
        d = x[j] - x[i]
        length = np.linalg.norm(d, axis=1)
        unit = d / np.where(length > 0, length, 1.0)[:, None]

        def share(vel: np.ndarray) -> tuple[float, np.ndarray]:
            f = (0.5 * (vel[i] + vel[j]) * unit).sum(1)
            phi = T.potential(i, j, f, n)
            return float(((f - (phi[j] - phi[i])) ** 2).sum() / ((f**2).sum() + 1e-12)), phi

        observed, phi = share(v)
        if rep == 0:
            return pd.DataFrame({graph: [frame[graph].iloc[0]], "rep": [0], "share": [observed]})
        a, g = np.zeros((n, dims, dims)), np.zeros((n, dims))
        rise = (phi[j] - phi[i]) / np.where(length > 0, length, 1.0)
        outer = unit[:, :, None] * unit[:, None, :]
        for at in (i, j):
            np.add.at(a, at, outer)
            np.add.at(g, at, unit * rise[:, None])
        grad = np.linalg.solve(a + 1e-8 * np.eye(dims), g[:, :, None])[:, :, 0]
        rest = v - grad
        order = np.argsort(np.r_[i, j], kind="stable")
        near, start = np.r_[j, i][order], np.searchsorted(np.r_[i, j][order], np.arange(n + 1))
        rng = np.random.default_rng(seed * 1000 + rep)
        size = np.diff(start)
        pick = np.where(size > 0, near[np.minimum(start[:-1] + (rng.random(n) * size).astype(int), len(near) - 1)], np.arange(n))
        drawn = grad + rest[pick] * rng.choice([-1.0, 1.0], n)[:, None]
        return pd.DataFrame({graph: [frame[graph].iloc[0]], "rep": [rep], "share": [share(drawn)[0]]})

    kind = points.schema[graph].dataType.simpleString()
    out = _reps(rows, count + 1).groupBy(graph, "rep").applyInPandas(run, f"`{graph}` {kind}, rep INT, share DOUBLE")
    null = F.when(F.col("rep") > 0, F.col("share"))
    t = out.groupBy(graph).agg(F.max(F.when(F.col("rep") == 0, F.col("share"))).alias("observed"), F.avg(null).alias("null_mean"), F.coalesce(F.stddev_samp(null), F.lit(0.0)).alias("null_sd"))
    return t.withColumn("z", (F.col("observed") - F.col("null_mean")) / F.sqrt(F.col("null_sd") * F.col("null_sd") + 0.01 * 0.01))


def fate_prototypes(points: DataFrame, dims: Sequence[str], label: str = "label", scale: float = 1.0) -> DataFrame:
    """(idx, fate, probability, entropy): softmax of minus scaled distances to the labels' centroids; the most likely fate.

    Centroids are one row per label; the table of labels must be small (a vocabulary).
    """
    c = points.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("fate")).agg(*[F.avg(d).alias(f"c_{d}") for d in dims])
    gap = F.lit(0.0)
    for d in dims:
        gap = gap + (F.col(d) - F.col(f"c_{d}")) ** 2
    far = points.select("idx", *dims).crossJoin(c).select("idx", "fate", (-F.sqrt(gap) / scale).alias("s"))
    w = Window.partitionBy("idx")
    p = far.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.groupBy("idx").agg(F.max_by("fate", F.struct(F.round("p", 12), -F.xxhash64("fate"))).alias("fate"), F.max("p").alias("probability"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"))
