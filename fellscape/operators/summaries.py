"""Small summaries, comparisons and evidence rules over node, edge and observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import TINY, clip, finite, hash_uniform
from fellscape.operators.fixpoint import reachable
from fellscape.operators.stats import ordinal_rank


def landscape_score(ends: DataFrame, nodes: DataFrame, by: Sequence[str] = (), basin: str = "label") -> DataFrame:
    """0.45 downhill share + 0.40 mean alignment + 0.15 min(1, basins / sqrt(nodes)) (fixed weights)."""
    by = list(by)
    down = ends.groupBy(*by).agg(F.avg((F.col("b_energy") <= F.col("a_energy")).cast("double")).alias("d"), F.avg("alignment").alias("a"))
    size = nodes.groupBy(*by).agg(F.count_distinct(basin).alias("k"), F.count("*").alias("n"))
    met = down.join(size, by) if by else down.crossJoin(size)
    return met.select(*by, (0.45 * F.col("d") + 0.40 * F.col("a") + 0.15 * F.least(F.lit(1.0), F.col("k") / F.sqrt("n"))).alias("score"))


def compare_landscapes(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = (), value: str = "energy") -> DataFrame:
    """(by, n, pearson, rmse, shift) of two landscapes on the nodes they share; 0 for constants."""
    met = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), list(keys))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    d = F.col("y") - F.col("x")
    return met.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("x", "y") / spread).otherwise(0.0).alias("pearson"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("shift"))


def compare_energy_methods(truth: DataFrame, methods: DataFrame, key: str, low_share: float = 0.1) -> DataFrame:
    """(method, n, mae, rho, recall): error, ordinal rank correlation and recall of the lowest energies.

    ``truth``: key, energy; ``methods``: key, method, energy.
    """
    met = methods.select(key, "method", F.col("energy").alias("e")).join(truth.select(key, F.col("energy").alias("t")), key)
    w = Window.partitionBy("method")
    n = F.count("*").over(w)
    r = met.withColumn("re", ordinal_rank("e", key, ["method"])).withColumn("rt", ordinal_rank("t", key, ["method"])).withColumn("k", F.ceil(low_share * n)).withColumn("n", n)
    c = F.max("n").cast("double")
    d = (F.col("re") - F.col("rt")).cast("double")
    both = ((F.col("re") <= F.col("k")) & (F.col("rt") <= F.col("k"))).cast("double")
    return r.groupBy("method").agg(F.max("n").alias("n"), F.avg(F.abs(F.col("e") - F.col("t"))).alias("mae"), F.when(c < 2, 0.0).otherwise(1 - 6 * F.sum(d * d) / (c * (c * c - 1))).alias("rho"), (F.sum(both) / F.max("k")).alias("recall"))


def adaptive_temperature(nodes: DataFrame, by: Sequence[str], acceptance: float, value: str = "energy") -> DataFrame:
    """max(1e-6, deviation * (1 - acceptance / 2)), acceptance within [0, 1]."""
    a = min(1.0, max(0.0, acceptance))
    return nodes.groupBy(*by).agg(F.greatest(F.lit(1e-6), F.coalesce(F.stddev_samp(value), F.lit(0.0)) * (1 - 0.5 * a)).alias("temperature"))


def growth_weights(genes: DataFrame, key: str, birth: Sequence[int], death: Sequence[int]) -> DataFrame:
    """(key, weight): exp of birth minus death marker means, the exponent within +-5; no markers count as 0."""
    mean = lambda gs: F.coalesce(F.avg(F.when(F.col("gene").isin(list(gs)), F.col("value"))), F.lit(0.0))
    return genes.groupBy(key).agg(F.exp(clip(mean(birth) - mean(death), -5.0, 5.0)).alias("weight"))


def percentile_band(genes: DataFrame) -> DataFrame:
    """(gene, p05, p50, p95, width) across cells."""
    p = genes.groupBy("gene").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    return p.select("gene", F.col("p")[0].alias("p05"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), (F.col("p")[2] - F.col("p")[0]).alias("width"))


def work_profile(edges: DataFrame, by: Sequence[str], temperature: float = 1.0) -> DataFrame:
    """(by, energy, ess): soft minimum of works by Boltzmann weights, shifted by the least work."""
    low = edges.groupBy(*by).agg(F.min("work").alias("m"))
    w = F.exp(-(F.col("work") - F.col("m")) / temperature)
    return edges.join(low, list(by)).groupBy(*by).agg((F.sum(w * F.col("work")) / F.sum(w)).alias("energy"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def irreversibility_score(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(forward - reverse) / max(1, total) of absolute signed work."""
    f, r = F.sum(F.greatest("work", F.lit(0.0))), F.sum(F.greatest(-F.col("work"), F.lit(0.0)))
    return edges.groupBy(*by).agg(((f - r) / F.greatest(F.lit(1.0), f + r)).alias("score"))


def current_split(ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, conservative, rotational, net): parts of the aligned flow that follow, or oppose, the energy's slope."""
    step = F.col("a_energy") - F.col("b_energy")
    size = F.abs("alignment")
    same = F.signum("alignment") == F.signum(step)
    c, r = F.sum(F.when(same, size).otherwise(0.0)), F.sum(F.when(same, 0.0).otherwise(size))
    return ends.groupBy(*by).agg(c.alias("conservative"), r.alias("rotational"), F.sum("alignment").alias("net"))


def perturbation_response(nodes: DataFrame, by: Sequence[str], strength: float, weight: str, energy: str = "energy") -> DataFrame:
    """(by, delta, rank): mean change of energy when F becomes F - strength * weight, ranked by size."""
    d = nodes.groupBy(*by).agg(F.avg(-strength * F.col(weight)).alias("delta"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(F.desc(F.abs("delta")), by[-1])))


def adjacent_changes(scan: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows of a scan at which a value differs from the row before."""
    return scan.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(order))).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def path_action(path: DataFrame, by: Sequence[str], order: str, dims: Sequence[str], drift: Sequence[str], dt: float, diffusion: float) -> DataFrame:
    """(by, steps, action): Onsager-Machlup action of paths, sum |dx/dt - drift|^2 dt / (4 D)."""
    w = Window.partitionBy(*by).orderBy(order)
    off = F.lit(0.0)
    for x, v in zip(dims, drift):
        off = off + ((F.lead(x).over(w) - F.col(x)) / dt - F.col(v)) ** 2
    return path.withColumn("_o", off).where("_o is not null").groupBy(*by).agg(F.count("*").alias("steps"), (F.sum("_o") * dt / (4 * max(diffusion, TINY))).alias("action"))


def paired_methods(rows: DataFrame, key: str, a: str, b: str, truth: str, replicates: int, seed: int = 19) -> DataFrame:
    """One row: difference of mean absolute errors of two predictors, label swap test, winner by sign."""
    d = F.abs(F.col(a) - F.col(truth)) - F.abs(F.col(b) - F.col(truth))
    clean = rows.where(finite(a) & finite(b) & finite(truth)).select(d.alias("d"), F.col(key).alias("k"))
    seen = clean.agg(F.avg("d").alias("observed"))
    reps = clean.select("d", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    null = reps.groupBy("rep").agg(F.avg(F.when(hash_uniform(F.lit(seed), "rep", "k") < 0.5, -F.col("d")).otherwise(F.col("d"))).alias("x")).crossJoin(seen)  # one row
    out = null.groupBy("observed").agg(((F.sum((F.abs("x") >= F.abs("observed") - 1e-12).cast("int")) + 1) / (F.count("*") + 1.0)).alias("p_value"))
    return out.withColumn("winner", F.when(F.col("observed") < 0, a).when(F.col("observed") > 0, b).otherwise("tie"))


def participation_dimension(covariance: DataFrame) -> DataFrame:
    """(trace of C)^2 / trace of C^2 of a covariance table (a <= b, cov)."""
    tr = F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(0.0))
    sq = F.sum(F.col("cov") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0))
    return covariance.agg(F.when(sq > 0, tr * tr / sq).otherwise(0.0).alias("dimension"))


def evidence_blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, blocker): dangling edges, claims without parents, strong claims without a measured ancestor.

    ``nodes``: node_id, kind, status (the first of an id stands); ``edges``: source, target.
    """
    first = nodes.groupBy("node_id").agg(F.min_by(F.struct("kind", "status"), F.struct("kind", "status")).alias("n")).select("node_id", "n.kind", "n.status")
    ids = first.select("node_id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    dangling = ends.join(ids, "node_id", "left_anti").withColumn("blocker", F.lit("dangling_edge"))
    claims = first.where("kind = 'claim'")
    alone = claims.join(edges.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", F.lit("claim_without_parent").alias("blocker"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    strong = claims.where("status = 'strong'").select(F.col("node_id").alias("node"))
    up = reachable(back, strong).join(first.where("kind = 'measurement'").select(F.col("node_id").alias("node")), "node").select(F.col("start").alias("node_id")).distinct()
    unmeasured = strong.select(F.col("node").alias("node_id")).join(up, "node_id", "left_anti").withColumn("blocker", F.lit("unmeasured_claim"))
    return dangling.unionByName(alone).unionByName(unmeasured)


def diagnose(values: DataFrame, key: str, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, status): worst of good, warning, critical; a rule holds the two least values that still are good and warning.

    A missing value is critical.
    """
    level = None
    for column, (good, warn) in rules.items():
        one = F.when(F.col(column) >= good, 0).when(F.col(column) >= warn, 1).otherwise(2)
        level = one if level is None else F.greatest(level, one)
    return values.select(key, F.element_at(F.array(F.lit("good"), F.lit("warning"), F.lit("critical")), level + 1).alias("status"))
