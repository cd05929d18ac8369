"""Aggregations of edge expressions to nodes and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import TINY, clip, dot, norm
from fellscape.operators.edges import vec


def local_density(knn: DataFrame, bandwidth: float = 0.65) -> DataFrame:
    """(idx, density): (1 + sum of Gaussian weights) / (1 + neighbours)."""
    weight = F.exp(-(F.col("dist") * F.col("dist")) / (2 * bandwidth * bandwidth))
    return knn.groupBy(F.col("src").alias("idx")).agg(((1 + F.sum(weight)) / (1 + F.count("*"))).alias("density"))


def local_diffusion(ends: DataFrame, n: int, floor: float = 1e-6) -> DataFrame:
    """(idx, diffusion): mean over dimensions of the sample variance of neighbours' velocities, floored."""
    parts = [F.coalesce(F.var_samp(f"b_v{i}"), F.lit(0.0)) for i in range(n)]
    mean = parts[0]
    for p in parts[1:]:
        mean = mean + p
    return ends.groupBy(F.col("src").alias("idx")).agg(F.greatest(mean / n, F.lit(floor)).alias("diffusion"))


def velocity_residuals(ends: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(idx, r0..): velocity minus the mean of the neighbours' velocities (own velocity without neighbours)."""
    means = ends.groupBy(F.col("src").alias("idx")).agg(*[F.avg(f"b_v{i}").alias(f"m{i}") for i in range(n)])
    return nodes.join(means, "idx", "left").select("idx", *[(F.col(f"v{i}") - F.coalesce(f"m{i}", F.lit(0.0))).alias(f"r{i}") for i in range(n)])


def diffusion_trace(residuals: DataFrame, n: int, floor: float = 1e-6) -> DataFrame:
    """(idx, trace): dimensions times the mean squared residual, floored per dimension."""
    return residuals.select("idx", (n * F.greatest(F.lit(floor), dot(vec("r", n), vec("r", n)) / n)).alias("trace"))


def local_current(ends: DataFrame, n: int) -> DataFrame:
    """(idx, current): mean over neighbours of drift flux minus diffusive flux."""
    length = norm(vec("dx", n))
    drift = F.when(length > 0, dot(vec("a_v", n), vec("dx", n)) / length).otherwise(0.0) * F.col("a_density")
    spread = F.when(length > 0, F.col("a_diffusion") * (F.col("b_density") - F.col("a_density")) / length).otherwise(0.0)
    return ends.groupBy(F.col("src").alias("idx")).agg(F.avg(drift - spread).alias("current"))


def divergence(ends: DataFrame, n: int, bandwidth: float = 0.65) -> DataFrame:
    """(idx, divergence): kernel-weighted mean of velocity change per squared length.

    Steps of no length add nothing to the sum but count in the weights.
    """
    d2 = dot(vec("dx", n), vec("dx", n))
    change = F.lit(0.0)
    for i in range(n):
        change = change + (F.col(f"b_v{i}") - F.col(f"a_v{i}")) * F.col(f"dx{i}")
    w = F.exp(-d2 / (2 * bandwidth * bandwidth))
    term = F.when(d2 > TINY, w * change / d2).otherwise(0.0)
    return ends.groupBy(F.col("src").alias("idx")).agg((F.sum(term) / F.greatest(F.sum(w), F.lit(TINY))).alias("divergence"))


def divergence_summary(per_node: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: mean, population spread, shares of either sign, density-weighted mean, signal to noise."""
    x = per_node.join(nodes.select("idx", "density"), "idx")
    mean, sd = F.avg("divergence"), F.stddev_pop("divergence")
    return x.agg(
        mean.alias("mean"), sd.alias("spread"), F.avg((F.col("divergence") > 0).cast("double")).alias("positive"), F.avg((F.col("divergence") < 0).cast("double")).alias("negative"),
        (F.sum(F.col("divergence") * F.col("density")) / F.greatest(F.sum("density"), F.lit(TINY))).alias("weighted_mean"),
        F.when(sd > 0, F.abs(mean) / sd).otherwise(0.0).alias("signal"),
    )


def gradient_alignment(ends: DataFrame, n: int, bandwidth: float = 0.65, energy: str = "energy") -> DataFrame:
    """(idx, alignment): cosine of the velocity and the downhill kernel gradient of the energy."""
    d2 = dot(vec("dx", n), vec("dx", n))
    w = F.exp(-d2 / (2 * bandwidth * bandwidth))
    slope = (F.col(f"b_{energy}") - F.col(f"a_{energy}")) / F.greatest(d2, F.lit(TINY))
    sums = [F.sum(F.when(d2 > TINY, w * slope * F.col(f"dx{i}")).otherwise(0.0)).alias(f"g{i}") for i in range(n)]
    grad = ends.groupBy(F.col("src").alias("idx"), *[F.col(f"a_v{i}") for i in range(n)]).agg(F.greatest(F.sum(w), F.lit(TINY)).alias("w"), *sums)
    size = norm(vec("g", n)) * norm(vec("a_v", n))
    return grad.select("idx", F.when(size > 0, -dot(vec("g", n), vec("a_v", n)) / size).otherwise(0.0).alias("alignment"))


def pair_fluxes(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), floor: float = 1e-12) -> DataFrame:
    """Forward and backward rates of every unordered pair, and its entropy production.

    ``edges``: src, dst, work; ``nodes``: idx, density. Stationary weights are densities over
    their sum (at least 1e-15); works are scaled by max(1, 1.4826 * MAD); a missing direction has
    the work of the other with opposite sign.
    """
    by = list(by)
    mass = nodes.groupBy(*by).agg(F.sum("density").alias("mass"))
    p = nodes.join(mass, by) if by else nodes.crossJoin(mass)
    p = p.select(*by, F.col("idx"), F.greatest(F.col("density") / F.greatest(F.col("mass"), F.lit(1e-300)), F.lit(1e-15)).alias("p"))
    way = F.when(F.col("src") < F.col("dst"), F.col("work"))
    back = F.when(F.col("src") > F.col("dst"), F.col("work"))
    both = (
        edges.where("src <> dst")
        .groupBy(*by, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
        .agg(F.avg(way).alias("f"), F.avg(back).alias("b"))
        .select(*by, "i", "j", F.coalesce("f", -F.col("b")).alias("wf"), F.coalesce("b", -F.col("f")).alias("wb"))
    )
    works = both.select(*by, F.explode(F.array("wf", "wb")).alias("w"))
    mid = works.groupBy(*by).agg(F.percentile("w", 0.5).alias("mid"))
    spread = (works.join(mid, by) if by else works.crossJoin(mid)).groupBy(*by).agg(F.greatest(F.lit(1.0), 1.4826 * F.percentile(F.abs(F.col("w") - F.col("mid")), 0.5)).alias("scale"))
    both = both.join(spread, by) if by else both.crossJoin(spread)
    pi, pj = p.withColumnsRenamed({"idx": "i", "p": "pi"}), p.withColumnsRenamed({"idx": "j", "p": "pj"})
    rate = lambda w: F.greatest(F.lit(floor), F.exp(-clip(w / F.col("scale"), -30.0, 30.0)))
    return (
        both.join(pi, [*by, "i"]).join(pj, [*by, "j"])
        .withColumn("forward", F.col("pi") * rate(F.col("wf")))
        .withColumn("backward", F.col("pj") * rate(F.col("wb")))
        .withColumn("contribution", (F.col("forward") - F.col("backward")) * F.log(F.greatest(F.col("forward") / F.col("backward"), F.lit(TINY))))
        .select(*by, "i", "j", "forward", "backward", "contribution")
    )


def entropy_production(fluxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half the sum of the pairs' contributions."""
    return fluxes.groupBy(*by).agg((0.5 * F.sum("contribution")).alias("rate"), F.count("*").alias("pairs"))


def stationarity_residual(fluxes: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root mean square over all nodes of the net flux; nodes without a pair count as 0."""
    net = F.col("forward") - F.col("backward")
    ends = fluxes.select(*by, F.inline(F.array(F.struct(F.col("i").alias("idx"), (-net).alias("x")), F.struct(F.col("j").alias("idx"), net.alias("x")))))
    per = ends.groupBy(*by, "idx").agg(F.sum("x").alias("x")).groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    count = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    met = count.join(per, list(by), "left") if by else count.crossJoin(per)
    return met.select(*by, F.sqrt(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("residual"))


def basin_statistics(nodes: DataFrame, by: Sequence[str], energy: str = "energy", speed: str = "speed") -> DataFrame:
    """Size, mean and sample deviation of energy (0 for one node) and mean speed per basin; null speeds count for nothing."""
    return nodes.groupBy(*by).agg(F.count("*").alias("size"), F.avg(energy).alias("energy_mean"), F.coalesce(F.stddev_samp(energy), F.lit(0.0)).alias("energy_spread"), F.avg(speed).alias("velocity_mean"))


def flux_matrix(ends: DataFrame, by: Sequence[str] = (), temperature: float = 1.0, label: str = "label") -> DataFrame:
    """Sum of exp(-max(0, work) / T) between differing basins."""
    weight = F.exp(-F.greatest(F.lit(0.0), F.col("work")) / temperature)
    return ends.where(F.col(f"a_{label}") != F.col(f"b_{label}")).groupBy(*by, F.col(f"a_{label}").alias("from_basin"), F.col(f"b_{label}").alias("to_basin")).agg(F.sum(weight).alias("flux"))


def work_summary(edges: DataFrame, by: Sequence[str] = (), temperature: float = 1.0) -> DataFrame:
    """Mean, variance, range, effective sample size of the Boltzmann weights and negative share of work."""
    w = F.exp(clip(-F.col("work") / temperature, -60.0, 60.0))
    return edges.groupBy(*by).agg(
        F.count("work").alias("n"), F.avg("work").alias("mean_work"), F.coalesce(F.var_samp("work"), F.lit(0.0)).alias("var_work"), F.min("work").alias("min_work"), F.max("work").alias("max_work"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), F.avg((F.col("work") < 0).cast("double")).alias("negative_share"),
    )


def jarzynski(works: DataFrame, by: Sequence[str], temperature: float = 1.0) -> DataFrame:
    """Free energy -T ln <exp(-W/T)> by max-shifted log-mean-exp, with cumulants, dissipation, ESS and a stability flag.

    A group is stable if its effective share is at least one half and its works spread by at most 3 T.
    """
    top = works.groupBy(*by).agg(F.max(-F.col("work") / temperature).alias("m"))
    x = -F.col("work") / temperature - F.col("m")
    met = works.join(top, list(by))
    out = met.groupBy(*by, "m").agg(F.count("*").alias("n"), F.sum(F.exp(x)).alias("s"), F.sum(F.exp(2 * x)).alias("s2"), F.avg("work").alias("work_mean"), F.var_pop("work").alias("v"))
    ess, free, spread = F.col("s") * F.col("s") / F.col("s2"), -temperature * (F.col("m") + F.log(F.col("s") / F.col("n"))), F.sqrt("v")
    return out.select(
        *by, "n", free.alias("free_energy"), "work_mean", spread.alias("work_spread"), (F.col("work_mean") - free).alias("dissipation"), (F.col("work_mean") - F.col("v") / (2 * temperature)).alias("cumulant"), ess.alias("ess"),
        F.when((ess / F.col("n") >= 0.5) & (spread <= 3.0 * temperature), "stable").otherwise("high_variance").alias("status"),
    )


def jarzynski_nodes(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), temperature: float = 1.0) -> DataFrame:
    """(by, idx, n, free_energy, ...) of every node from the works of its incoming edges.

    A node without one is ``unsupported``: it keeps its energy, and its other figures are 0.
    """
    by = list(by)
    got = jarzynski(edges, [*by, "dst"], temperature).withColumnRenamed("dst", "idx")
    met = nodes.select(*by, "idx", "energy").join(got, [*by, "idx"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("work_mean", "work_spread", "dissipation")]
    return met.select(
        *by, "idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("free_energy", "energy").alias("free_energy"), *zero, F.coalesce("cumulant", "energy").alias("cumulant"), F.coalesce("ess", F.lit(0.0)).alias("ess"),
        F.coalesce("status", F.lit("unsupported")).alias("status"),
    )


