"""Per-edge expressions over node and edge tables.

``nodes``: ``idx`` and per-node columns; vectors are columns x0.. and v0... ``edges``: ``src``,
``dst`` and per-edge columns. Every operator is a projection after two equi-joins (``with_ends``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import TINY, clipped_exp, cosine, dot, norm, safe_log


def vec(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], by: Sequence[str] = (), key: str = "idx", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with the columns of both ends as ``a_*`` and ``b_*``; edges with an unknown end drop out."""
    a = nodes.select(*by, F.col(key).alias(src), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = nodes.select(*by, F.col(key).alias(dst), *[F.col(c).alias(f"b_{c}") for c in columns])
    return edges.join(a, [*by, src]).join(b, [*by, dst])


def with_displacement(ends: DataFrame, n: int) -> DataFrame:
    """Columns dx0.. = position of dst minus position of src."""
    return ends.withColumns({f"dx{i}": F.col(f"b_x{i}") - F.col(f"a_x{i}") for i in range(n)})


def velocity_alignment(ends: DataFrame, n: int) -> DataFrame:
    """Cosine of the source's velocity and the displacement (0 where either is 0)."""
    return ends.withColumn("alignment", cosine(vec("a_v", n), vec("dx", n)))


def directed_edges(ends: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges along the velocity: alignment at or above the threshold."""
    return ends.where(F.col("alignment") >= threshold)


def edge_work(ends: DataFrame, n: int, temperature: float = 1.0, velocity_scale: float = 1.0) -> DataFrame:
    """Work of a step: density, drift and diffusion terms in units of the temperature."""
    ratio = F.greatest("b_density", F.lit(TINY)) / F.greatest("a_density", F.lit(TINY))
    drift = dot(vec("a_v", n), vec("dx", n))
    spread = dot(vec("dx", n), vec("dx", n)) / F.greatest("a_diffusion", F.lit(TINY))
    work = (-temperature * F.log(ratio) - velocity_scale * drift + 0.5 * spread) / max(temperature, TINY)
    return ends.withColumn("work", work)


def barrier_heights(ends: DataFrame, energy: str = "energy") -> DataFrame:
    """Climb in energy along each edge, at least 0."""
    return ends.withColumn("barrier", F.greatest(F.lit(0.0), F.col(f"b_{energy}") - F.col(f"a_{energy}")))


def path_samples(edges: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Split of each work value into drift, density and noise, and its Boltzmann weight (exponent within +-60)."""
    w, a = F.col("work"), F.col("alignment")
    return edges.withColumns({
        "drift": w * a, "density_part": w * (1 - a), "noise": F.greatest(F.lit(0.0), w * w / temperature), "weight": clipped_exp(-w / temperature, 60.0),
    })


def transition_observables(ends: DataFrame, n: int) -> DataFrame:
    """Displacement, projection on it, transverse speed, signed work and activity of each step."""
    length, speed2 = norm(vec("dx", n)), dot(vec("a_v", n), vec("a_v", n))
    along = F.when(length > 0, dot(vec("a_v", n), vec("dx", n)) / length).otherwise(0.0)
    return ends.withColumns({
        "displacement": length, "projection": along, "transverse": F.sqrt(F.greatest(F.lit(0.0), speed2 - along * along)),
        "signed_work": -dot(vec("a_v", n), vec("dx", n)), "activity": speed2 / F.greatest(2 * F.col("a_diffusion"), F.lit(TINY)),
    })


def reactive_flux(ends: DataFrame, temperature: float = 1.0, energy: str = "energy", q: str = "q") -> DataFrame:
    """Boltzmann weight of the climb times the gain in commitment."""
    climb = (F.col(f"b_{energy}") - F.col(f"a_{energy}")) / temperature
    return ends.withColumn("flux", clipped_exp(-climb, 40.0) * F.greatest(F.lit(0.0), F.col(f"b_{q}") - F.col(f"a_{q}")))


def edge_current(ends: DataFrame, energy: str = "energy") -> DataFrame:
    """Difference of forward and backward Boltzmann factors times the alignment."""
    d = F.col(f"b_{energy}") - F.col(f"a_{energy}")
    return ends.withColumn("current", (clipped_exp(-d, 50.0) - clipped_exp(d, 50.0)) * F.col("alignment"))


def counterfactual_alignment(edges: DataFrame, target: int, damping: float) -> DataFrame:
    """Alignment damped on edges that touch the target node."""
    touched = (F.col("src") == target) | (F.col("dst") == target)
    return edges.withColumn("alignment_cf", F.when(touched, F.col("alignment") * damping).otherwise(F.col("alignment")))


def lineage_link_scores(ends: DataFrame, n: int) -> DataFrame:
    """Cosine on declared links and its logistic score."""
    c = cosine(vec("a_v", n), vec("dx", n))
    return ends.withColumn("link_cosine", c).withColumn("link_score", 1 / (1 + F.exp(-4 * F.col("link_cosine"))))


def intervention_scores(ends: DataFrame, energy: str = "energy") -> DataFrame:
    """Energy drop (negative uphill) weighted by alignment and closeness; uphill and flat steps are controls."""
    drop = F.col(f"a_{energy}") - F.col(f"b_{energy}")
    scored = ends.withColumn("score", drop * (0.25 + F.greatest(F.lit(0.0), F.col("alignment"))) / (0.1 + F.col("dist")))
    return scored.withColumn("rationale", F.when(F.col("score") > 0, "downhill").otherwise("control"))


def canonical_pairs(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct unordered pairs i < j; self edges drop out."""
    return edges.where("src <> dst").select(*by, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()


def edge_flow(pair_ends: DataFrame, n: int) -> DataFrame:
    """Mean velocity of both ends along the unit vector of the pair (zero length divides by 1)."""
    length = norm(vec("dx", n))
    total = F.lit(0.0)
    for i in range(n):
        total = total + 0.5 * (F.col(f"a_v{i}") + F.col(f"b_v{i}")) * F.col(f"dx{i}")
    return pair_ends.withColumn("flow", total / F.when(length > 0, length).otherwise(1.0))


def reversibility_gap(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of |w_ij + w_ji| over edges that have a reverse edge; 0 where none has."""
    back = edges.select(*by, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("work").alias("back_work"))
    met = edges.join(back, [*by, "src", "dst"], "left")
    return met.groupBy(*by).agg(F.coalesce(F.avg(F.abs(F.col("work") + F.col("back_work"))), F.lit(0.0)).alias("gap"), F.count("back_work").alias("reversible"))


def jacobian_proxy(ends: DataFrame, n: int) -> DataFrame:
    """Change of velocity along each edge per squared length, and a geodesic cost of the edge."""
    d2 = dot(vec("dx", n), vec("dx", n))
    gain = F.lit(0.0)
    for i in range(n):
        gain = gain + (F.col(f"b_v{i}") - F.col(f"a_v{i}")) * F.col(f"dx{i}")
    return ends.withColumn("jacobian", F.when(d2 > TINY, gain / d2).otherwise(0.0)).withColumn(
        "geodesic", F.sqrt(d2) * (1 + F.abs("jacobian")) / F.sqrt(F.greatest("a_diffusion", F.lit(TINY)))
    )


def log_ratio(a: str, b: str):
    return safe_log(a) - safe_log(b)
