"""The pipeline as one call: cells in, tables of the landscape and a one-row report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import clipped_exp
from fellscape.operators import edges as E
from fellscape.operators import fixpoint as X
from fellscape.operators import nodeagg as N
from fellscape.operators import stats as S
from fellscape.operators import topology as T
from fellscape.operators.knn import exact_knn
from fellscape.operators.programs import principal_axes
from fellscape.session import cut


@dataclass(frozen=True)
class Config:
    """Settings of a fit; every field is used."""

    neighbors: int = 10
    dimensions: int = 6
    temperature: float = 1.0
    velocity_scale: float = 1.0
    alignment: float = 0.0
    bandwidth: float = 0.65
    attractor_quantile: float = 0.5
    committor_steps: int = 64
    tolerance: float = 1e-6

    def __post_init__(self):
        if self.neighbors < 1 or self.dimensions < 1 or self.temperature <= 0 or self.bandwidth <= 0 or not 0 < self.attractor_quantile <= 1:
            raise ValueError("neighbors, dimensions, temperature and bandwidth must be positive, the quantile within (0, 1]")


@dataclass(frozen=True)
class Landscape:
    """Tables of a fit: nodes (idx, label, x*, v*, density, diffusion, energy, q), edges, attractors, report."""

    nodes: DataFrame
    edges: DataFrame
    attractors: DataFrame
    report: DataFrame


def reduce_cells(cells: DataFrame, genes: int, config: Config) -> DataFrame:
    """Cells (idx, label, expr, vel) with x0.. and v0..: principal components, velocity projected by the same axes."""
    k = min(config.dimensions, genes)
    out, axes = principal_axes(cells, "expr", genes, k)
    for n, axis in enumerate(axes):
        e = F.lit(0.0)
        for i in range(genes):
            e = e + F.coalesce(F.get("vel", F.lit(i)), F.lit(0.0)) * float(axis[i])
        out = out.withColumn(f"v{n}", e).withColumnRenamed(f"pc{n}", f"x{n}")
    return out.drop("expr", "vel")


def analyze(points: DataFrame, source: str, target: str, config: Config = Config()) -> Landscape:
    """Fit a landscape to points (idx, label, x0.., v0..) and report on the way from source to target.

    Labels ``source`` and ``target`` are the ends of the committor. Points with a null coordinate
    take no part; with fewer than two points all tables are empty.
    """
    n = sum(c.startswith("x") and c[1:].isdigit() for c in points.columns)
    xs, vs = E.vec("x", n), E.vec("v", n)
    pts = points.select("idx", "label", *xs, *vs).dropna(subset=[*xs, *vs])
    near = cut(exact_knn(pts, "idx", xs, config.neighbors))
    bare = E.with_displacement(E.with_ends(near, pts, [*xs, *vs]), n)
    nodes = pts.join(N.local_density(near, config.bandwidth), "idx").join(N.local_diffusion(bare, n), "idx")
    nodes = cut(nodes.withColumn("energy", -config.temperature * F.log("density")))
    ends = E.with_displacement(E.with_ends(near, nodes, [*xs, *vs, "density", "diffusion", "energy", "label"]), n)
    edges = E.edge_work(E.directed_edges(E.velocity_alignment(ends, n), config.alignment), n, config.temperature, config.velocity_scale)
    edges = cut(edges.select("src", "dst", "dist", "alignment", "work", "a_energy", "b_energy", "a_label", "b_label"))
    low = T.attractors(nodes, edges, quantile=config.attractor_quantile)
    role = F.when(F.col("label").cast("string") == source, "source").when(F.col("label").cast("string") == target, "target")
    weight = clipped_exp(-(F.col("b_energy") - F.col("a_energy")) / config.temperature, 40.0)
    q = X.committor(nodes.select("idx", role.alias("role")), edges.withColumn("weight", weight), (), config.committor_steps, config.tolerance)
    nodes = cut(nodes.join(q, "idx"))
    rate = N.entropy_production(N.pair_fluxes(edges, nodes)).select(F.col("rate").alias("entropy_production"))
    flux = E.reactive_flux(E.with_ends(edges.select("src", "dst"), nodes, ["energy", "q"]), config.temperature).agg(F.sum("flux").alias("reactive_flux"))
    barrier = S.kde_profile(nodes, "q", temperature=config.temperature).where("at between 3 and 56").agg(F.max("free_energy").alias("barrier"))
    counts = nodes.agg(F.count("*").alias("cells"), F.avg((F.col("q") > 0.5).cast("double")).alias("committed_share"))
    links = edges.agg(F.count("*").alias("edges"), F.avg("alignment").alias("velocity_alignment"), F.avg("work").alias("mean_work"))
    report = counts
    for one in (links, low.agg(F.count("*").alias("attractors")), rate, flux, barrier):  # one-row tables
        report = report.crossJoin(one)
    return Landscape(nodes, edges, low, report)


def exported(fit: Landscape) -> DataFrame:
    """One flat row per cell with fixed tw_* column names, for CSV."""
    from pyspark.sql import Window

    from fellscape.functions.scalar import phase_of

    ends = E.with_ends(fit.edges.select("src", "dst"), fit.nodes, ["q"]).where("b_q > a_q + 1e-4")
    w = Window.partitionBy("src").orderBy(F.desc("b_q"), "dst")
    ahead = ends.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy(F.col("src").alias("idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "dst"))), lambda s: s["dst"].cast("string")), "|").alias("tw_downstream"))
    cols = [F.col("idx").alias("tw_id"), F.col("label").alias("tw_stage"), F.col("x0").alias("tw_x"), F.col("x1").alias("tw_y"), F.col("q").alias("tw_committor"), phase_of("q").alias("tw_phase"), F.col("energy").alias("tw_energy")]
    return fit.nodes.join(ahead, "idx", "left").select(*cols, F.coalesce("tw_downstream", F.lit("")).alias("tw_downstream"))


def simulate(spark, cells: int, genes: int = 8, seed: int = 1) -> DataFrame:
    """Synthetic cells in a four-well potential: idx, label, expr, vel; portable hash noise, so any engine makes the same."""
    from fellscape.functions.scalar import hash_normal, hash_uniform

    well = F.when(F.col("idx") < cells // 4, 0).otherwise(F.floor(hash_uniform(F.lit(seed), "idx") * 4)).cast("int")
    names = F.array(F.lit("stem"), F.lit("erythroid"), F.lit("myeloid"), F.lit("lymphoid"))
    base = spark.range(cells).withColumnRenamed("id", "idx").withColumn("well", well)
    centre = lambda g: F.when(F.col("well") == g % 4, 2.0).otherwise(-0.5)
    expr = F.array(*[centre(g) + 0.3 * hash_normal(F.lit(seed), "idx", F.lit(g)) for g in range(genes)])
    out = base.withColumn("expr", expr).withColumn("label", F.get(names, "well"))
    vel = F.array(*[(centre(g) - F.get("expr", F.lit(g))) * 0.5 + 0.05 * hash_normal(F.lit(seed + 1), "idx", F.lit(g)) for g in range(genes)])
    return out.withColumn("vel", vel).select("idx", "label", "expr", "vel")
