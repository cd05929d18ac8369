"""Queries over the kNN graph of single cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.functions import scalar as S
from fellscape.operators import edges as E
from fellscape.operators import nodeagg as N
from fellscape.operators import programs as P
from fellscape.operators import topology as T
from fellscape.plans.base import DIMS, ENDS, KNN, PTS, dot_sql, knn, located, points, rounded, rounded_sql
from fellscape.session import latest, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(rounded_sql(KNN, "src; dst; rank; ~dist AS dist", "FROM knn"))
def knn_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Exact k nearest neighbours of every cell."""
    return rounded(knn(spark, folder))


@query(rounded_sql(ENDS, "idx; ~density AS density", "FROM nodes"))
def local_density(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.local_density(knn(spark, folder)))


@query(rounded_sql(ENDS, "idx; ~diffusion AS diffusion", "FROM nodes"))
def local_diffusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(located(spark, folder)[0].select("idx", "diffusion"))


@query(rounded_sql(ENDS, "src; dst; ~alignment AS alignment", "FROM aligned"))
def velocity_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.velocity_alignment(located(spark, folder)[1], DIMS).select("src", "dst", "alignment"))


@query(rounded_sql(ENDS, "src; dst; ~alignment AS alignment", "FROM aligned WHERE alignment >= 0"))
def directed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.directed_edges(E.velocity_alignment(located(spark, folder)[1], DIMS)).select("src", "dst", "alignment"))


def _worked(spark: SparkSession, folder: str) -> DataFrame:
    return E.edge_work(E.directed_edges(E.velocity_alignment(located(spark, folder)[1], DIMS)), DIMS)


@query(rounded_sql(ENDS, "src; dst; ~work AS work", "FROM worked WHERE alignment >= 0"))
def edge_work(spark: SparkSession, folder: str) -> DataFrame:
    """Work of every directed edge."""
    return rounded(_worked(spark, folder).select("src", "dst", "work"))


@query(rounded_sql(ENDS, "a_label AS label; count(*) AS n; ~avg(work) AS mean_work", "FROM worked WHERE alignment >= 0 GROUP BY a_label"))
def edge_work_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: cells -> kNN -> density, diffusion -> directed edges -> work -> mean per label."""
    return rounded(_worked(spark, folder).groupBy(F.col("a_label").alias("label")).agg(F.count("*").alias("n"), F.avg("work").alias("mean_work")))


@query(rounded_sql(ENDS, "src; dst; ~len AS displacement; ~CASE WHEN len > 0 THEN drift / len ELSE 0 END AS projection; "
    "~sqrt(greatest(0, speed * speed - (CASE WHEN len > 0 THEN drift / len ELSE 0 END) ** 2)) AS transverse; ~-drift AS signed_work; ~speed * speed / greatest(2 * a_diffusion, 1e-12) AS activity", "FROM aligned", 5))  # fmt: skip
def transition_observables(spark: SparkSession, folder: str) -> DataFrame:
    out = E.transition_observables(located(spark, folder)[1], DIMS)
    return rounded(out.select("src", "dst", "displacement", "projection", "transverse", "signed_work", "activity"), 5)


_FLOW = " + ".join(f"0.5 * (a.v{i} + b.v{i}) * (b.x{i} - a.x{i})" for i in range(DIMS))
_LEN = "sqrt(" + " + ".join(f"(b.x{i} - a.x{i}) ** 2" for i in range(DIMS)) + ")"
_PAIRS = KNN + ", pr AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM knn)"


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    pairs = E.canonical_pairs(knn(spark, folder)).withColumnsRenamed({"i": "src", "j": "dst"})
    ends = E.with_displacement(E.with_ends(pairs, points(spark, folder), [*[f"x{i}" for i in range(DIMS)], *[f"v{i}" for i in range(DIMS)]]), DIMS)
    return E.edge_flow(ends, DIMS).select(F.lit("all").alias("graph"), F.col("src").alias("i"), F.col("dst").alias("j"), "flow")


@query(rounded_sql(_PAIRS, f"i; j; ~({_FLOW}) / (CASE WHEN {_LEN} > 0 THEN {_LEN} ELSE 1 END) AS flow", "FROM pr JOIN pts a ON a.idx = i JOIN pts b ON b.idx = j"))
def edge_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Flow along every unordered neighbour pair."""
    return rounded(_flows(spark, folder).drop("graph"))


@query()
def hodge_split(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient and cyclic part of every pair's flow."""
    return rounded(T.hodge_split(_flows(spark, folder), "graph"))


@query()
def cyclic_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.cyclic_fraction(T.hodge_split(_flows(spark, folder), "graph"), ["graph"]))


@query()
def cyclic_flow_per_cell(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.cyclic_flow_per_node(T.hodge_split(_flows(spark, folder), "graph"), ["graph"]))


@query()
def cycle_affinities(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.cycle_affinities(_flows(spark, folder), "graph"))


_CHG = " + ".join(f"(b_v{i} - a_v{i}) * dx{i}" for i in range(DIMS))
_DD = dot_sql("dx", "dx")
_W = f"exp(-{_DD} / (2 * 0.65 * 0.65))"
_DIVC = ENDS + f", dv AS (SELECT src AS idx, sum(CASE WHEN {_DD} > 1e-12 THEN {_W} * ({_CHG}) / {_DD} ELSE 0 END) / greatest(sum({_W}), 1e-12) AS divergence FROM ends GROUP BY src)"


@query(rounded_sql(_DIVC, "idx; ~divergence AS divergence", "FROM dv"))
def divergence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.divergence(located(spark, folder)[1], DIMS))


@query(rounded_sql(_DIVC, "~avg(divergence) AS mean; ~stddev_pop(divergence) AS spread; ~avg((divergence > 0)::INT) AS positive; ~avg((divergence < 0)::INT) AS negative; "
    "~sum(divergence * density) / greatest(sum(density), 1e-12) AS weighted_mean; ~abs(avg(divergence)) / stddev_pop(divergence) AS signal", "FROM dv JOIN nodes USING (idx)"))  # fmt: skip
def divergence_summary(spark: SparkSession, folder: str) -> DataFrame:
    nodes, ends = located(spark, folder)
    return rounded(N.divergence_summary(N.divergence(ends, DIMS), nodes))


_G = ", ".join(f"sum(CASE WHEN {_DD} > 1e-12 THEN {_W} * (b_energy - a_energy) / greatest({_DD}, 1e-12) * dx{i} ELSE 0 END) AS g{i}, any_value(a_v{i}) AS w{i}" for i in range(DIMS))


@query(rounded_sql(ENDS + f", gr AS (SELECT src AS idx, {_G} FROM ends GROUP BY src)",
    f"idx; ~CASE WHEN sqrt({dot_sql('g', 'g')}) * sqrt({dot_sql('w', 'w')}) > 0 THEN -{dot_sql('g', 'w')} / (sqrt({dot_sql('g', 'g')}) * sqrt({dot_sql('w', 'w')})) ELSE 0 END AS alignment", "FROM gr"))
def gradient_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.gradient_alignment(located(spark, folder)[1], DIMS))


@query(rounded_sql(ENDS, "src AS idx; ~avg(CASE WHEN len > 0 THEN drift / len * a_density - a_diffusion * (b_density - a_density) / len ELSE 0 END) AS current", "FROM aligned GROUP BY src"))
def local_current(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.local_current(located(spark, folder)[1], DIMS))


_RES = ENDS + ", rs AS (SELECT src AS idx, " + ", ".join(f"any_value(a_v{i}) - avg(b_v{i}) AS r{i}" for i in range(DIMS)) + " FROM ends GROUP BY src)"


@query(rounded_sql(_RES, "idx; " + "; ".join(f"~r{i} AS r{i}" for i in range(DIMS)), "FROM rs"))
def velocity_residuals(spark: SparkSession, folder: str) -> DataFrame:
    nodes, ends = located(spark, folder)
    return rounded(N.velocity_residuals(ends, nodes, DIMS))


@query(rounded_sql(_RES, f"idx; ~{DIMS} * greatest(1e-6, {dot_sql('r', 'r')} / {DIMS}) AS trace", "FROM rs"))
def diffusion_trace(spark: SparkSession, folder: str) -> DataFrame:
    nodes, ends = located(spark, folder)
    return rounded(N.diffusion_trace(N.velocity_residuals(ends, nodes, DIMS), DIMS))


@query(rounded_sql(ENDS + f", jc AS (SELECT src, dst, {_DD} AS d2, a_diffusion, CASE WHEN {_DD} > 1e-12 THEN ({_CHG}) / {_DD} ELSE 0 END AS jacobian FROM ends)",
    "src; dst; ~jacobian AS jacobian; ~sqrt(d2) * (1 + abs(jacobian)) / sqrt(greatest(a_diffusion, 1e-12)) AS geodesic", "FROM jc"))
def edge_geometry(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.jacobian_proxy(located(spark, folder)[1], DIMS).select("src", "dst", "jacobian", "geodesic"))


@query(rounded_sql(ENDS, "src; dst; ~alignment AS link_cosine; ~1 / (1 + exp(-4 * alignment)) AS link_score", "FROM aligned WHERE rank = 1"))
def lineage_link_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the links to nearest neighbours."""
    return rounded(E.lineage_link_scores(located(spark, folder)[1].where("rank = 1"), DIMS).select("src", "dst", "link_cosine", "link_score"))


@query(rounded_sql(PTS, f"idx; ~sqrt({dot_sql('v', 'v')}) AS speed; ~({' + '.join(f'abs(x{i} * v{i})' for i in range(DIMS))}) / greatest(sqrt({dot_sql('x', 'x')}), 1e-12) AS velocity_information", "FROM pts"))
def velocity_norms(spark: SparkSession, folder: str) -> DataFrame:
    xs, vs = E.vec("x", DIMS), E.vec("v", DIMS)
    info = F.lit(0.0)
    for a, b in zip(xs, vs):
        info = info + F.abs(F.col(a) * F.col(b))
    return rounded(points(spark, folder).select("idx", S.norm(vs).alias("speed"), (info / F.greatest(S.norm(xs), F.lit(1e-12))).alias("velocity_information")))


# ------------------------------------------------------------------ genes and programs

_CUR = """cur AS (SELECT cell_no, label, outcome, expr, vel FROM (SELECT *, row_number() OVER (PARTITION BY cell_no ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND deleted_at IS NULL),
lg AS (SELECT cell_no, unnest(expr) AS value, generate_subscripts(expr, 1) - 1 AS gene FROM cur),
genes AS (SELECT cell_no, gene, value FROM lg WHERE isfinite(value))"""
_PROGRAMS = ", mk AS (SELECT 'program_' || (g % 4) AS program, g AS gene FROM range(12) t(g))"


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "cells"), "cell_no", "loaded_at", ["deleted_at", "label", "outcome", "expr", "vel"]).where("deleted_at is null")


def _genes(spark: SparkSession, folder: str) -> DataFrame:
    return P.long_genes(_cells(spark, folder), "cell_no", "expr")


def _markers(spark: SparkSession) -> DataFrame:
    """Four programs over the first twelve genes."""
    return spark.range(12).select(F.concat(F.lit("program_"), (F.col("id") % 4).cast("string")).alias("program"), F.col("id").cast("int").alias("gene"))


@query(rounded_sql(_CUR, "gene; count(*) AS n; ~avg(value) AS mean; ~coalesce(var_samp(value), 0) AS variance", "FROM genes GROUP BY gene"))
def gene_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.column_moments(_genes(spark, folder)))


@query(rounded_sql(_CUR, "gene; ~var_pop(value) AS variance", "FROM genes GROUP BY gene ORDER BY var_pop(value) DESC, gene LIMIT 8"))
def top_variance_genes(spark: SparkSession, folder: str) -> DataFrame:
    """The eight genes of the greatest variance."""
    return rounded(P.top_variance_genes(_genes(spark, folder), 8))


_SC = _CUR + _PROGRAMS + """, hit AS (SELECT cell_no, program, count(*) AS m, sum(value) AS ms FROM genes JOIN mk USING (gene) GROUP BY 1, 2),
bg AS (SELECT h.cell_no, h.program, m, ms, count(*) AS bn, avg(value) AS mu, var_samp(value) AS va FROM hit h JOIN genes g USING (cell_no)
  WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.program = h.program AND mk.gene = g.gene) GROUP BY 1, 2, 3, 4),
sc AS (SELECT h.cell_no, h.program, h.ms / h.m AS score, CASE WHEN bn > 1 THEN (h.ms / h.m - mu) / greatest(sqrt(va), 1e-6) END AS z, h.m / 3.0 AS coverage FROM hit h LEFT JOIN bg b ON b.cell_no = h.cell_no AND b.program = h.program)"""


@query(rounded_sql(_SC, "cell_no; program; ~score AS score; ~z AS z; ~coverage AS coverage", "FROM sc", 4))
def program_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.program_scores(_genes(spark, folder), _markers(spark), "cell_no"), 4)


@query(rounded_sql(_SC, "cell_no; rank; program; ~z AS z; CASE WHEN coverage >= 0.5 THEN 'measured' ELSE 'partial' END AS evidence",
    "FROM (SELECT *, row_number() OVER (PARTITION BY cell_no ORDER BY z DESC, program) AS rank FROM sc WHERE z IS NOT NULL) WHERE rank <= 2", 4))
def dominant_programs(spark: SparkSession, folder: str) -> DataFrame:
    """The two strongest programs of every cell."""
    return rounded(P.dominant_programs(P.program_scores(_genes(spark, folder), _markers(spark), "cell_no"), "cell_no", 2), 4)


@query(rounded_sql(_SC + """, pr AS (SELECT cell_no, 1 / (1 + exp(-(coalesce(max(CASE WHEN program = 'program_0' THEN z END), 0) - coalesce(max(CASE WHEN program = 'program_1' THEN z END), 0)))) AS p FROM sc GROUP BY 1)""",
    "cell_no; ~p AS probability; CASE WHEN p >= 0.7 THEN 'committed' WHEN p <= 0.3 THEN 'uncommitted' ELSE 'undecided' END AS state", "FROM pr", 4))
def predicted_state(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.predicted_state(P.program_scores(_genes(spark, folder), _markers(spark), "cell_no"), "cell_no", "program_0", "program_1"), 4)


@query(rounded_sql(_CUR + ", st AS (SELECT gene, avg(value) AS m, greatest(coalesce(stddev_samp(value), 0), 1e-9) AS sd FROM genes GROUP BY gene), z AS (SELECT cell_no, gene, (value - m) / sd AS z FROM genes JOIN st USING (gene))",
    "cell_no; ~sqrt(avg(z * z)) AS rms", "FROM z GROUP BY cell_no"))
def population_context(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every cell from the population in z-scores."""
    return rounded(P.population_context(P.feature_z(_genes(spark, folder), "cell_no"), "cell_no").drop("genes"))


@query(rounded_sql(_CUR + ", p AS (SELECT cell_no, gene, greatest(value, 0) AS c FROM genes), t AS (SELECT cell_no, sum(c) AS total FROM p GROUP BY 1), m AS (SELECT median(total) AS target FROM t WHERE total > 0)",
    "cell_no; gene; ~ln(1 + c / greatest(total / target, 1e-9)) AS value", "FROM p JOIN t USING (cell_no) CROSS JOIN m"))
def normalize_total_log1p(spark: SparkSession, folder: str) -> DataFrame:
    """log1p of counts scaled to the median positive total; negative numbers count as 0."""
    g = _genes(spark, folder).withColumn("c", F.greatest("value", F.lit(0.0)))
    total = g.groupBy("cell_no").agg(F.sum("c").alias("total"))
    target = total.where("total > 0").agg(F.percentile("total", 0.5).alias("target"))
    met = g.join(total, "cell_no").crossJoin(target)  # one row
    return rounded(met.select("cell_no", "gene", F.log1p(F.col("c") / F.greatest(F.col("total") / F.col("target"), F.lit(1e-9))).alias("value")))


@query(rounded_sql(PTS, "; ".join(f"~covar_samp(x{a}, x{b}) AS c{a}{b}" for a in range(3) for b in range(a, 3)), "FROM pts"))
def covariance(spark: SparkSession, folder: str) -> DataFrame:
    rows = points(spark, folder).select(F.array("x0", "x1", "x2").alias("x"))
    c = P.covariance_matrix(rows, "x", 3)
    return rounded(c.agg(*[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("cov"))).alias(f"c{a}{b}") for a in range(3) for b in range(a, 3)]))


@query()
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    """First two components of the 24 gene expressions of complete cells."""
    rows = _cells(spark, folder).where(F.expr("size(expr) = 24 and forall(expr, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    out, _ = P.principal_axes(rows.select("cell_no", "expr"), "expr", 24, 2)
    return rounded(out.select("cell_no", "pc0", "pc1"))


@query(rounded_sql("n AS (SELECT p_partkey, regexp_replace(replace(replace(upper(trim(p_name)), '-', ''), '_', ''), '^MT(.)', '\\1') AS gene FROM part)", "gene; count(*) AS n; min(p_partkey) AS first_key", "FROM n GROUP BY gene"))
def gene_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Names in canonical form with their number and first key."""
    return table(spark, folder, "part").groupBy(S.gene_name("p_name").alias("gene")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
