"""Queries of summaries, comparisons and evidence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.operators import programs as P
from fellscape.operators import summaries as S
from fellscape.plans.base import FITS, PTS, fit_edges, fit_ends, fit_nodes, points, rounded, rounded_sql
from fellscape.plans.cells import _CUR, _genes
from fellscape.plans.studies import _HASH, _OBS, observations

QUERIES: dict = {}
ORACLE: dict = {}
BY = ["fit_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(rounded_sql(FITS + ", dn AS (SELECT fit_id, avg((b_energy <= a_energy)::INT) AS d, avg(alignment) AS a FROM ft GROUP BY 1), sz AS (SELECT fit_id, count(DISTINCT label) AS k, count(*) AS n FROM fn GROUP BY 1)",
    "fit_id; ~0.45 * d + 0.40 * a + 0.15 * least(1, k / sqrt(n)) AS score", "FROM dn JOIN sz USING (fit_id)"))
def landscape_score(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.landscape_score(fit_ends(spark, folder), fit_nodes(spark, folder), BY))


@query(rounded_sql(FITS + ", cp AS (SELECT fit_id, energy AS x, -ln(greatest(density, 1e-12)) AS y FROM fn)",
    "fit_id; count(*) AS n; ~CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS pearson; ~sqrt(avg((y - x) ** 2)) AS rmse; ~avg(y - x) AS shift", "FROM cp GROUP BY fit_id"))
def landscape_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Energies against density potentials of every fit."""
    n = fit_nodes(spark, folder)
    other = n.select("fit_id", "idx", (-F.log(F.greatest("density", F.lit(1e-12)))).alias("energy"))
    return rounded(S.compare_landscapes(n, other, ["fit_id", "idx"], BY))


@query(rounded_sql(FITS + """, md AS (SELECT idx, 'density' AS method, -ln(greatest(density, 1e-12)) AS e, energy AS t FROM fn UNION ALL SELECT idx, 'uncertainty', uncertainty, energy FROM fn),
rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY e, idx) AS re, row_number() OVER (PARTITION BY method ORDER BY t, idx) AS rt, ceil(0.1 * count(*) OVER (PARTITION BY method)) AS k, count(*) OVER (PARTITION BY method) AS c FROM md)""",
    "method; max(c) AS n; ~avg(abs(e - t)) AS mae; ~1 - 6.0 * sum((re - rt)::DOUBLE ** 2) / (max(c)::DOUBLE * (max(c)::DOUBLE ** 2 - 1)) AS rho; ~sum((re <= k AND rt <= k)::INT) / max(k) AS recall", "FROM rk GROUP BY method"))
def energy_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Density potential and uncertainty as stand-ins for the energy."""
    n = fit_nodes(spark, folder)
    m = n.select("idx", F.lit("density").alias("method"), (-F.log(F.greatest("density", F.lit(1e-12)))).alias("energy")).unionByName(n.select("idx", F.lit("uncertainty").alias("method"), F.col("uncertainty").alias("energy")))
    return rounded(S.compare_energy_methods(n, m, "idx"))


@query(rounded_sql(FITS, "fit_id; ~greatest(1e-6, coalesce(stddev_samp(energy), 0) * 0.8) AS temperature", "FROM fn GROUP BY fit_id"))
def adaptive_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.adaptive_temperature(fit_nodes(spark, folder), BY, 0.4))


@query(rounded_sql(_CUR, "cell_no; ~exp(least(greatest(coalesce(avg(value) FILTER (WHERE gene IN (0, 1, 2)), 0) - coalesce(avg(value) FILTER (WHERE gene IN (5, 6)), 0), -5), 5)) AS weight", "FROM genes GROUP BY cell_no"))
def growth_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Growth of cells by three birth and two death genes."""
    return rounded(S.growth_weights(_genes(spark, folder), "cell_no", [0, 1, 2], [5, 6]))


@query(rounded_sql(_CUR, "gene; ~quantile_cont(value, 0.05) AS p05; ~quantile_cont(value, 0.5) AS p50; ~quantile_cont(value, 0.95) AS p95; ~quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS width", "FROM genes GROUP BY gene"))
def percentile_band(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.percentile_band(_genes(spark, folder)))


@query(rounded_sql(FITS + ", lo AS (SELECT fit_id, src, min(work) AS m FROM fe GROUP BY 1, 2)", "fit_id; src; ~sum(exp(m - work) * work) / sum(exp(m - work)) AS energy; ~sum(exp(m - work)) ** 2 / sum(exp(m - work) ** 2) AS ess", "FROM fe JOIN lo USING (fit_id, src) GROUP BY fit_id, src"))
def work_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.work_profile(fit_edges(spark, folder), ["fit_id", "src"]))


@query(rounded_sql(FITS, "fit_id; ~(sum(greatest(work, 0)) - sum(greatest(-work, 0))) / greatest(1, sum(abs(work))) AS score", "FROM fe GROUP BY fit_id"))
def irreversibility_score(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.irreversibility_score(fit_edges(spark, folder), BY))


@query(rounded_sql(FITS, "fit_id; ~sum(CASE WHEN sign(alignment) = sign(a_energy - b_energy) THEN abs(alignment) ELSE 0 END) AS conservative; ~sum(CASE WHEN sign(alignment) = sign(a_energy - b_energy) THEN 0 ELSE abs(alignment) END) AS rotational; ~sum(alignment) AS net", "FROM ft GROUP BY fit_id"))
def current_split(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.current_split(fit_ends(spark, folder), BY))


@query(rounded_sql(FITS + ", dl AS (SELECT fit_id, label, avg(-0.5 * density) AS delta FROM fn WHERE label IS NOT NULL GROUP BY 1, 2)", "fit_id; label; ~delta AS delta; row_number() OVER (PARTITION BY fit_id ORDER BY abs(delta) DESC, label) AS rank", "FROM dl"))
def perturbation_response(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.perturbation_response(fit_nodes(spark, folder).where("label is not null"), ["fit_id", "label"], 0.5, "density"))


@query(rounded_sql(FITS + ", bf AS (SELECT fit_id, idx, label, lag(label) OVER (PARTITION BY fit_id ORDER BY idx) AS before FROM fn WHERE label IS NOT NULL)", "fit_id; count(*) AS changes; min(idx) AS first_idx", "FROM bf WHERE before IS NOT NULL AND before <> label GROUP BY fit_id"))
def label_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the label along the nodes of every fit."""
    c = S.adjacent_changes(fit_nodes(spark, folder).where("label is not null").select("fit_id", "idx", "label"), BY, "idx", "label")
    return c.groupBy("fit_id").agg(F.count("*").alias("changes"), F.min("idx").alias("first_idx"))


@query(rounded_sql(PTS + ", st AS (SELECT label, (lead(x0) OVER w - x0 - v0) ** 2 + (lead(x1) OVER w - x1 - v1) ** 2 AS o FROM pts WINDOW w AS (PARTITION BY label ORDER BY idx))", "label; count(*) AS steps; ~sum(o) / 4 AS action", "FROM st WHERE o IS NOT NULL GROUP BY label"))
def path_action(spark: SparkSession, folder: str) -> DataFrame:
    """Action of the path through each label's cells in the order of their ids."""
    return rounded(S.path_action(points(spark, folder), ["label"], "idx", ["x0", "x1"], ["v0", "v1"], 1.0, 1.0))


@query(rounded_sql(_OBS + f""", pm AS (SELECT obs_no AS k, abs(p - y) - abs(0.5 - y) AS d FROM ob WHERE isfinite(p) AND y IS NOT NULL), se AS (SELECT avg(d) AS o FROM pm),
nl AS (SELECT rep, o, avg(CASE WHEN {_HASH.format("'19:' || rep || ':' || k")} / 4294967296.0 < 0.5 THEN -d ELSE d END) AS x FROM pm CROSS JOIN range(20) t(rep) CROSS JOIN se GROUP BY rep, o)""",
    "~o AS observed; ~(sum((abs(x) >= abs(o) - 1e-12)::INT) + 1) / (count(*) + 1.0) AS p_value; CASE WHEN o < 0 THEN 'p' WHEN o > 0 THEN 'half' ELSE 'tie' END AS winner", "FROM nl GROUP BY o"))
def paired_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Target probability against the constant one half as predictors."""
    return rounded(S.paired_methods(observations(spark, folder).withColumn("half", F.lit(0.5)), "obs_no", "p", "half", "y", 20))


@query(rounded_sql(PTS, "~(var_samp(x0) + var_samp(x1) + var_samp(x2)) ** 2 / (var_samp(x0) ** 2 + var_samp(x1) ** 2 + var_samp(x2) ** 2 + 2 * (covar_samp(x0, x1) ** 2 + covar_samp(x0, x2) ** 2 + covar_samp(x1, x2) ** 2)) AS dimension", "FROM pts"))
def participation_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.participation_dimension(P.covariance_matrix(points(spark, folder).select(F.array("x0", "x1", "x2").alias("x")), "x", 3)))


@query(rounded_sql(FITS + ", dg AS (SELECT fit_id, avg((b_energy <= a_energy)::INT) AS d, avg(alignment) AS a FROM ft GROUP BY 1)", "fit_id; CASE WHEN d >= 0.5 AND a >= 0.3 THEN 'good' WHEN d >= 0.3 AND a >= 0.1 THEN 'warning' ELSE 'critical' END AS status", "FROM dg"))
def fit_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    d = fit_ends(spark, folder).groupBy("fit_id").agg(F.avg((F.col("b_energy") <= F.col("a_energy")).cast("double")).alias("d"), F.avg("alignment").alias("a"))
    return S.diagnose(d, "fit_id", {"d": (0.5, 0.3), "a": (0.3, 0.1)})
