"""Queries of ensembles, bootstraps, scenarios and prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.operators import edges as E
from fellscape.operators import ensembles as M
from fellscape.plans.base import DIMS, PTS, XS, fit_edges, fit_nodes, knn, points, rounded, rounded_sql

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


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("label") == "stem", "source").when(F.col("label") == "erythroid", "target")
    return fit_nodes(spark, folder).select("fit_id", "idx", "energy", role.alias("role"))


def _ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return M.commitment_ensemble(_roles(spark, folder), fit_edges(spark, folder), BY, 8, 0.8)


@query()
def commitment_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread of commitment over subsets of the nodes of every fit."""
    return rounded(M.ensemble_summary(_ensemble(spark, folder), BY))


@query()
def ensemble_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.rank_agreement(_ensemble(spark, folder), BY))


@query()
def robustness_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Commitment under half and double temperature against the baseline."""
    return rounded(M.robustness(_roles(spark, folder), fit_edges(spark, folder), BY, [1.0, 0.5, 2.0]))


@query()
def resolved_barrier(spark: SparkSession, folder: str) -> DataFrame:
    """Bias-corrected barrier of the commitment profile of every fit."""
    q = M.commitment_ensemble(_roles(spark, folder), fit_edges(spark, folder), BY, 1, 1.1)
    return rounded(M.resolved_barrier(q, BY, 10))


@query()
def bootstrap_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of propagated energies when edges are left out."""
    e = fit_edges(spark, folder)
    first = e.groupBy("fit_id", "src").agg(F.count("*").alias("n")).groupBy("fit_id").agg(F.max_by("src", F.struct("n", -F.col("src"))).alias("idx"))
    return rounded(M.bootstrap_energy(first, e, "fit_id", 4))


@query()
def noise_matched_irreversibility(spark: SparkSession, folder: str) -> DataFrame:
    """Cyclic share of the cells' flow against potential flows with the same noise."""
    pairs = E.canonical_pairs(knn(spark, folder)).withColumn("graph", F.lit("all"))
    return rounded(M.noise_matched(points(spark, folder).withColumn("graph", F.lit("all")), pairs, DIMS, "graph", 8), 4)


_C = ", ".join(f"avg(x{i}) AS c{i}" for i in range(DIMS))
_GAP = " + ".join(f"(x{i} - c{i}) ** 2" for i in range(DIMS))


@query(rounded_sql(PTS + f", ce AS (SELECT label AS fate, {_C} FROM pts GROUP BY 1), sc AS (SELECT idx, fate, -sqrt({_GAP}) AS s FROM pts CROSS JOIN ce), ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY idx)) AS e FROM sc),"
    " pb AS (SELECT *, e / sum(e) OVER (PARTITION BY idx) AS p FROM ex)", "idx; arg_max(fate, p) AS fate; ~max(p) AS probability; ~-sum(p * ln(p)) AS entropy", "FROM pb GROUP BY idx"))  # fmt: skip
def fate_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """Most likely label of every cell by distance to the labels' centroids."""
    return rounded(M.fate_prototypes(points(spark, folder), XS))
