"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.llm.clusters import describe_groups, similarity_groups
from fellscape.llm.components import boruvka_components
from fellscape.llm.leaks import leaked_items
from fellscape.llm.quantile_digest import build_digests, digest_quantiles, merge_digests
from fellscape.llm.sentences import sentences
from fellscape.llm.splits import assign_splits, digits_as_number, entity_components, pool_number
from fellscape.llm.tokens import decode_corpus, encode_corpus, single_texts
from fellscape.llm.vectors import complete, nearest_vectors, similar_pairs
from fellscape.session import latest, table

#: Vector spaces of problem 2: numbers per vector and the largest distance of a pair.
SPACES = {"expression": (24, 2.0), "velocity": (24, 0.5), "embedding": (2, 0.25)}


def _living(spark: SparkSession, folder: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """Current rows that are not deleted."""
    return latest(table(spark, folder, name), key, "loaded_at", ["deleted_at", *columns]).where("deleted_at is null").drop("deleted_at")


def _space(spark: SparkSession, folder: str, space: str) -> DataFrame:
    dim, _ = SPACES[space]
    if space == "embedding":
        rows = _living(spark, folder, "fit_cells", "node_no", ["fit_id", "embedding"])
        rows = rows.where("fit_id is not null").select(F.col("fit_id").alias("scope"), F.col("node_no").alias("key"), F.col("embedding").alias("vec"))
        return rows.where(complete(F.col("vec"), dim))
    column = {"expression": "expr", "velocity": "vel"}[space]
    rows = _living(spark, folder, "cells", "cell_no", [column]).select(F.lit("").alias("scope"), F.col("cell_no").alias("key"), F.col(column).alias("vec"))
    rows = rows.where(complete(F.col("vec"), dim))
    return rows.where(F.exists("vec", lambda x: x != 0)) if space == "velocity" else rows


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the 5 nearest of the other within the space's distance."""
    out = None
    for space, (dim, limit) in SPACES.items():
        near = nearest_vectors(_space(spark, folder, space), dim, 5, limit)
        part = similar_pairs(near).select(F.lit(space).alias("vec_space"), "left_no", "right_no")
        out = part if out is None else out.unionByName(part)
    return out


def _clusters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _space(spark, folder, "expression").select("key", "vec")
    return rows, similarity_groups(rows, *SPACES["expression"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells in groups of three or more, with the smallest cell of the group; groups stay unsplit here."""
    _, groups = _clusters(spark, folder)
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where("n >= 3")
    return groups.join(sizes, "group").select(F.col("key").alias("cell_no"), F.col("group").alias("cluster_no"))


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of three or more cells with size and most typical cells; loose groups are split."""
    rows, groups = _clusters(spark, folder)
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where("n >= 3").select("group")
    found = describe_groups(groups.join(sizes, "group"), rows, *SPACES["expression"])
    return found.select(F.col("group").alias("group_no"), F.col("cluster").alias("cluster_no"), "size", F.array_join(F.transform("typical", lambda x: x.cast("string")), ",").alias("typical"))


def _donors(spark: SparkSession, folder: str) -> DataFrame:
    study = table(spark, folder, "study_cells")
    return study.select("obs_no", digits_as_number(F.col("donor")).alias("donor_no"), pool_number(F.col("replicate")).alias("pool_no"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Donors tied to at least one other donor through pools, with the smallest donor of the group.

    Numbers of any length tie; a donor beyond BIGINT has no row, since the column cannot hold it.
    """
    comp = entity_components(_donors(spark, folder).where("donor_no is not null"), ["donor_no", "pool_no"]).where("entity_kind = 0")
    comp = comp.withColumn("donor_no", F.expr("try_cast(entity AS BIGINT)"))
    groups = comp.groupBy("component").agg(F.min("donor_no").alias("group_no"), F.count("*").alias("n")).where("n > 1")
    return comp.where("donor_no is not null").join(groups, "component").select("donor_no", "group_no")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Component and split of every observation of study_cells and trial_observations."""
    study = _donors(spark, folder).select(F.lit("study_cells").alias("ref_table"), F.col("obs_no").alias("ref_no"), "donor_no", "pool_no")
    trial = table(spark, folder, "trial_observations").select(
        F.lit("trial_observations").alias("ref_table"), F.col("trial_no").alias("ref_no"), digits_as_number(F.col("donor_id")).alias("donor_no"), F.lit(None).cast("string").alias("pool_no")
    )
    return assign_splits(study.unionByName(trial), ["ref_table", "ref_no"], ["donor_no", "pool_no"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every node that is an end of an edge of its fit."""
    comp = boruvka_components(table(spark, folder, "fit_edges"), "source", "target", ["fit_id"])
    return comp.select("fit_id", F.col("node").alias("node_no"), F.col("component").alias("component_no"))


MEASURES = ("energy", "commitment_time")


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    rows = _living(spark, folder, "fit_cells", "node_no", ["loaded_at", "fit_id", "label", *MEASURES])
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("measure_name"), F.col(m).alias("x")) for m in MEASURES]))
    return rows.select("fit_id", "label", F.date_format("loaded_at", "yyyy-MM-dd").alias("day"), pairs)


_GROUP = ["measure_name", "fit_id", "label"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose percentiles lie far apart, from the digests of whole groups."""
    digests = build_digests(_measured(spark, folder), _GROUP, "x")
    q = digest_quantiles(digests, _GROUP, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}).where("n >= 30")
    late = (F.col("measure_name") == "commitment_time") & (F.col("p95") > 4 * F.col("p50"))
    wide = (F.col("measure_name") == "energy") & (F.col("p90") - F.col("p10") > 6)
    return q.where(late | wide).select(*_GROUP)


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every group over all days, merged from the digests of single days."""
    days = build_digests(_measured(spark, folder), [*_GROUP, "day"], "x")
    return digest_quantiles(merge_digests(days, _GROUP), _GROUP, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and how many of them decode to their own text."""
    documents = table(spark, folder, "documents")
    back = decode_corpus(encode_corpus(documents)).withColumnRenamed("text", "decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return single_texts(documents).join(back, "doc_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum(same.cast("bigint")), F.lit(0)).alias("exact"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items and the number of documents that hold them."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every document."""
    return sentences(table(spark, folder, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_percentiles": p6_percentiles,
}

_ASCII = "translate({0}, '０１２３４５６７８９', '0123456789')"
_POOLED = r"(?i)(?:^|[^\p{L}\p{N}])p(?:ool)?[\s._:#/-]*(?:(?:number|num|nr|no)[\s._:#°º-]*)?(\d+)"

ORACLE = {
    "p4_found": f"""
WITH RECURSIVE s AS (SELECT DISTINCT regexp_replace({_ASCII.format("donor")}, '[^0-9]', '', 'g') AS dn, regexp_extract({_ASCII.format("replicate")}, '{_POOLED}', 1) AS pn FROM study_cells),
e AS (SELECT DISTINCT dn::BIGINT AS d, pn::BIGINT AS p FROM s WHERE dn <> '' AND pn <> ''),
lb(it, d, c) AS (SELECT 0, d, d FROM (SELECT DISTINCT d FROM e) UNION ALL SELECT any_value(l.it) + 1, y.d, min(l.c) FROM lb l JOIN e x ON x.d = l.d JOIN e y ON y.p = x.p WHERE l.it < 40 GROUP BY y.d),
f AS (SELECT d AS donor_no, c AS group_no, count(*) OVER (PARTITION BY c) AS n FROM lb WHERE it = 40)
SELECT donor_no, group_no FROM f WHERE n > 1""",
    "p8_roundtrip": "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS exact FROM documents WHERE doc_id IS NOT NULL",
    "p6_found": """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_no ORDER BY loaded_at DESC) AS rn FROM fit_cells) WHERE rn = 1 AND deleted_at IS NULL),
v AS (SELECT 'energy' AS measure_name, fit_id, label, energy AS x FROM cur UNION ALL SELECT 'commitment_time', fit_id, label, commitment_time FROM cur),
q AS (SELECT measure_name, fit_id, label, quantile_disc(x, 0.1) AS a, quantile_disc(x, 0.5) AS m, quantile_disc(x, 0.9) AS b, quantile_disc(x, 0.95) AS c
      FROM v WHERE isfinite(x) AND label IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT measure_name, fit_id, label FROM q WHERE (measure_name = 'energy' AND b - a > 6) OR (measure_name = 'commitment_time' AND c > 4 * m)""",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT fit_id, source AS a, target AS b FROM fit_edges WHERE source IS NOT NULL AND target IS NOT NULL AND fit_id IS NOT NULL
                     UNION SELECT DISTINCT fit_id, target, source FROM fit_edges WHERE source IS NOT NULL AND target IS NOT NULL AND fit_id IS NOT NULL),
lab(it, fit_id, node, c) AS (
  SELECT 0, fit_id, a, min(least(a, b)) FROM e GROUP BY fit_id, a
  UNION ALL
  SELECT any_value(l.it) + 1, e.fit_id, e.a, least(min(l.c), min(m.c)) FROM lab l JOIN e ON e.fit_id = l.fit_id AND e.b = l.node JOIN lab m ON m.fit_id = e.fit_id AND m.node = e.a
  WHERE l.it < 60 GROUP BY e.fit_id, e.a)
SELECT fit_id, node AS node_no, c AS component_no FROM lab WHERE it = 60""",
}
