"""Queries over nested reports (problem 1) and failing references (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.operators.orphans import failing_references, monthly_report
from fellscape.operators.shred import latest_readable, report_tables
from fellscape.session import table


def _reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    raw = table(spark, folder, "raw_reports")
    return report_tables(latest_readable(raw, "report_no", "received_at", "payload"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per phase with a finite sd, non-null basin member and non-null cycle node.

    An empty table, and reports without a readable delivery, give no rows.
    """
    t = _reports(spark, folder)
    none = F.lit(-1).cast("bigint")
    finite = F.col("sd").isNotNull() & ~F.isnan("sd") & (F.abs("sd") < float("inf"))
    phases = t["phases"].where(finite).select(
        "report_no", F.lit("phase_sd").alias("child_table"), F.col("tissue").alias("parent_key"), none.alias("parent_no"), none.alias("child_no"), F.col("phase").alias("child_value")
    )
    members = t["basin_members"].select(
        "report_no", F.lit("basin_member").alias("child_table"), F.col("fit_id").alias("parent_key"), F.col("basin_no").alias("parent_no"), F.col("member_no").alias("child_no"), F.col("member").alias("child_value")
    )
    nodes = t["cycle_nodes"].select(
        "report_no", F.lit("cycle_node").alias("child_table"), F.col("module").alias("parent_key"), F.col("cycle_no").alias("parent_no"), F.col("node_pos").alias("child_no"), F.col("cycle_node").alias("child_value")
    )
    return phases.unionByName(members).unionByName(nodes)


def p1_basins(spark: SparkSession, folder: str) -> DataFrame:
    """Basin entities with their scalar attributes and link to the report."""
    return _reports(spark, folder)["basins"]


def p1_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Cycle entities with their scalar attributes and link to the module."""
    return _reports(spark, folder)["cycles"]


def p1_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Component count of each module of each report."""
    return _reports(spark, folder)["modules"]


def _cell_key(column: str):
    return F.nullif(F.upper(F.trim(F.col(column))), F.lit(""))


def _failing(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "cells")
    nodes = table(spark, folder, "fit_cells")
    edges = table(spark, folder, "fit_edges")
    study = table(spark, folder, "study_cells")

    whole = lambda key: F.max(F.struct("loaded_at", "deleted_at", *([] if key is None else [key])))
    cell_rows = cells.withColumn("ref_key", _cell_key("cell_id")).where("ref_key is not null")
    parents = cell_rows.groupBy("ref_key").agg(F.min("loaded_at").alias("appeared"), whole(None).alias("_r")).select("ref_key", "appeared", F.col("_r.deleted_at").alias("deleted_at"))
    current = (
        nodes.where("node_no is not null")
        .groupBy("node_no")
        .agg(F.min("loaded_at").alias("appeared"), F.max(F.struct("loaded_at", "deleted_at", "fit_id", "cell_id")).alias("_r"))
        .select("node_no", "appeared", "_r.*")
    )
    tag = lambda t, f: [F.lit(t).alias("ref_table"), F.lit(f).alias("ref_field")]
    by_cell = (
        study.select(*tag("study_cells", "cell_id"), F.col("obs_no").alias("ref_no"), F.col("recorded_at").alias("at"), _cell_key("cell_id").alias("ref_key"))
        .unionByName(current.select(*tag("fit_cells", "cell_id"), F.col("node_no").alias("ref_no"), F.col("loaded_at").alias("at"), _cell_key("cell_id").alias("ref_key")))
    )
    ends = edges.select(
        F.lit("fit_edges").alias("ref_table"), F.col("edge_no").alias("ref_no"), F.col("recorded_at").alias("at"), "fit_id",
        F.inline(F.array(F.struct(F.lit("source").alias("ref_field"), F.col("source").alias("node_no")), F.struct(F.lit("target").alias("ref_field"), F.col("target").alias("node_no")))),
    )
    # Rows delivered twice are equal in every column, so it is enough to make the few failing rows distinct.
    bound = lambda df: df.count()  # noqa: E731  rows bound the number of keys
    a = failing_references(by_cell, parents, ["ref_key"], bound(cells))
    b = failing_references(ends, current.select("fit_id", "node_no", "appeared", "deleted_at"), ["fit_id", "node_no"], bound(nodes))
    cols = ["ref_table", "ref_field", "ref_no", "reason", F.date_format("at", "yyyy-MM").alias("ref_month")]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per failing reference of study_cells, fit_cells and fit_edges."""
    return _failing(spark, folder)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Failing references per table, field, month and reason."""
    return monthly_report(_failing(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_basins": p1_basins, "p1_cycles": p1_cycles, "p1_modules": p1_modules, "p7_found": p7_found, "p7_report": p7_report}

_P7 = """
WITH cell AS (
  SELECT upper(trim(cell_id)) AS k, min(loaded_at) AS appeared, max_by(deleted_at, loaded_at) AS deleted_at
  FROM (SELECT cell_id, loaded_at, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS deleted_at FROM cells) GROUP BY 1),
node AS (
  SELECT node_no, min(loaded_at) AS appeared, max_by(deleted_at, loaded_at) AS deleted_at, max_by(fit_id, loaded_at) AS fit_id,
         max_by(coalesce(cell_id, ''), loaded_at) AS cell_id, max(loaded_at) AS ref_at
  FROM (SELECT * REPLACE (coalesce(deleted_at, TIMESTAMP '9999-01-01') AS deleted_at) FROM fit_cells) GROUP BY 1),
refs AS (
  SELECT 'study_cells' AS ref_table, 'cell_id' AS ref_field, obs_no AS ref_no, recorded_at AS ref_at, upper(trim(cell_id)) AS k FROM study_cells
  UNION SELECT 'fit_cells', 'cell_id', node_no, ref_at, upper(trim(cell_id)) FROM node),
ends AS (
  SELECT 'source' AS ref_field, edge_no AS ref_no, recorded_at AS ref_at, fit_id, source AS node_no FROM fit_edges
  UNION SELECT 'target', edge_no, recorded_at, fit_id, target FROM fit_edges),
judged AS (
  SELECT ref_table, ref_field, ref_no, ref_at, CASE WHEN c.k IS NULL THEN 'missing' WHEN appeared > ref_at THEN 'late' WHEN deleted_at <= ref_at THEN 'deleted' END AS reason
  FROM refs LEFT JOIN cell c USING (k) WHERE k <> ''
  UNION ALL
  SELECT 'fit_edges', ref_field, ref_no, e.ref_at, CASE WHEN n.appeared IS NULL THEN 'missing' WHEN n.appeared > e.ref_at THEN 'late' WHEN n.deleted_at <= e.ref_at THEN 'deleted' END
  FROM ends e LEFT JOIN node n ON n.node_no = e.node_no AND n.fit_id = e.fit_id WHERE e.node_no IS NOT NULL AND e.fit_id IS NOT NULL),
failing AS (SELECT ref_table, ref_field, ref_no, reason, strftime(ref_at, '%Y-%m') AS ref_month FROM judged WHERE reason IS NOT NULL)
"""
ORACLE = {
    "p7_found": _P7 + "SELECT * FROM failing",
    "p7_report": _P7 + "SELECT ref_table, ref_field, ref_month, reason, count(*) AS n, min(ref_no) AS first_ref_no FROM failing GROUP BY 1, 2, 3, 4",
}
