"""Shredding of nested payloads and failing references, case by case."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fellscape.operators import orphans
from fellscape.operators.shred import latest_readable, read_object, report_tables, shred
from fellscape.plans.nested_and_refs import p1_found, p7_found

T = [dt.datetime(2024, 1, d) for d in range(1, 29)]
FIT = {"fit_id": "F1", "diagnostics": {"basins": [{"representative": 4, "depth": "1.5", "members": [4, None, "7"]}, {"members": None}, {"representative": None, "members": []}]}}
MODULES = {"x_beta": {"schnakenberg": {"top_5_contributions": {"affinity": 1, "nodes": [3, None, 5]}}, "multi_source": {"n_components": "2"}}, "y": {"schnakenberg": {"status": "skipped"}}}
ENSEMBLE = {"fits": 3, "gill.arch": {"sd_by_phase": {"early": "0.25", "late": None, "mid": float("nan"), "end": 1}}, "other": {"sd_by_phase": None}}


def reports(spark, rows):
    return spark.createDataFrame(rows, "report_no BIGINT, received_at TIMESTAMP, payload STRING")


def children(t, name):
    return sorted(map(tuple, t[name].collect()), key=str)


@pytest.mark.parametrize("wrap", [lambda p: p, lambda p: {"meta": 1, "results": {"results": p}}, lambda p: {k: json.dumps(v) for k, v in p.items()}, lambda p: {"results": json.dumps(json.dumps(p))}])
def test_tables_keep_parent_and_position(spark, wrap):
    whole = wrap({"landscape_fit": FIT, "new_modules": MODULES, "commitment_ensemble": ENSEMBLE})
    t = report_tables(reports(spark, [(1, T[0], json.dumps(whole)), (2, T[0], json.dumps(json.dumps(whole)))]))
    assert children(t, "basin_members") == [(n, "F1", 0, p, v) for n in (1, 2) for p, v in ((0, "4"), (2, "7"))]
    assert children(t, "cycle_nodes") == [(n, "x_beta", 0, p, v) for n in (1, 2) for p, v in ((0, "3"), (2, "5"))]
    assert {(r.phase, r.sd) for r in t["phases"].where("sd = sd and not isnan(sd)").collect()} == {("early", 0.25), ("end", 1.0)}
    assert sorted((r.basin_no, r.representative, r.depth) for r in t["basins"].where("report_no = 1").collect()) == [(0, "4", 1.5), (1, None, None), (2, None, None)]
    assert [(r.module, r.n_components) for r in t["modules"].where("report_no = 1").collect()] == [("x_beta", 2)]


def test_latest_readable_delivery_stands(spark):
    good = lambda k: json.dumps({"landscape_fit": {"fit_id": f"F{k}"}})
    rows = [(1, T[0], good(1)), (1, T[2], good(2)), (1, T[2], good(2)), (1, T[5], '{"a": 1'), (1, T[6], ""), (1, T[7], None), (2, T[1], "[1]"), (3, T[1], good(3) + " tail"), (None, T[1], good(9)), (4, None, good(4)), (5, T[0], '"{\\"a\\": NaN}"')]
    got = {r.report_no: r.payload for r in latest_readable(reports(spark, rows), "report_no", "received_at", "payload").collect()}
    assert set(got) == {1, 4, 5} and got[1] == good(2)


def test_readable_means_one_complete_object():
    assert read_object('{"a": [1, 2]}') and read_object('"{\\"a\\": 1}"')
    assert all(read_object(x) is None for x in (None, "", " ", "null", "[{}]", '"text"', "{", '{"a":1}{"b":2}', "NaN", "[" * 100_000))


def test_adjacency_numbers_every_value(spark):
    rows = {r.node: r for r in shred(reports(spark, [(1, T[0], '{"a": [true, null, {"b": 1.50}], "c": "[2]"}')]), "report_no", "payload").collect()}
    assert [(rows[n].parent, rows[n].label, rows[n].ordinal, rows[n].kind, rows[n].scalar) for n in range(8)] == [
        (-1, None, -1, "object", None), (0, "a", -1, "array", None), (1, None, 0, "boolean", "true"), (1, None, 1, "null", None), (1, None, 2, "object", None), (4, "b", -1, "number", "1.50"), (0, "c", -1, "array", None), (6, None, 0, "number", "2"),
    ]


def test_found_on_empty_table_and_extra_columns(spark, tmp_path):
    rows = reports(spark, [(1, T[0], json.dumps({"commitment_ensemble": ENSEMBLE}))]).withColumn("node", F.lit(1)).withColumn("scalar", F.lit("clash"))
    rows.write.parquet(str(tmp_path / "a" / "raw_reports.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "b" / "raw_reports.parquet"))
    assert sorted(r.child_value for r in p1_found(spark, str(tmp_path / "a")).collect()) == ["early", "end"]
    assert p1_found(spark, str(tmp_path / "b")).count() == 0


def write(spark, folder, cells, nodes, edges, study):
    spark.createDataFrame(cells, "cell_no BIGINT, cell_id STRING, loaded_at TIMESTAMP, deleted_at TIMESTAMP").write.parquet(f"{folder}/cells.parquet")
    spark.createDataFrame(nodes, "fit_id STRING, node_no BIGINT, cell_id STRING, loaded_at TIMESTAMP, deleted_at TIMESTAMP").write.parquet(f"{folder}/fit_cells.parquet")
    spark.createDataFrame(edges, "edge_no BIGINT, fit_id STRING, source BIGINT, target BIGINT, recorded_at TIMESTAMP").write.parquet(f"{folder}/fit_edges.parquet")
    spark.createDataFrame(study, "obs_no BIGINT, cell_id STRING, recorded_at TIMESTAMP").write.parquet(f"{folder}/study_cells.parquet")


def failing(spark, folder):
    return sorted((r.ref_table, r.ref_field, r.ref_no, r.reason) for r in p7_found(spark, folder).collect())


@pytest.mark.parametrize("bits", [orphans.MAX_BITS, 1])  # one filter, and a filter for each part of the parents
def test_reasons_of_failing_references(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(orphans, "MAX_BITS", bits)
    if bits == 1:
        monkeypatch.setattr(orphans, "PART_BITS", 16)
        monkeypatch.setattr(orphans, "SLICE", 2)
    cells = [(1, "CL-1", T[4], None), (1, "CL-1", T[10], T[12]), (2, "cl-2 ", T[0], None), (2, "cl-2 ", T[0], None)]
    nodes = [("A", 10, "CL-1", T[11], None), ("A", 11, "CL-9", T[11], None), ("A", 11, " ", T[12], None), ("B", 12, "Cl-2", T[0], T[5]), ("A", 13, "CL-1", T[13], None)]
    edges = [(1, "A", 10, 11, T[12]), (1, "A", 10, 11, T[12]), (2, "A", 12, None, T[12]), (3, "B", 12, 12, T[6]), (4, "A", 10, 10, T[2]), (5, None, 10, 99, T[2])]
    study = [(1, " cl-1 ", T[11]), (2, "CL-1", T[2]), (3, "CL-1", T[12]), (4, "CL-7", T[1]), (5, None, T[1]), (6, "", T[1]), (6, "", T[1]), (7, "CL-7", T[1]), (7, "CL-7", T[1])]
    write(spark, str(tmp_path), cells, nodes, edges, study)
    assert failing(spark, str(tmp_path)) == sorted([
        ("study_cells", "cell_id", 2, "late"), ("study_cells", "cell_id", 3, "deleted"), ("study_cells", "cell_id", 4, "missing"), ("study_cells", "cell_id", 7, "missing"), ("fit_cells", "cell_id", 13, "deleted"),
        ("fit_edges", "source", 2, "missing"), ("fit_edges", "source", 3, "deleted"), ("fit_edges", "target", 3, "deleted"), ("fit_edges", "source", 4, "late"), ("fit_edges", "target", 4, "late"),
    ])


def test_empty_parents_and_references(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [(1, "A", 1, 2, T[0])], [(1, "x", T[0])])
    assert failing(spark, str(tmp_path)) == [("fit_edges", "source", 1, "missing"), ("fit_edges", "target", 1, "missing"), ("study_cells", "cell_id", 1, "missing")]


def test_filters_of_parts_prove_most_orphans_and_lose_no_parent(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PART_BITS", 1 << 12)
    monkeypatch.setattr(orphans, "SLICE", 500)
    parents = spark.range(0, 4000, 2).select(F.col("id").alias("k"))
    refs = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("bloom"), F.lit("x").alias("part")).unionByName(spark.range(3000).select(F.lit(2).cast("bigint").alias("k"), F.lit(1).alias("bloom"), F.lit("x").alias("part")))
    flagged = orphans.flag_by_parts(refs, parents, ["k"], 2000).groupBy((F.col("k") % 2 == 0).alias("there"), "_maybe").count().collect()
    got = {(r.there, r._maybe): r["count"] for r in flagged}
    assert got[True, True] == 5000 and (True, False) not in got and got[False, False] > 1900
