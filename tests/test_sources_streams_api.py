"""Files, streams and the pipeline facade."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from fellscape.api import Config, analyze, exported, reduce_cells, simulate
from fellscape.sources import files as R
from fellscape.streaming import windows as W


@pytest.mark.parametrize(
    "name,text",
    [("a.json", "[[1, 2], [3, 4.5]]"), ("b.json", '{"data": [[1, 2], [3, 4.5]]}'), ("c.json", '{"matrix": [[1, 2], [3, 4.5]]}'), ("d.jsonl", "[1, 2]\n\n[3, 4.5]\n"), ("e.csv", "1,2\n\n3,4.5\n"), ("f.tsv", "1\t2\n3\t4.5\n")],
)
def test_matrix_formats(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    assert [(r.row, r.x) for r in R.read_matrix(spark, str(tmp_path / name)).orderBy("row").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.5])]


@pytest.mark.parametrize("form", ["csv", "tsv", "jsonl"])
def test_matrix_round_trip(spark, tmp_path, form):
    rows = spark.createDataFrame([(i, [float(i), i / 3]) for i in range(50)], "row BIGINT, x ARRAY<DOUBLE>")
    out = str(tmp_path / f"m.{form}")
    R.write_matrix(rows.repartition(4), out, form)
    got = sorted(r.x for r in R.read_matrix(spark, out).collect())
    assert got == [[float(i), pytest.approx(i / 3)] for i in range(50)]


def test_bundles(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps({"expression": [[1, 2], [3, 4]], "velocity": [[0, 1], [1, 0]], "cell_ids": ["a", "b"]}))
    bad.write_text(json.dumps({"expression": [[1, 2]]}))
    rows = R.read_bundle(spark, str(good))
    assert [(r.cell_id, r.label, r.vel) for r in rows.orderBy("idx").collect()] == [("a", "unlabeled", [0.0, 1.0]), ("b", "unlabeled", [1.0, 0.0])]
    R.check_rectangular(rows, "expr")
    with pytest.raises(ValueError):
        R.read_bundle(spark, str(bad))
    with pytest.raises(ValueError):
        R.check_rectangular(rows.withColumn("expr", F.when(F.col("idx") == 0, F.array(F.lit(1.0))).otherwise(F.col("expr"))), "expr")


def test_triplets_lineage_and_manifests(spark, tmp_path):
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n% c\n3 4 3\n1 1 5.5\n2 4 1\n3 2 7\n")
    got = {tuple(r) for r in R.read_triplets(spark, str(tmp_path / "m.mtx.gz"), genes=[0, 1]).collect()}
    assert got == {(0, 0, 5.5), (3, 1, 1.0)}
    (tmp_path / "l.tsv").write_text("Barcode\tOutcome\nx\tstem\n")
    assert tuple(R.read_lineage(spark, str(tmp_path / "l.tsv")).first()) == ("x", "stem")
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"donor_id": "d1", "score": 0.5}, {"donor": "d2", "prediction": 1}]}))
    rows = R.read_observations(spark, str(tmp_path / "o.json"), {"donor": ("string", ["donor", "donor_id"]), "p": ("double", ["prediction", "score"]), "none": ("string", ["absent"])})
    assert sorted(map(tuple, rows.collect()), key=str) == [("d1", 0.5, None), ("d2", 1.0, None)]


def events(spark, n=25):
    return spark.range(n).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"), F.col("id").alias("ordinal"), F.col("id").cast("double").alias("value"))


def test_count_windows_keep_the_tail(spark):
    got = {(r.source, r.window): (r.n, r.complete) for r in W.count_windows(events(spark), "source", "value", ["ordinal"], 8).collect()}
    assert got == {("a", 0): (8, True), ("a", 1): (8, True), ("a", 2): (4, False), ("b", 0): (5, False)}


def test_stream_gives_the_full_windows_of_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    for k, (lo, hi) in enumerate(((0, 7), (7, 18), (18, 25))):
        events(spark).where(F.col("ordinal").between(lo, hi - 1)).coalesce(1).write.parquet(str(src / f"part={k}"))
    schema = "source STRING, ordinal BIGINT, value DOUBLE"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = W.write_checkpoints(W.stream_count_windows(stream, "source", "ordinal", "value", 8), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = {(r.source, r.window): r["mean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = W.count_windows(events(spark), "source", "value", ["ordinal"], 8).where("complete")
    assert got == {(r.source, r.window): r["mean"] for r in batch.collect()}


def test_fnv_and_sessions(spark):
    assert W.fnv1a([]) == 0x811C9DC5 and W.fnv1a([1.0]) != W.fnv1a([2.0])
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:20:00'), (1, timestamp'2024-01-01 02:00:00') t(user, ts)")
    assert sorted(r.n for r in W.sessions(e, "ts", ["user"]).collect()) == [1, 2]


def test_online_landscape(spark, tmp_path):
    o = W.OnlineLandscape(spark, str(tmp_path / "cells"))
    o.update(events(spark, 10))
    o.update(events(spark, 5))
    assert o.snapshot().count() == 15 and o.diagnostics("value").first().n == 15


def test_pipeline_from_cells_to_report(spark, tmp_path):
    cells = simulate(spark, 120)
    config = Config(neighbors=8, dimensions=3)
    fit = analyze(reduce_cells(cells, 8, config), "stem", "erythroid", config)
    r = fit.report.first()
    assert r.cells == 120 and r.edges > 0 and r.attractors > 0 and r.entropy_production >= 0 and 0 <= r.committed_share <= 1
    q = {x.label: x.q for x in fit.nodes.groupBy("label").agg(F.avg("q").alias("q")).collect()}
    assert q["stem"] == 0 and q["erythroid"] == 1
    R.save_tables({"nodes": fit.nodes}, str(tmp_path))
    assert R.load_tables(spark, str(tmp_path), ["nodes"])["nodes"].count() == 120
    R.export_cells(exported(fit), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns[:5] == ["tw_id", "tw_stage", "tw_x", "tw_y", "tw_committor"]
    with pytest.raises(ValueError):
        Config(neighbors=0)
