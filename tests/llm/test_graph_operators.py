"""Components, splits: brute force on small graphs, hot keys, nulls, ties, empty tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fellscape.llm.components import boruvka_components, star_components
from fellscape.llm.splits import assign_splits, digits_as_number, pool_number


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "a BIGINT, b BIGINT, component STRING")


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "reversed_path"])
def test_components_match_union_find(spark, kind):
    rng = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "reversed_path": [(100 - i, 99 - i) for i in range(60)],
        "star": [(500, i) for i in range(200)],
        "cycle": [(i, (i + 1) % 17) for i in range(17)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
    }[kind]
    want = union_find(pairs)
    df = edges(spark, pairs + pairs[:5])
    assert {r.node: r.component for r in boruvka_components(df, "a", "b").collect()} == want
    assert {r.node: r.component for r in star_components(df, "a", "b").collect()} == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components_of_any_graph(spark, pairs):
    assert {r.node: r.component for r in boruvka_components(edges(spark, pairs), "a", "b").collect()} == union_find(pairs)


def test_components_nulls_self_edges_scopes_and_empty(spark):
    rows = [("f", 1, 1), ("f", 2, None), ("f", 4, 3), ("g", 3, 9), (None, 5, 6), ("f", 4, 3)]
    df = spark.createDataFrame(rows, "fit STRING, a BIGINT, b BIGINT")
    got = {(r.fit, r.node, r.component) for r in boruvka_components(df, "a", "b", ["fit"]).collect()}
    assert got == {("f", 1, 1), ("f", 3, 3), ("f", 4, 3), ("g", 3, 3), ("g", 9, 3)}
    assert boruvka_components(df.limit(0), "a", "b", ["fit"]).count() == 0
    assert star_components(df.limit(0), "a", "b").count() == 0


def test_texts_of_donors_and_pools(spark):
    rows = [("D-0000-0346", "pool no. 125", 346, 125), ("#9", "P01040/r2", 9, 1040), ("D００００３２４６", "POOL_7 rep 3", 3246, 7), ("unknown", "rep 9", None, None), ("", "pooled", None, None),
            (None, None, None, None), (" D12 ", "p9-2", 12, 9), ("d7", "mixed pool", 7, None), ("9" * 30, "R2", "9" * 30, None), ("x", " P3 ", None, 3), ("1", "replicate-4", 1, None)]
    rows = [(d, r, *(None if x is None else str(x) for x in w)) for d, r, *w in rows]
    df = spark.createDataFrame(rows, "d STRING, r STRING, wd STRING, wp STRING")
    assert df.where(~digits_as_number(F.col("d")).eqNullSafe(F.col("wd"))).count() == 0
    assert df.where(~pool_number(F.col("r")).eqNullSafe(F.col("wp"))).count() == 0


def test_splits_keep_related_records_together(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(400), rng.choice([None, rng.randrange(150)])) for i in range(3000)] + [(9000, None, None), (9001, None, None), (9000, None, None)]
    df = spark.createDataFrame(rows, "id BIGINT, donor BIGINT, pool BIGINT").withColumn("split", F.lit("clash"))
    out = assign_splits(df, ["id"], ["donor", "pool"])
    got = {r.id: r for r in out.collect()}
    assert len(got) == out.count() == 3002
    want = union_find([x for i, d, p in rows for x in ([(f"r{i}", f"d{d}")] if d is not None else []) + ([(f"r{i}", f"p{p}")] if p is not None else [])])
    by = {}
    for i, _, _ in rows[:3000]:
        by.setdefault(want[f"r{i}"], set()).add((got[i].component, got[i].split))
    assert all(len(v) == 1 for v in by.values())
    assert got[9000].component != got[9001].component
    assert assign_splits(df.limit(0), ["id"], ["donor", "pool"]).count() == 0


def test_no_entity_is_out_of_range(spark):
    rows = [(1, -5, 7), (2, 9, 7), (3, 8, 7), (4, 1 << 62, None), (5, (1 << 63) - 1, 3), (6, -(1 << 63), 3), (7, 1 << 62, 4), (8, None, -5), (9, -5, None), (10, 5, None)]
    got = {r.id: r.component for r in assign_splits(spark.createDataFrame(rows, "id BIGINT, donor BIGINT, pool BIGINT"), ["id"], ["donor", "pool"]).collect()}
    parts = [{1, 2, 3, 9}, {4, 7}, {5, 6}, {8}, {10}]
    assert len(got) == 10 and len(set(got.values())) == len(parts) and all(len({got[i] for i in p}) == 1 for p in parts)


_ENTITY = st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([-(1 << 63), (1 << 63) - 1, 1 << 62, 1 << 61]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(_ENTITY, _ENTITY), min_size=1, max_size=12))
def test_no_shared_entity_crosses_splits(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id BIGINT, donor BIGINT, pool BIGINT")
    rows = {r.id: r for r in assign_splits(df, ["id"], ["donor", "pool"]).collect()}
    want = union_find([(f"r{i}", f"{k}{v}") for i, p in enumerate(pairs) for k, v in zip("dp", p) if v is not None] + [(f"r{i}", f"r{i}") for i in range(len(pairs))])
    assert len(rows) == len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            assert (rows[i].component == rows[j].component) == (want[f"r{i}"] == want[f"r{j}"])


def test_split_shares_are_reached(spark):
    df = spark.range(20000).select(F.col("id"), F.col("id").alias("donor"), F.lit(None).cast("bigint").alias("pool"))
    n = dict(assign_splits(df, ["id"], ["donor", "pool"]).groupBy("split").count().collect())
    assert abs(n["train"] / 20000 - 0.8) < 0.02 and abs(n["test"] / 20000 - 0.1) < 0.02
