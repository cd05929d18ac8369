"""Nearest vectors, similarity groups and digests against brute force."""

import numpy as np
import pytest

from fellscape.llm.clusters import describe_groups, jaccard, min_hash_bands, reach, similarity_groups, token_cells
from fellscape.llm.quantile_digest import build_digests, digest_quantiles, leaf_of, merge_digests, value_of
from fellscape.llm.vectors import nearest_vectors, scan


def brute(x, keys, k, limit):
    out = set()
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((keys, d2)) if j != i and d2[j] <= limit * limit][:k]
        out |= {(int(keys[i]), int(keys[j])) for j in order}
    return out


def frame(spark, x, keys, scope=""):
    return spark.createDataFrame([(scope, int(k), [float(v) for v in r]) for k, r in zip(keys, x)], "scope STRING, key BIGINT, vec ARRAY<DOUBLE>")


@pytest.mark.parametrize("limit", [2.0, None])
def test_nearest_vectors_recall(spark, limit):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 24)) * 5
    x = (centers[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.2).round(6)
    keys = rng.permutation(100_000)[:3000]
    got = {(r.key, r.neighbour) for r in nearest_vectors(frame(spark, x, keys), 24, 5, limit, list_size=64).collect()}
    want = brute(x, keys, 5, limit or 1e9)
    assert len(got & want) / len(want) >= 0.99 and len(got) <= len(want)


def test_copies_ties_and_scopes(spark):
    x = np.array([[0.0, 0.0]] * 40 + [[1.0, 0.0], [0.0, 1.0], [-0.0, 0.0]])
    keys = np.arange(len(x)) + 10
    rows = frame(spark, x, keys, "a").unionByName(frame(spark, np.array([[0.0, 0.0]]), np.array([500]), "b"))
    got = {(r.key, r.neighbour) for r in nearest_vectors(rows, 2, 5, None).where("scope = 'a'").collect()}
    assert got == brute(x, keys, 5, 1e9)
    assert nearest_vectors(rows, 2, 5, None).where("scope = 'b'").count() == 0


def test_nothing_to_search(spark):
    assert nearest_vectors(frame(spark, np.zeros((0, 2)), []), 2, 5, 1.0).count() == 0


def test_crowded_list_is_scanned_in_chunks(spark, monkeypatch):
    import fellscape.llm.vectors as v

    monkeypatch.setattr(v, "CHUNK", 100)
    rng = np.random.default_rng(3)
    x, keys = rng.normal(size=(700, 3)), np.arange(700)
    assert {(r.key, r.neighbour) for r in nearest_vectors(frame(spark, x, keys), 3, 5, 0.5).collect()} == brute(x, keys, 5, 0.5)


@pytest.mark.parametrize("limit", [0.5, None])
def test_crowded_lists_are_cut_into_cells(spark, monkeypatch, limit):
    import fellscape.llm.vectors as v

    monkeypatch.setattr(v, "CHUNK", 60)
    monkeypatch.setattr(v, "MAX_LISTS", 6)
    rng = np.random.default_rng(4)
    x, keys = np.concatenate([rng.normal(size=(900, 3)), rng.normal(size=(90, 3)) * 0.01]), np.arange(990)
    packed = v._packed(frame(spark, x, keys), 3)
    index = v.build_index(packed, 40)
    assert index.cells.count() > 3 and index.placed.count() == 990
    got = [(r.key, r.neighbour) for r in nearest_vectors(frame(spark, x, keys), 3, 5, limit, list_size=40).collect()]
    want = brute(x, keys, 5, limit or 1e9)
    assert len(got) == len(set(got)) == len(want) and len(set(got) & want) / len(want) > 0.99


def test_scan_abandons_but_does_not_lose():
    rng = np.random.default_rng(0)
    x, keys = rng.normal(size=(800, 24)), np.arange(800)
    i, j, d2 = scan(x, keys, np.full(800, np.inf), x, keys, 5)
    want = brute(x, keys, 5, 1e9)
    assert len(set(zip(i.tolist(), j.tolist())) & want) / len(want) > 0.99
    assert np.allclose(d2, ((x[i] - x[j]) ** 2).sum(1))


def chained(x, limit):
    label = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= limit * limit):
            if label[j] != label[i]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


def test_reach_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * 4
    label, a, b = reach(x, 0.6)
    want = chained(x, 0.6)
    assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label)) == len(set(want))
    assert all(((x[i] - x[j]) ** 2).sum() <= 0.36 + 1e-9 for i, j in zip(a, b)) and len(a) == 400 - len(set(label))


def test_similarity_groups_and_description(spark):
    rng = np.random.default_rng(7)
    sizes = [1, 2, 3, 40, 200, 5]
    x = np.concatenate([rng.normal(size=(1, 24)) * 6 + rng.normal(size=(s, 24)) * 0.15 for s in sizes] + [np.full((30, 24), 50.0)])
    keys = rng.permutation(5000)[: len(x)]
    rows = frame(spark, x, keys).drop("scope")
    got = {r.key: r.group for r in similarity_groups(rows, 24, 2.0).collect()}
    label = chained(x, 2.0)
    assert got == {int(k): int(min(keys[label == m])) for k, m in zip(keys, label)}
    about = describe_groups(similarity_groups(rows, 24, 2.0), rows, 24, 2.0).collect()
    assert sorted(r["size"] for r in about) == sorted([*sizes, 30])
    assert similarity_groups(rows.limit(0), 24, 2.0).count() == 0


def test_big_buckets_are_cut_into_pairs_of_chunks(spark, monkeypatch):
    import fellscape.llm.clusters as c

    monkeypatch.setattr(c, "BUCKET", 20)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(90, 24)) * 0.1, rng.normal(size=(90, 24)) * 0.1 + 9])
    got = {r.group for r in similarity_groups(frame(spark, x, np.arange(180)).drop("scope"), 24, 2.0).collect()}
    assert got == {0, 90}


def stars(x, keys, limit, loose=0.5):
    """Clusters of one group by brute force: (medoid, smallest key, size, three typical keys)."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= limit * limit + 1e-9
    degree = near.sum(1)
    center = np.full(len(x), keys[np.lexsort((keys, -degree))[0]])
    if degree.max() < loose * len(x):
        left = np.ones(len(x), bool)
        while left.any():
            heads = [i for i in np.flatnonzero(left) if all((degree[i], -keys[i]) >= (degree[j], -keys[j]) for j in np.flatnonzero(near[i] & left))]
            for i in np.flatnonzero(left):
                mine = [h for h in heads if near[i, h]]
                if mine:
                    center[i] = keys[max(mine, key=lambda h: (degree[h], -keys[h]))]
                    left[i] = False
    out = []
    for c in np.unique(center):
        m = np.flatnonzero(center == c)
        d = near[np.ix_(m, m)].sum(1)
        out.append((int(min(keys[m])), len(m), [int(k) for k in keys[m][np.lexsort((keys[m], -d))[:3]]]))
    return sorted(out)


@pytest.mark.parametrize("kind", ["chain", "cloud", "dense", "copies"])
def test_loose_groups_split_around_their_medoids(spark, monkeypatch, kind):
    import fellscape.llm.vectors as v

    monkeypatch.setattr(v, "CHUNK", 50)
    monkeypatch.setattr(v, "LIST_SIZE", 40)
    rng = np.random.default_rng(6)
    x = {
        "chain": np.array([[i * 1.5] + [0.0] * 23 for i in range(120)]), "cloud": np.pad(rng.normal(size=(400, 3)) * 2.5, ((0, 0), (0, 21))),
        "dense": np.pad(rng.normal(size=(300, 3)) * 0.6, ((0, 0), (0, 21))), "copies": np.pad(np.concatenate([rng.normal(size=(60, 2)) * 2.5, np.full((40, 2), 3.0)]), ((0, 0), (0, 22))),
    }[kind].round(6)
    keys = rng.permutation(1000)[: len(x)]
    groups = spark.createDataFrame([(int(k), int(keys.min())) for k in keys], "key BIGINT, `group` BIGINT")
    got = describe_groups(groups, frame(spark, x, keys).drop("scope"), 24, 2.0).collect()
    assert sorted((r["cluster"], r["size"], list(r["typical"])) for r in got) == stars(x, keys, 2.0)


def test_min_hash_agrees_with_jaccard():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 24)) * 4
    y = x + rng.normal(size=x.shape) * 0.2
    a, b = token_cells(x, 2.0), token_cells(y, 2.0)
    j = jaccard(a, b)
    same = (min_hash_bands(a) == min_hash_bands(b)).mean(1)
    assert abs(same.mean() - (j**5).mean()) < 0.05 and (same > 0).mean() > 0.98


def rank_error(values, got, q):
    values = np.sort(values)
    lo, hi = np.searchsorted(values, got * (1 - 3e-4) - 1e-300), np.searchsorted(values, got * (1 + 3e-4), "right")
    want = np.ceil(q * len(values))
    return max(0.0, lo + 1 - want, want - hi) / len(values)


def test_digest_error_and_merging_of_days(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=60_000) * 3)
    rows = [("g", str(i % 7), float(v)) for i, v in enumerate(x)] + [("g", "1", float("nan")), ("g", "1", None), ("g", "2", float("inf")), (None, "1", 1.0)] + [("h", "1", 5.0)] * 3
    df = spark.createDataFrame(rows, "g STRING, day STRING, x DOUBLE")
    qs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    days = build_digests(df, ["g", "day"], "x", 0.02)
    merged = merge_digests(days, ["g"], 0.02)
    for digest in (build_digests(df, ["g"], "x", 0.02), merged):
        out = {r.g: r for r in digest_quantiles(digest, ["g"], qs).collect()}
        assert out["g"].n == 60_000 and out["h"].n == 3 and abs(out["h"].p50 / 5 - 1) < 1e-3
        assert all(rank_error(x, out["g"][c], q) <= 0.02 for c, q in qs.items())
        assert digest.where("g = 'g'").count() < 60_000 / 4
    assert build_digests(df.limit(0), ["g"], "x").count() == 0


def test_leaves_keep_the_order():
    x = np.sort(np.r_[np.random.default_rng(0).normal(size=1000) * 10.0 ** np.arange(1000) ** 0.3, 0.0, -0.0, 1e-300, -1e-300])
    leaf = leaf_of(x)
    assert (np.diff(leaf) >= 0).all() and leaf.min() >= 0 and leaf.max() < 1 << 24
    big = np.abs(x) > 1e-200
    assert np.allclose(value_of(leaf)[big], x[big], rtol=3e-4)


def test_lonely_lists_without_a_limit(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 3)), rng.normal(size=(3, 3)) + 60.0])
    keys = np.arange(len(x))
    rows = [(r.key, r.neighbour) for r in nearest_vectors(frame(spark, x, keys), 3, 5, None, list_size=50).collect()]
    want = brute(x, keys, 5, 1e9)
    assert len(rows) == len(set(rows)) == len(want) and len(set(rows) & want) / len(want) > 0.99


def test_pairs_at_the_distance_limit_meet_in_a_band():
    """Recall of the candidates just at the limit, in 24 numbers."""
    import fellscape.llm.clusters as m

    rng = np.random.default_rng(1)
    x, d = 2 * rng.normal(size=(20_000, 24)), rng.normal(size=(20_000, 24))
    y = x + 2.0 * d / np.linalg.norm(d, axis=1)[:, None]
    met = m.min_hash_bands(m.token_cells(x, 2.0)) == m.min_hash_bands(m.token_cells(y, 2.0))
    assert met.any(1).mean() > 0.9985


def test_rounds_of_bands_link_pieces_and_free_their_disk(spark, monkeypatch):
    """Groups and a chain cut into many pieces; what the rounds shuffle does not stay on disk."""
    import time
    from pathlib import Path

    import fellscape.llm.clusters as c

    monkeypatch.setattr(c, "PIECE", 150, raising=False)
    monkeypatch.setattr(c, "LIST", 100, raising=False)
    monkeypatch.setattr(c, "ROUND", 1, raising=False)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(60, 24)) * 6
    x = np.concatenate([centers[rng.integers(0, 60, 2500)] + rng.normal(size=(2500, 24)) * 0.15, [[i * 0.9] + [40.0] * 23 for i in range(200)], rng.normal(size=(300, 24)) * 6])
    keys = rng.permutation(9000)[: len(x)]
    rows = frame(spark, x, keys).drop("scope").cache()
    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    used = lambda: sum(p.stat().st_size for d in dirs for p in d.rglob("shuffle_*.data"))
    rows.count()
    before = used()
    groups = similarity_groups(rows, 24, 2.0)
    time.sleep(2)  # files go a moment later
    left = used() - before
    assert {r.key: r.group for r in groups.collect()} == {int(k): int(min(keys[label == m])) for label in [chained(x, 2.0)] for k, m in zip(keys, label)}
    assert left < 4 * x.nbytes


def test_summaries_far_apart_are_not_asked_for():
    import fellscape.llm.clusters as c

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)) * 3
    q = c._sketch(x, 2.0)
    all_ = np.zeros(400, c._SUMMARY)
    all_["bucket"], all_["comp"], all_["lo"], all_["hi"] = np.arange(400) % 3, np.arange(400) // 5, q, q
    all_ = all_[np.lexsort((all_["lo"][:, 0], all_["bucket"]))]
    gap = np.maximum(np.abs(all_["lo"][:, None].astype(int) - all_["lo"][None]) - 1, 0)
    close = (gap**2).sum(2) <= c.STEPS**2
    close &= (all_["bucket"][:, None] == all_["bucket"]) & (all_["comp"][:, None] != all_["comp"])
    assert (c.near_summaries(all_) == close.any(1)).all() and 0 < close.any(1).sum() < 400
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    gap = np.maximum(np.abs(q[:, None].astype(int) - q[None]) - 1, 0)
    assert ((gap**2).sum(2) <= c.STEPS**2)[d2 <= 4].all()
