"""Replicates as a column, and the noise-matched test of circulation."""

import numpy as np
import pytest

from fellscape.operators import ensembles as M


def chain(spark, n=12):
    nodes = spark.createDataFrame([("g", i, float(abs(i - 6)) * -0.2, "source" if i == 0 else "target" if i == n - 1 else None) for i in range(n)], "g STRING, idx BIGINT, energy DOUBLE, role STRING")
    edges = spark.createDataFrame([("g", a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "g STRING, src BIGINT, dst BIGINT")
    return nodes, edges


def test_whole_subsets_agree(spark):
    q = M.commitment_ensemble(*chain(spark), ["g"], 3, 1.1, 40)
    s = {r.idx: r for r in M.ensemble_summary(q, ["g"]).collect()}
    assert all(r.n == 3 and r.sd == pytest.approx(0, abs=1e-9) for r in s.values()) and s[0]["mean"] == 0 and s[11]["mean"] == 1
    assert [r.rho for r in M.rank_agreement(q, ["g"]).collect()] == pytest.approx([1.0] * 3)
    b = M.resolved_barrier(q.where("rep = 0"), ["g"], 5).first()
    assert b.raw > 0 and b.standard_error > 0
    assert {r.verdict for r in M.robustness(*chain(spark), ["g"], [1.0, 0.5], 60).collect()} == {"stable"}


def test_subsets_leave_out_some(spark):
    n = M.subsets(spark.range(1000), "id", 2, 0.8).groupBy("rep").count().collect()
    assert all(760 < r["count"] < 840 for r in n)


def test_bootstrap_energy_has_no_spread_at_the_source(spark):
    e = spark.createDataFrame([("g", 0, i, float(i)) for i in range(1, 6)] + [("g", i, 9, 1.0) for i in range(1, 6)], "g STRING, src BIGINT, dst BIGINT, work DOUBLE")
    r = {x.idx: x for x in M.bootstrap_energy(spark.createDataFrame([("g", 0)], "g STRING, idx BIGINT"), e, "g", 8).collect()}
    assert r[0].sd == 0 and r[9].sd > 0


def test_circulation_stands_out_of_matched_noise(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 2))
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), 1)[:, 1:9]
    i, j = np.repeat(np.arange(160), 8), near.ravel()
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in zip(i, j)})
    p = spark.createDataFrame([("g", a, b) for a, b in pairs], "g STRING, i BIGINT, j BIGINT")
    z = []
    for omega in (0.0, 2.0):
        v = -x - omega * np.c_[x[:, 1], -x[:, 0]]
        pts = spark.createDataFrame([("g", k, *map(float, (*x[k], *v[k]))) for k in range(160)], "g STRING, idx BIGINT, x0 DOUBLE, x1 DOUBLE, v0 DOUBLE, v1 DOUBLE")
        z.append(M.noise_matched(pts, p, 2, "g", 6).first().z)
    assert z[1] > 2 and z[1] > z[0]


def test_prototypes(spark):
    p = spark.createDataFrame([(0, 0.0, "a"), (1, 0.2, "a"), (2, 5.0, "b"), (3, 4.0, None)], "idx BIGINT, x0 DOUBLE, label STRING")
    r = {x.idx: x for x in M.fate_prototypes(p, ["x0"]).collect()}
    assert r[0].fate == "a" and r[3].fate == "b" and r[2].probability > 0.9 and r[3].entropy > r[2].entropy
