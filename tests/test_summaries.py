"""Evidence rules, actions and comparisons on small cases."""

import pytest

from fellscape.operators import summaries as S


def test_evidence_needs_parents_and_measurements(spark):
    nodes = spark.createDataFrame([("m", "measurement", "ok"), ("a", "analysis", "ok"), ("c1", "claim", "strong"), ("c2", "claim", "strong"), ("c3", "claim", "weak"), ("a2", "analysis", "ok")], "node_id STRING, kind STRING, status STRING")
    edges = spark.createDataFrame([("m", "a"), ("a", "c1"), ("a2", "c2"), ("a", "gone")], "source STRING, target STRING")
    got = {tuple(r) for r in S.evidence_blockers(nodes, edges).collect()}
    assert got == {("gone", "dangling_edge"), ("c3", "claim_without_parent"), ("c2", "unmeasured_claim")}


def test_action_of_a_path_along_its_drift_is_zero(spark):
    p = spark.createDataFrame([("a", i, 2.0 * i, 2.0) for i in range(5)] + [("b", i, 3.0 * i, 2.0) for i in range(5)], "g STRING, t INT, x DOUBLE, v DOUBLE")
    got = {r.g: r.action for r in S.path_action(p, ["g"], "t", ["x"], ["v"], 1.0, 0.5).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(2.0)}


def test_worst_of_diagnosis(spark):
    v = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.9, 0.2), (3, None, 0.9)], "id INT, a DOUBLE, b DOUBLE")
    assert {r.id: r.status for r in S.diagnose(v, "id", {"a": (0.5, 0.1), "b": (0.5, 0.1)}).collect()} == {1: "good", 2: "warning", 3: "critical"}


def test_equal_landscapes(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx INT, energy DOUBLE")
    r = S.compare_landscapes(a, a, ["idx"]).first()
    assert (r.n, r.rmse, r["shift"]) == (5, 0, 0) and r.pearson == pytest.approx(1)
    m = S.compare_energy_methods(a, a.selectExpr("idx", "'x' AS method", "-energy AS energy"), "idx", 0.2).first()
    assert (m.rho, m.recall) == (-1, 0)
