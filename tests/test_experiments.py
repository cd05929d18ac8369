"""Studies, trials, replication and transport on rows small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from fellscape.operators import experiments as X

CELL = "cell_id STRING, donor BIGINT, replicate STRING, intervention STRING, fate STRING, p DOUBLE, viable BOOLEAN, lineage_id STRING, timepoint STRING, orthogonal_fate STRING"


def cells(spark, treated=(0.80, 0.82, 0.79), control=(0.50, 0.51, 0.49), n=10, extra=()):
    rows = [(f"{arm}{d}-{k}", d, "r1", arm, None, v, True, f"L{k}", "endpoint", None) for arm, vs in (("program_A", treated), ("vehicle", control)) for d, v in enumerate(vs) for k in range(n)]
    return spark.createDataFrame([*rows, *extra], CELL)


def judged(df):
    groups = X.study_groups(df, "erythroid")
    effects = X.study_effects(groups, "vehicle", 100)
    return groups, effects, X.study_report(X.study_errors(df), effects, groups, "vehicle").first()


def test_a_consistent_effect_is_supported(spark):
    extra = [("x", 0, "r1", "program_A", None, 0.0, False, "L", "endpoint", None), ("y", 0, "r1", "program_A", None, 0.0, True, "L", "day 2", None)]  # not viable, not at the endpoint
    groups, effects, report = judged(cells(spark, extra=extra))
    a = groups.where("intervention = 'program_A' and donor = 0").first()
    assert (a.cells, a.viable_cells, a.lineages) == (11, 10, 10) and a.target_fraction == pytest.approx(0.8) and a.viability_fraction == pytest.approx(10 / 11)
    e = effects.first()
    assert (e.donors, e.status, e.warnings, e.consistent) == (3, "experimentally_supported_candidate", "", True)
    assert e.effect == pytest.approx(0.303333, abs=1e-5) and 0.3 - 1e-9 <= e.low <= e.effect <= e.high <= 0.31 + 1e-9 and e.viability_effect == pytest.approx(-1 / 33)
    assert (report.status, report.blockers, report.supported) == ("experimentally_supported_candidate", "", 1)


def test_studies_that_are_not_supported(spark):
    assert judged(cells(spark, n=9))[1].first().status == "inconclusive_underpowered_groups"
    assert judged(cells(spark, (0.8, 0.8), (0.5, 0.5)))[1].first().status == "inconclusive_insufficient_replication"
    assert judged(cells(spark, (0.8, 0.4, 0.8)))[1].first().status == "inconclusive_or_falsified"
    only = cells(spark).where("intervention = 'program_A'")
    assert judged(only)[1].first().status == "not_comparable" and judged(only)[2].blockers == "missing_control_intervention"


def test_schema_errors(spark):
    bad = [("a", None, "", None, None, None, True, None, "endpoint", None), ("a", 1, "r", "vehicle", None, None, True, "L", "day 2", None)]
    got = dict(X.study_errors(spark.createDataFrame(bad, CELL), orthogonal=True).collect())
    assert got == {"missing_donor": 1, "missing_intervention": 1, "missing_replicate": 1, "missing_lineage": 1, "missing_outcome": 1, "missing_orthogonal_fate": 1, "duplicate_cell_ids": 1}
    assert dict(X.study_errors(spark.createDataFrame([], CELL)).collect()) == {"empty_study": 1}


def test_trial_gates(spark):
    rows = [(d, arm, v, 0.9, "L", None, "o") for d in range(3) for arm, v in (("control", 0.2), ("treatment", 0.7)) for _ in range(8)] + [(0, "treatment", 0.0, 0.1, "L", None, "o"), (None, "control", 0.1, 0.9, None, None, None), (1, "control", float("nan"), 0.9, None, None, None)]
    obs = spark.createDataFrame(rows, "donor BIGINT, intervention STRING, p DOUBLE, viability DOUBLE, lineage_id STRING, barcode_id STRING, orthogonal_fate STRING")
    groups = X.trial_groups(obs, "treatment", "control")
    r = X.trial_report(obs, groups, "treatment", "control", True, 100).first()
    assert (r.paired_donors, r.excluded, r.blockers, r.status) == (3, 2, "", "measured_intervention_result_ready_for_replication") and (r.effect, r.low, r.high) == pytest.approx((0.5, 0.5, 0.5))
    blocked = X.trial_report(obs.where("donor = 0"), groups.limit(0), "treatment", "control", False, 100).first()
    assert blocked.blockers == "missing_preregistration|too_few_donors|no_donor_with_both_arms" and blocked.effect is None


def test_copies_of_a_study_do_not_replicate_it(spark):
    rows = [(s, f"c{k}", k % 2, "v", float(k) * (1 if s != "b" else 2), float(k), True, f"L{k}") for s in ("a", "a2", "b") for k in range(10)]
    obs = spark.createDataFrame(rows, "study STRING, cell_id STRING, donor BIGINT, intervention STRING, p DOUBLE, y DOUBLE, viable BOOLEAN, lineage_id STRING")
    studies = X.replication_studies(obs, "study")
    assert sorted((r.study, r.eligible_cells, r.donors, round(r.spearman, 9)) for r in studies.collect()) == [("a", 10, 2, 1.0), ("b", 10, 2, 1.0)]
    r = X.replication_report(studies, "study", 50).first()
    assert (r.studies, r.eligible, r.blockers) == (2, 2, "") and r.effect == pytest.approx(1)
    assert X.replication_report(studies.where("study = 'a'"), "study", 50).first().blockers == "too_few_studies"


def test_a_negative_control_with_signal_blocks_transport(spark):
    rows = [(s, k, float(k), float(29 - k if s == "null" else k)) for s in ("a", "b", "null") for k in range(30)]
    per = X.transport_studies(spark.createDataFrame(rows, "study STRING, k BIGINT, p DOUBLE, y DOUBLE"), "study", "k", 40).withColumn("neg", F.col("study") == "null")
    got = {r.study: (round(r.spearman, 9), round(r.pearson, 9), r.recall) for r in per.collect()}
    assert got == {"a": (1.0, 1.0, 1.0), "b": (1.0, 1.0, 1.0), "null": (-1.0, -1.0, 0.0)}
    good = X.transport_report(per.where("not neg"), "neg").first()
    assert (good.studies, good.blockers, good.failed) == (2, "", 0) and good.spearman == pytest.approx(1) and good.i2 == 0
    assert "negative_control_signal_detected" in X.transport_report(per, "neg").first().blockers
