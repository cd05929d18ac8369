"""Ranks, robust statistics, information, resampling and study operators."""

import math

import pytest
from pyspark.sql import functions as F

from fellscape.functions import scalar as S
from fellscape.operators import programs as P
from fellscape.operators import stats as A
from fellscape.operators import study as D


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx BIGINT, a DOUBLE, b DOUBLE")


@pytest.mark.parametrize(
    "rows,rho", [([(i, i * i) for i in range(6)], 1.0), ([(i, -i) for i in range(6)], -1.0), ([(1, 1), (1, 2), (2, 3), (2, 4)], 0.894427), ([(1, 1), (1, 2), (1, 3)], 0.0), ([(1, 1)], 0.0), ([(1.0, 2.0), (2.0, float("nan")), (3.0, 5.0), (2.0, None)], 1.0)]
)
def test_spearman(spark, rows, rho):
    df = pairs(spark, [tuple(None if v is None else float(v) for v in r) for r in rows])
    assert A.spearman(df, "a", "b").first().rho == pytest.approx(rho, abs=1e-6)


def test_ordinal_rank_breaks_ties_by_key(spark):
    df = pairs(spark, [(1.0, 2.0), (1.0, 1.0), (1.0, 0.0)])
    assert A.spearman_ordinal(df, "a", "b", "idx").first().rho == -1


def test_robust_values(spark):
    df = pairs(spark, [(float(x), 1.0) for x in (1, 2, 3, 4, 100)] + [(float("inf"), 1.0), (None, 1.0)])
    r = A.robust_summary(df, "a").first()
    assert (r.n, r.median, r.mad, r.mean) == (5, 3, 1, 22)
    assert A.weighted_quantile(df, "a", "b", "idx", 0.5).first().value == 3
    assert A.jackknife(df, "a").first().high == pytest.approx(27.25)


def test_scores_and_bins(spark):
    df = pairs(spark, [(0.0, 0.0), (1.0, 1.0), (0.5, 1.0), (0.55, 0.0)])
    assert A.scores(df, "a", "b").first().brier == pytest.approx((0.25 + 0.3025) / 4)
    bins = {r.bin: r.n for r in A.reliability_bins(df, "a", "b").collect()}
    assert bins == {0: 1, 9: 1, 5: 2}
    assert A.top_share_recall(df, "a", "b", "idx", 0.5).first().recall == 0.5  # 1.0 and 0.55 against 1.0 and 0.5


def test_information(spark):
    df = pairs(spark, [(float(i % 4), float(i % 4)) for i in range(64)])
    r = A.mutual_information(df, "a", "b", 4).first()
    assert r.mutual_information == pytest.approx(math.log(4)) and r.hx == pytest.approx(math.log(4))
    assert A.transfer_entropy(df, "a", "b", ["idx"], 4).first().transfer_entropy == pytest.approx(0, abs=1e-9)
    assert A.entropy_of(A.equal_width_bins(df.withColumn("a", F.lit(1.0)), ["a"]), ["a_bin"]).first().entropy == 0


def test_resampling_is_portable_and_centred(spark):
    df = pairs(spark, [(float(i), float(i % 2)) for i in range(50)])
    m = A.bootstrap_interval(A.bootstrap_means(df, "a", "idx", 40)).first()
    assert m.low < 24.5 < m.high and m.standard_error > 0
    assert [r.rep for r in A.bootstrap_means(df, "a", "idx", 3).orderBy("rep").collect()] == [0, 1, 2]
    p = A.permutation_test(df.withColumn("g", F.col("idx") < 25), "a", "g", "idx", 30).first()
    assert p.observed == -25 and p.p_value == pytest.approx(1 / 31)
    assert A.sign_flip_test(df.withColumn("a", F.lit(1.0)), "a", "idx", 30).first().p_value == pytest.approx(1 / 31)


def test_hash_uniform_is_fixed(spark):
    assert spark.range(1).select(F.conv(F.substring(F.md5(F.lit("7:3")), 1, 8), 16, 10).alias("h")).first().h == "372119001"


def test_density_profile(spark):
    df = pairs(spark, [(0.1, 0.0)] * 5 + [(0.9, 0.0)] * 5)
    f = {r.at: r.free_energy for r in A.kde_profile(df, "a").collect()}
    assert min(f.values()) == 0 and f[30] > 1 and len(f) == 60


def test_gene_names_and_programs(spark):
    g = spark.createDataFrame([("mt-Nd1 ",), ("Hla_A",), ("MT",)], "n STRING").select(S.gene_name("n").alias("g"))
    assert [r.g for r in g.collect()] == ["ND1", "HLAA", "MT"]
    a = P.alias_table(spark.createDataFrame([("p", "b;A|mt-b|")], "program STRING, genes STRING"), "program", "genes")
    assert {(r.gene, r.position) for r in a.collect()} == {("B", 0), ("A", 1)}
    cells = spark.createDataFrame([(1, [5.0, 5.0, 1.0, 2.0, 3.0, None])], "cell BIGINT, x ARRAY<DOUBLE>")
    r = P.program_scores(P.long_genes(cells, "cell", "x"), spark.createDataFrame([("p", 0), ("p", 1), ("p", 9)], "program STRING, gene INT"), "cell").first()
    assert (r.score, r.z, round(r.coverage, 4)) == (5.0, 3.0, 0.6667)


def test_principal_axes_have_fixed_signs(spark):
    cells = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "cell BIGINT, x ARRAY<DOUBLE>")
    out, axes = P.principal_axes(cells, "x", 3, 1)
    assert axes[0] == pytest.approx([1 / 5**0.5, 2 / 5**0.5, 0], abs=1e-9)
    assert out.agg(F.var_samp("pc0")).first()[0] == pytest.approx(5 * 55 / 6)


def test_donor_effects_pair_donors(spark):
    rows = [(d, arm, v) for d, t, c in (("a", 0.8, 0.5), ("b", 0.82, 0.51), ("c", 0.79, 0.49)) for arm, v in (("A", t), ("vehicle", c))] + [("d", "A", 0.1), (None, "A", 0.0)]
    e = D.donor_effects(spark.createDataFrame(rows, "donor STRING, arm STRING, p DOUBLE"), "arm", "donor", "p", "vehicle").first()
    assert (e.donors, e.positive) == (3, 1.0) and e.effect == pytest.approx(0.303333, abs=1e-5)


def test_ids_duplicates_gates(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k STRING") for xs in (["a", "b", "b", None], ["b", "c", "d"]))
    assert tuple(D.reconcile(a, b, "k").first()) == (1, 1, 2)
    assert tuple(D.reconcile(a.limit(0), b.limit(0), "k").first()) == (0, 0, 0)
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", "z")], "id BIGINT, u STRING, v STRING")
    assert sorted(r.id for r in D.keep_first(df, ["u", "v"], "id").collect()) == [1, 3]
    g = {r.id: (r.blockers, r.decision) for r in D.gate(df, "id", {"no_v": "v is null", "early": "id < 2"}).collect()}
    assert g == {1: ("early|no_v", "blocked"), 2: ("no_v", "blocked"), 3: ("", "pass")}


def test_path_ensemble_of_shifted_gaussians(spark):
    rows = [("p", "F", 1 + 0.04 * i) for i in range(6)] + [("p", "R", -1 - 0.04 * i) for i in range(6)]
    r = D.path_ensemble(spark.createDataFrame(rows, "protocol STRING, direction STRING, work DOUBLE"), ["protocol"], "direction", "F").first()
    assert r.forward == pytest.approx(1.1, abs=0.01) and r.reverse == pytest.approx(1.1, abs=0.01) and r.gap < 0.01


def test_transportability_of_equal_studies(spark):
    r = D.transportability(spark.createDataFrame([(0.5, 30), (0.5, 60), (0.5, 2)], "rho DOUBLE, n INT")).first()
    assert (r.k, r.i2, r.sign_consistency) == (2, 0, 1) and r.pooled == pytest.approx(0.5)
