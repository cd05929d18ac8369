"""Queries of statistics, studies, trials, evidence, streams and transport."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite
from fellscape.operators import stats as S
from fellscape.operators import study as D
from fellscape.operators import transport as O
from fellscape.operators.programs import alias_table
from fellscape.plans.base import XS, points, rounded, rounded_sql
from fellscape.session import table
from fellscape.streaming import windows as W

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ observation tables

_OBS = """st AS (SELECT DISTINCT obs_no, cell_id, regexp_replace(coalesce(donor, ''), '[^0-9]', '', 'g') AS dn, intervention, fate, target_probability, viable, lineage_id, dose, orthogonal_fate FROM study_cells),
ob AS (SELECT obs_no, cell_id, CASE WHEN dn = '' THEN NULL ELSE dn::BIGINT END AS donor, intervention, fate, target_probability AS p, viable, lineage_id, dose, orthogonal_fate,
  CASE WHEN fate IS NULL THEN NULL WHEN fate = 'erythroid' THEN 1.0 ELSE 0.0 END AS y FROM st),
td AS (SELECT DISTINCT trial_no, cell_id, regexp_replace(coalesce(donor_id, ''), '[^0-9]', '', 'g') AS dn, intervention, fate_probability AS p, viability, lineage_id, orthogonal_fate FROM trial_observations),
tr AS (SELECT trial_no, cell_id, CASE WHEN dn = '' THEN NULL ELSE dn::BIGINT END AS donor, intervention, p, viability, lineage_id, orthogonal_fate FROM td)"""


def _number(c: str):
    d = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^0-9]", "")
    return F.when(d != "", d.cast("bigint"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Study cells, each delivered row once, with donor number and outcome."""
    s = table(spark, folder, "study_cells").select("obs_no", "cell_id", _number("donor").alias("donor"), "intervention", "fate", F.col("target_probability").alias("p"), "viable", "lineage_id", "dose", "orthogonal_fate").distinct()
    return s.withColumn("y", F.when(F.col("fate").isNull(), None).when(F.col("fate") == "erythroid", 1.0).otherwise(0.0))


def trials(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "trial_observations")
    return t.select("trial_no", "cell_id", _number("donor_id").alias("donor"), "intervention", F.col("fate_probability").alias("p"), "viability", "lineage_id", "orthogonal_fate").distinct()


_RK = _OBS + ", c AS (SELECT intervention, obs_no, p, dose FROM ob WHERE isfinite(p) AND isfinite(dose)), r AS (SELECT *, rank() OVER (PARTITION BY intervention ORDER BY p) + (count(*) OVER (PARTITION BY intervention, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY intervention ORDER BY dose) + (count(*) OVER (PARTITION BY intervention, dose) - 1) / 2.0 AS rd FROM c)"


@query(rounded_sql(_RK, "intervention; count(*) AS n; ~CASE WHEN var_pop(rp) = 0 OR var_pop(rd) = 0 OR count(*) < 2 THEN 0 ELSE corr(rp, rd) END AS rho", "FROM r GROUP BY intervention"))
def spearman_average(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of target probability and dose per intervention, ties averaged."""
    return rounded(S.spearman(observations(spark, folder), "p", "dose", ["intervention"]))


@query(rounded_sql(_OBS + ", c AS (SELECT intervention, row_number() OVER (PARTITION BY intervention ORDER BY p, obs_no) - row_number() OVER (PARTITION BY intervention ORDER BY dose, obs_no) AS d FROM ob WHERE isfinite(p) AND isfinite(dose))",
    "intervention; count(*) AS n; ~CASE WHEN count(*) < 2 THEN 0 ELSE 1 - 6.0 * sum(d * d) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS rho", "FROM c GROUP BY intervention"))
def spearman_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.spearman_ordinal(observations(spark, folder), "p", "dose", "obs_no", ["intervention"]))


@query(rounded_sql("b AS (SELECT l_returnflag AS flag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)",
    "l_returnflag AS flag; count(*) AS n; ~avg(l_extendedprice) AS mean; ~any_value(m) AS median; ~median(abs(l_extendedprice - m)) AS mad; ~quantile_cont(l_extendedprice, 0.05) AS p05; ~quantile_cont(l_extendedprice, 0.95) AS p95; ~stddev_samp(l_extendedprice) AS sd",
    "FROM lineitem JOIN b ON flag = l_returnflag GROUP BY l_returnflag", 3))
def robust_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.robust_summary(table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", ["flag"]), 3)


@query(rounded_sql("b AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY 1)",
    "flag; ~avg(least(greatest(l_extendedprice, lo), hi)) AS winsorized_mean", "FROM lineitem JOIN b ON flag = l_returnflag GROUP BY flag", 3))
def winsorized_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.winsorized_mean(table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", ["flag"]), 3)


@query("""WITH k AS (SELECT l_returnflag AS flag, l_extendedprice AS x, l_quantity AS w, l_orderkey * 8 + l_linenumber AS key FROM lineitem),
c AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY x, key ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY flag) AS t FROM k WHERE w > 0) SELECT flag, min(x) AS value FROM c WHERE c >= 0.75 * t GROUP BY flag""")
def weighted_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """Price at three quarters of the quantity."""
    k = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    return S.weighted_quantile(k, "x", "w", "key", 0.75, ["flag"])


@query(rounded_sql("k AS (SELECT l_returnflag AS flag, l_discount AS x, l_quantity AS w FROM lineitem WHERE l_quantity > 0)",
    "flag; ~sum(w * x) / sum(w) AS weighted_mean; ~sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS weighted_variance; ~sum(w) * sum(w) / sum(w * w) AS ess; ~CASE WHEN avg(x) <> 0 THEN coalesce(stddev_samp(x), 0) / abs(avg(x)) ELSE 0 END AS variation", "FROM k GROUP BY flag"))
def weighted_moments(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("w"))
    return rounded(S.weighted_moments(k, "x", "w", ["flag"]))


@query(rounded_sql(_OBS, "intervention; count(p) AS n; ~(sum(p) - max(p)) / (count(p) - 1) AS low; ~(sum(p) - min(p)) / (count(p) - 1) AS high; ~sqrt(greatest(0, sum(p * p) - sum(p) ** 2 / count(p)) / (count(p)::DOUBLE * (count(p) - 1))) AS standard_error", "FROM ob WHERE isfinite(p) GROUP BY intervention HAVING count(p) > 1"))
def jackknife(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.jackknife(observations(spark, folder), "p", ["intervention"]))


_YP = _OBS + ", py AS (SELECT intervention, obs_no, p, y, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM ob WHERE isfinite(p) AND y IS NOT NULL)"


@query(rounded_sql(_YP, "intervention; count(*) AS n; ~avg((p - y) ** 2) AS brier; ~avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss; ~avg(abs(p - y)) AS mae; ~sqrt(avg((p - y) ** 2)) AS rmse", "FROM py GROUP BY intervention"))
def prediction_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Brier score, log loss and errors of the target probability."""
    return rounded(S.scores(observations(spark, folder), "p", "y", ["intervention"]))


_BIN = _YP + ", bn AS (SELECT intervention, least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed, abs(avg(p) - avg(y)) AS gap FROM py WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2)"


@query(rounded_sql(_BIN, "intervention; bin; n; ~predicted AS predicted; ~observed AS observed; ~gap AS gap", "FROM bn"))
def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.reliability_bins(observations(spark, folder), "p", "y", 10, ["intervention"]))


@query(rounded_sql(_BIN, "intervention; ~sum(gap * n) / sum(n) AS ece; ~max(gap) AS mce", "FROM bn GROUP BY intervention"))
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.calibration_error(S.reliability_bins(observations(spark, folder), "p", "y", 10, ["intervention"]), ["intervention"]))


@query(rounded_sql(_YP + """, rk AS (SELECT intervention, ceil(0.1 * count(*) OVER (PARTITION BY intervention)) AS k, row_number() OVER (PARTITION BY intervention ORDER BY p DESC, obs_no) AS rp,
 row_number() OVER (PARTITION BY intervention ORDER BY y DESC, obs_no) AS ry FROM py)""", "intervention; max(k)::BIGINT AS k; ~sum((rp <= k AND ry <= k)::INT) / max(k) AS recall", "FROM rk GROUP BY intervention"))  # fmt: skip
def top_decile_recall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.top_share_recall(observations(spark, folder), "p", "y", "obs_no", 0.1, ["intervention"]))


@query(rounded_sql(_OBS, "intervention; count(*) AS n; ~regr_slope(p, dose) AS slope; ~regr_intercept(p, dose) AS intercept; ~regr_r2(p, dose) AS r2; ~sqrt(var_pop(p) * (1 - regr_r2(p, dose))) AS rmse; ~min(dose) AS x_min; ~max(dose) AS x_max", "FROM ob WHERE isfinite(p) AND isfinite(dose) GROUP BY intervention"))
def calibration_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.least_squares(observations(spark, folder), "dose", "p", ["intervention"]))


_EV = """ev AS (SELECT event_type, event_id, ts, value, extract(hour FROM ts)::DOUBLE AS hr FROM events WHERE isfinite(value)),
ed AS (SELECT event_type, min(value) AS vl, (max(value) - min(value)) / 16 AS vw, min(hr) AS hl, (max(hr) - min(hr)) / 16 AS hw FROM ev GROUP BY 1),
bi AS (SELECT event_type, event_id, ts, CASE WHEN vw > 0 THEN least(15, floor((value - vl) / vw)) ELSE 0 END AS vb, CASE WHEN hw > 0 THEN least(15, floor((hr - hl) / hw)) ELSE 0 END AS hb FROM ev JOIN ed USING (event_type))"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_type", "event_id", "ts", "value", F.hour("ts").cast("double").alias("hr"))


_H = "(SELECT event_type, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT event_type, count(*) AS n FROM {t} GROUP BY event_type, {c}) GROUP BY event_type)"


@query(rounded_sql(_EV + ", hn AS (SELECT event_type, count(*) AS n FROM bi GROUP BY event_type, vb)", "event_type; ~ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy; sum(n)::BIGINT AS n", "FROM hn GROUP BY event_type"))
def histogram_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.entropy_of(S.equal_width_bins(_events(spark, folder).where(finite("value")), ["value"], 16, ["event_type"]), ["value_bin"], ["event_type"]))


@query(rounded_sql(_EV + f", x AS {_H.format(t='bi', c='vb')}, y AS {_H.format(t='bi', c='hb')}, z AS {_H.format(t='bi', c='vb, hb')}, ct AS (SELECT event_type, count(*) AS n FROM bi GROUP BY 1)",
    "event_type; n; ~x.h AS hx; ~y.h AS hy; ~greatest(0, x.h + y.h - z.h) AS mutual_information", "FROM ct JOIN x USING (event_type) JOIN y USING (event_type) JOIN z USING (event_type)"))
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    """Information between an event's value and its hour."""
    return rounded(S.mutual_information(_events(spark, folder), "value", "hr", 16, ["event_type"]))


_LG = _EV + ", lg AS (SELECT * FROM (SELECT event_type, vb AS t, lag(vb) OVER w AS t0, lag(hb) OVER w AS s0 FROM bi WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE t0 IS NOT NULL)"


@query(rounded_sql(_LG + f", a AS {_H.format(t='lg', c='t, t0')}, b AS {_H.format(t='lg', c='t0, s0')}, c AS {_H.format(t='lg', c='t0')}, d AS {_H.format(t='lg', c='t, t0, s0')}, ct AS (SELECT event_type, count(*) AS n FROM lg GROUP BY 1)",
    "event_type; n; ~greatest(0, a.h + b.h - c.h - d.h) AS transfer_entropy", "FROM ct JOIN a USING (event_type) JOIN b USING (event_type) JOIN c USING (event_type) JOIN d USING (event_type)"))
def transfer_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.transfer_entropy(_events(spark, folder), "hr", "value", ["ts", "event_id"], 16, ["event_type"]))


@query(rounded_sql("d AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events WHERE isfinite(value))", "event_type; ~sqrt(coalesce(var_samp(d), 0)) AS roughness", "FROM d GROUP BY event_type"))
def roughness(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.roughness(_events(spark, folder), "value", ["ts", "event_id"], ["event_type"]))


_HASH = "(('0x' || substr(md5({0}), 1, 8))::BIGINT)"
_BT = _OBS + f""", cl AS (SELECT intervention, p AS x, row_number() OVER (PARTITION BY intervention ORDER BY obs_no) - 1 AS i FROM ob WHERE isfinite(p)), nn AS (SELECT intervention, count(*) AS n FROM cl GROUP BY 1),
dw AS (SELECT intervention, rep, {_HASH.format("'11:' || rep || ':' || i")} % n AS i FROM cl JOIN nn USING (intervention) CROSS JOIN range(20) t(rep)),
bm AS (SELECT intervention, rep, avg(x) AS mean FROM dw JOIN cl USING (intervention, i) GROUP BY 1, 2)"""


@query(rounded_sql(_BT, "intervention; ~avg(mean) AS mean; ~stddev_samp(mean) AS standard_error; ~quantile_cont(mean, 0.025) AS low; ~quantile_cont(mean, 0.975) AS high", "FROM bm GROUP BY intervention"))
def bootstrap_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.bootstrap_interval(S.bootstrap_means(observations(spark, folder), "p", "obs_no", 20, ["intervention"]), ["intervention"]))


@query(rounded_sql(_OBS + f""", cl AS (SELECT p AS x, viable AS g, obs_no AS k FROM ob WHERE isfinite(p) AND viable IS NOT NULL), se AS (SELECT avg(x) FILTER (WHERE g) - avg(x) FILTER (WHERE NOT g) AS o, sum(g::INT) AS m FROM cl),
rp AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY {_HASH.format("'13:' || rep || ':' || k")}, k) AS pl FROM cl CROSS JOIN range(20) t(rep)),
nu AS (SELECT rep, o, avg(x) FILTER (WHERE pl <= m) - avg(x) FILTER (WHERE pl > m) AS d FROM rp CROSS JOIN se GROUP BY rep, o)""", "~o AS observed; ~(sum((abs(d) >= abs(o) - 1e-12)::INT) + 1) / (count(*) + 1.0) AS p_value; ~avg(d) AS null_mean", "FROM nu GROUP BY o"))  # fmt: skip
def permutation_test(spark: SparkSession, folder: str) -> DataFrame:
    """Target probability of viable against other cells."""
    return rounded(S.permutation_test(observations(spark, folder), "p", "viable", "obs_no", 20))


_DE = _OBS + """, mn AS (SELECT intervention, donor, avg(p) AS m FROM ob WHERE donor IS NOT NULL AND intervention IS NOT NULL AND isfinite(p) GROUP BY 1, 2),
df AS (SELECT a.intervention, a.donor, a.m - b.m AS d FROM mn a JOIN mn b ON a.donor = b.donor AND b.intervention = 'vehicle' WHERE a.intervention <> 'vehicle'),
ef AS (SELECT intervention, count(*) AS donors, avg(d) AS effect, coalesce(stddev_samp(d), 0) AS sd, avg((d > 0)::INT) AS positive FROM df GROUP BY 1)"""


@query(rounded_sql(_DE + f", sg AS (SELECT intervention, rep, avg(CASE WHEN {_HASH.format(repr('17:') + ' || rep || ' + repr(':') + ' || donor')} / 4294967296.0 < 0.5 THEN -d ELSE d END) AS x FROM df CROSS JOIN range(20) t(rep) GROUP BY 1, 2)",
    "intervention; ~effect AS observed; donors AS n; ~(sum((abs(x) >= abs(effect) - 1e-12)::INT) + 1) / (count(*) + 1.0) AS p_value", "FROM sg JOIN ef USING (intervention) GROUP BY intervention, effect, donors"))
def sign_flip_test(spark: SparkSession, folder: str) -> DataFrame:
    """Donor-paired differences against random signs."""
    means = observations(spark, folder).where(F.col("donor").isNotNull() & finite("p")).groupBy("intervention", "donor").agg(F.avg("p").alias("m"))
    base = means.where("intervention = 'vehicle'").select("donor", F.col("m").alias("c"))
    diff = means.where("intervention <> 'vehicle'").join(base, "donor").withColumn("d", F.col("m") - F.col("c"))
    return rounded(S.sign_flip_test(diff, "d", "donor", 20, ["intervention"]))


@query(rounded_sql(_DE, "intervention; donors; ~effect AS effect; ~sd AS sd; ~positive AS positive", "FROM ef"))
def donor_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Donor-paired effects of interventions against the vehicle over all timepoints; ``study_effects`` judges them at the endpoint."""
    return rounded(D.donor_effects(observations(spark, folder), "intervention", "donor", "p", "vehicle"))


_ARM = _OBS + """, tw AS (SELECT donor, avg(p) FILTER (WHERE intervention = 'program_A') AS treated, avg(p) FILTER (WHERE intervention = 'control') AS control, count(*) FILTER (WHERE intervention = 'program_A') AS a, count(*) FILTER (WHERE intervention = 'control') AS b
 FROM tr WHERE donor IS NOT NULL AND isfinite(p) AND intervention IN ('program_A', 'control') GROUP BY 1)"""


@query(rounded_sql(_ARM, "donor; ~treated AS treated; ~control AS control; ~treated - control AS effect; least(a, b) < 1 AS blocked", "FROM tw"))
def trial_donor_effects(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.trial_effects(trials(spark, folder), "intervention", "donor", "p", "program_A", "control"))


@query("""WITH a AS (SELECT DISTINCT upper(trim(cell_id)) AS k FROM study_cells WHERE cell_id IS NOT NULL), b AS (SELECT DISTINCT upper(trim(cell_id)) AS k FROM cells WHERE cell_id IS NOT NULL)
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")
def id_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Cell ids of the study against the cells."""
    k = lambda n: table(spark, folder, n).select(F.upper(F.trim("cell_id")).alias("k"))
    return D.reconcile(k("study_cells"), k("cells"), "k")


@query(rounded_sql(_OBS + ", ff AS (SELECT lineage_id, fate, count(*) AS n FROM ob WHERE lineage_id IS NOT NULL AND fate IS NOT NULL GROUP BY 1, 2)", "lineage_id; fate; n; ~n / sum(n) OVER (PARTITION BY lineage_id) AS share", "FROM ff"))
def lineage_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies of fates per lineage."""
    return rounded(D.fate_shares(observations(spark, folder), "lineage_id", "fate"))


_FS = _OBS + """, pa AS (SELECT orthogonal_fate AS fate, count(*) * 1.0 / sum(count(*)) OVER () AS s FROM tr WHERE orthogonal_fate IS NOT NULL GROUP BY 1), pb AS (SELECT fate, count(*) * 1.0 / sum(count(*)) OVER () AS s FROM ob WHERE fate IS NOT NULL GROUP BY 1)"""


@query(rounded_sql(_FS, "fate; ~coalesce(pa.s, 0) AS predicted; ~coalesce(pb.s, 0) AS observed; ~abs(coalesce(pa.s, 0) - coalesce(pb.s, 0)) AS gap", "FROM pa FULL JOIN pb USING (fate)"))
def fate_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of fates in the trial against the study."""
    one = lambda df, c: D.fate_shares(df.withColumn("all", F.lit(1)), "all", c).select(F.col(c).alias("fate"), "share")
    return rounded(D.fate_calibration(one(trials(spark, folder), "orthogonal_fate"), one(observations(spark, folder), "fate"), "fate", "share"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(cell_id, ''), coalesce(donor_id, ''), coalesce(intervention, ''), coalesce(lineage_id, '') ORDER BY trial_no) AS n FROM trial_observations) SELECT count(*) AS kept, min(trial_no) AS first_no, max(trial_no) AS last_no FROM d WHERE n = 1""")
def replication_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Trial rows with new content, by fingerprint."""
    kept = D.keep_first(table(spark, folder, "trial_observations"), ["cell_id", "donor_id", "intervention", "lineage_id"], "trial_no")
    return kept.agg(F.count("*").alias("kept"), F.min("trial_no").alias("first_no"), F.max("trial_no").alias("last_no"))


_TP = _RK + """, pr AS (SELECT count(*) AS m, corr(rp, rd) AS r FROM r GROUP BY intervention HAVING count(*) > 3), zz AS (SELECT m, r, atanh(least(greatest(r, -0.999999), 0.999999)) AS z, m - 3.0 AS w FROM pr WHERE isfinite(r)),
tt AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * z) AS swz, sum(w * z * z) AS swzz, avg(r) AS equal_mean, sum(r * m) / sum(m) AS cell_mean, avg((r > 0)::INT) AS pos FROM zz),
qq AS (SELECT *, greatest(0, swzz - swz * swz / sw) AS q, sw - sw2 / sw AS c FROM tt)"""


@query(rounded_sql(_TP, "k; ~equal_mean AS equal_mean; ~cell_mean AS cell_mean; ~tanh(swz / sw) AS pooled; ~q AS q; ~CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2; ~CASE WHEN c > 0 THEN greatest(0, (q - (k - 1)) / c) ELSE 0 END AS tau2; ~greatest(pos, 1 - pos) AS sign_consistency", "FROM qq"))
def transportability(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations of the interventions pooled, with heterogeneity."""
    return rounded(D.transportability(S.spearman(observations(spark, folder), "p", "dose", ["intervention"])))


@query(_OBS.join(["WITH ", f""", dd AS (SELECT DISTINCT donor FROM ob WHERE donor IS NOT NULL) SELECT donor, row_number() OVER (ORDER BY {_HASH.format("'3:' || donor")} / 4294967296.0, donor) <= ceil(0.25 * count(*) OVER ()) AS held_out FROM dd"""]))
def holdout_donors(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the donors held out by hash."""
    return D.holdout_donors(observations(spark, folder), "donor")


_LI = "wk AS (SELECT l_returnflag AS protocol, l_linestatus AS direction, (l_discount - l_tax) * l_quantity AS work FROM lineitem)"


def _works(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("protocol"), F.col("l_linestatus").alias("direction"), ((F.col("l_discount") - F.col("l_tax")) * F.col("l_quantity")).alias("work"))


@query(rounded_sql(_LI + """, mx AS (SELECT protocol, direction, max(-work) AS m FROM wk GROUP BY 1, 2), sd AS (SELECT protocol, direction, m, -(m + ln(avg(exp(-work - m)))) AS f, count(*) AS n, avg(work) AS w FROM wk JOIN mx USING (protocol, direction) GROUP BY 1, 2, 3),
wd AS (SELECT protocol, max(n) FILTER (WHERE direction = 'F') AS n_forward, max(n) FILTER (WHERE direction <> 'F') AS n_reverse, max(f) FILTER (WHERE direction = 'F') AS forward, -max(f) FILTER (WHERE direction <> 'F') AS reverse, max(w) FILTER (WHERE direction = 'F') AS w FROM sd GROUP BY 1)""",
    "protocol; n_forward; n_reverse; ~forward AS forward; ~reverse AS reverse; ~abs(forward - reverse) AS gap; ~w - forward AS dissipation", "FROM wd"))
def path_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Free energies of forward and reverse works per protocol."""
    return rounded(D.path_ensemble(_works(spark, folder), ["protocol"], "direction", "F"))


_HG = _LI + ", ed AS (SELECT protocol, min(work) AS lo, (max(work) - min(work)) / 24 AS w FROM wk GROUP BY 1)"


@query(rounded_sql(_HG, "protocol; (CASE WHEN w > 0 THEN least(23, floor((work - lo) / w)) ELSE 0 END)::INT AS bin; count(*) AS n", "FROM wk JOIN ed USING (protocol) GROUP BY ALL"))
def crooks_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Work histogram of each protocol."""
    return D.work_histogram(_works(spark, folder), ["protocol"])


@query(rounded_sql(_LI + """, sx AS (SELECT protocol, direction = 'F' AS fwd, CASE WHEN direction = 'F' THEN work ELSE -work END AS x FROM wk), eg AS (SELECT protocol, min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM sx GROUP BY 1),
cb AS (SELECT protocol, least(19, floor((x - lo) / w)) AS b, sum(fwd::INT) AS f, sum((NOT fwd)::INT) AS r FROM sx JOIN eg USING (protocol) GROUP BY 1, 2),
gb AS (SELECT e.protocol, g AS b, lo + (g + 0.5) * w AS mid, ln((coalesce(f, 0) + 0.5) / (coalesce(r, 0) + 0.5)) AS y FROM eg e CROSS JOIN range(20) t(g) LEFT JOIN cb ON cb.protocol = e.protocol AND cb.b = g),
sp AS (SELECT *, lead(y) OVER (PARTITION BY protocol ORDER BY b) AS y1, lead(mid) OVER (PARTITION BY protocol ORDER BY b) AS mid1 FROM gb)""",
    "protocol; ~min_by(mid - y * (mid1 - mid) / (y1 - y), b) AS crossing", "FROM sp WHERE y * y1 <= 0 AND y <> y1 GROUP BY protocol"))
def crooks_crossing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.crooks_crossing(_works(spark, folder), ["protocol"], "direction", "F"))


@query("WITH " + _LI + """ SELECT protocol, sum(isfinite(work)::INT)::BIGINT AS "finite", count(*) AS n, count(DISTINCT direction) AS directions,
CASE WHEN count(DISTINCT direction) < 2 THEN 'no_reverse' ELSE '' END AS issues, count(DISTINCT direction) >= 2 AS ready FROM wk GROUP BY protocol""")
def protocol_check(spark: SparkSession, folder: str) -> DataFrame:
    return D.protocol_check(_works(spark, folder), ["protocol"], "direction")


@query("WITH " + _DE + """ SELECT intervention, concat_ws('|', CASE WHEN abs(effect) < 0.1 THEN 'effect_too_small' END, CASE WHEN donors < 10 THEN 'few_donors' END, CASE WHEN sd > 0.2 THEN 'noisy' END) AS blockers,
CASE WHEN abs(effect) < 0.1 OR donors < 10 OR sd > 0.2 THEN 'blocked' ELSE 'pass' END AS decision FROM ef""")
def decision_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence gate over donor effects."""
    e = D.donor_effects(observations(spark, folder), "intervention", "donor", "p", "vehicle")
    return D.gate(e, "intervention", {"effect_too_small": "abs(effect) < 0.1", "few_donors": "donors < 10", "noisy": "sd > 0.2"})


@query(rounded_sql(_OBS + ", bp AS (SELECT intervention, 1.0 + sum(viable::INT) AS a, 1.0 + count(*) - sum(viable::INT) AS b, count(DISTINCT donor) AS donors FROM ob WHERE viable IS NOT NULL AND intervention IS NOT NULL GROUP BY 1)",
    "intervention; ~a AS alpha; ~b AS beta; ~a / (a + b) AS mean; ~sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd; donors; donors >= 2 AS replicated", "FROM bp"))
def closed_loop_posterior(spark: SparkSession, folder: str) -> DataFrame:
    """Beta posterior of viability per intervention."""
    return rounded(D.posterior(observations(spark, folder), "intervention", "viable", "donor"))


# ------------------------------------------------------------------ streams

@query(rounded_sql("pl AS (SELECT event_type AS source, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 64 AS win FROM events)",
    'source; win AS "window"; count(*) AS n; ~avg(value) AS mean; ~median(value) AS p50; ~quantile_cont(value, 0.95) AS p95; count(*) = 64 AS complete', "FROM pl GROUP BY source, win", 10))
def count_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of 64 values per event type, with the tail."""
    e = table(spark, folder, "events").withColumnRenamed("event_type", "source")
    return rounded(W.count_windows(e, "source", "value", ["ts", "event_id"], 64), 10)


@query(rounded_sql("", "event_type; count(*) AS n; ~avg(value) AS mean; ~coalesce(var_samp(value), 0) AS variance; ~min(value) AS low; ~max(value) AS high", "FROM events WHERE isfinite(value) GROUP BY event_type").replace("WITH  ", ""))
def running_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(W.running_moments(table(spark, folder, "events"), ["event_type"], "value"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily event-time windows."""
    return rounded(W.event_windows(table(spark, folder, "events"), "ts", ["event_type"], "value", "1 day"), 4)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 hour AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return W.sessions(table(spark, folder, "events"), "ts", ["user_id"], "6 hours")


# ------------------------------------------------------------------ transport and names


def _coupled(spark: SparkSession, folder: str, draws: int = 0) -> DataFrame:
    """Transport between the cells of every two successive labels, over all coordinates."""
    return O.snapshot_transport(points(spark, folder).withColumn("mass", F.lit(1.0)), "label", XS, draws=draws)


@query()
def sinkhorn_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Cost, entropy and greatest marginal error of the plan between every two successive labels."""
    by = _coupled(spark, folder).groupBy("source", "target")
    return rounded(by.agg(F.count("*").alias("cells"), F.sum("cost").alias("cost"), F.sum("entropy").alias("entropy"), F.sum("mass").alias("mass"), (F.max("violation") <= 1e-6).alias("converged")))


@query()
def barycentric_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Velocity that the plan implies for every source cell."""
    mapped = _coupled(spark, folder).withColumnRenamed("idx", "i").select("i", *[f"t_{x}" for x in XS])
    return rounded(O.implied_velocity(mapped, points(spark, folder).withColumnRenamed("idx", "i"), XS, 1.0), 4)


@query()
def displacement_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """Positions half way along pairs drawn from the plans."""
    return rounded(_coupled(spark, folder, 200), 4)


@query("""WITH s AS (SELECT p_brand AS program, string_split(replace(p_name, ' ', '|'), '|') AS parts FROM part), u AS (SELECT program, unnest(parts) AS g, generate_subscripts(parts, 1) - 1 AS position FROM s),
c AS (SELECT program, position, regexp_replace(replace(replace(upper(trim(g)), '-', ''), '_', ''), '^MT(.)', '\\1') AS gene FROM u) SELECT program, gene, min(position)::INT AS position FROM c WHERE gene <> '' GROUP BY program, gene""")
def marker_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Words of part names as marker aliases of their brand."""
    parts = table(spark, folder, "part").select("p_brand", F.translate("p_name", " ", "|").alias("names"))
    return alias_table(parts, "p_brand", "names").withColumnRenamed("p_brand", "program")
