"""Queries of donor-paired studies, trials, replication and transport of a predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.operators import experiments as X
from fellscape.plans.base import rounded, rounded_sql
from fellscape.plans.studies import _HASH, _number
from fellscape.session import table

QUERIES: dict = {}
ORACLE: dict = {}
CONTROL, TARGET, ROUNDS = "vehicle", "erythroid", 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _study(spark: SparkSession, folder: str) -> DataFrame:
    """Study cells, each delivered row once."""
    s = table(spark, folder, "study_cells").select("obs_no", "cell_id", _number("donor").alias("donor"), "replicate", "intervention", "fate", F.col("target_probability").alias("p"), F.coalesce("viable", F.lit(False)).alias("viable"), "lineage_id", "timepoint", "batch", "orthogonal_fate")
    y = F.when(F.col("fate").isNotNull(), (F.col("fate") == TARGET).cast("double"))
    return s.distinct().withColumn("y", y)


def _trial(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "trial_observations")
    return t.select("trial_no", "cell_id", _number("donor_id").alias("donor"), "intervention", F.col("fate_probability").alias("p"), "viability", "lineage_id", "barcode_id", "orthogonal_fate").distinct()


_ST = f"""sd AS (SELECT DISTINCT obs_no, cell_id, regexp_replace(coalesce(donor, ''), '[^0-9]', '', 'g') AS dn, replicate, intervention, fate, target_probability AS p, coalesce(viable, false) AS viable, lineage_id, timepoint, batch, orthogonal_fate FROM study_cells),
st AS (SELECT *, CASE WHEN dn = '' THEN NULL ELSE dn::BIGINT END AS donor, CASE WHEN fate IS NOT NULL THEN (fate = '{TARGET}')::INT::DOUBLE END AS y FROM sd)"""
_ERR = _ST + """, er AS (SELECT unnest(list_filter([CASE WHEN donor IS NULL THEN 'missing_donor' END, CASE WHEN coalesce(trim(intervention), '') = '' THEN 'missing_intervention' END, CASE WHEN coalesce(trim(replicate), '') = '' THEN 'missing_replicate' END,
  CASE WHEN timepoint = 'endpoint' AND coalesce(trim(lineage_id), '') = '' THEN 'missing_lineage' END, CASE WHEN timepoint = 'endpoint' AND viable AND fate IS NULL AND p IS NULL THEN 'missing_outcome' END], lambda x: x IS NOT NULL)) AS code FROM st
 UNION ALL SELECT 'duplicate_cell_ids' FROM (SELECT cell_id FROM st WHERE cell_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)), ec AS (SELECT code, count(*) AS n FROM er GROUP BY 1)"""
_GR = f""", gr AS (SELECT intervention, donor, count(*) AS cells, count(*) FILTER (WHERE viable) AS viable_cells, avg(coalesce(p, (fate = '{TARGET}')::INT::DOUBLE)) FILTER (WHERE viable) AS target_fraction, count(*) FILTER (WHERE viable) / count(*) AS viability_fraction,
  count(DISTINCT CASE WHEN viable THEN lineage_id END) AS lineages, avg((fate = orthogonal_fate)::INT) FILTER (WHERE viable AND fate IS NOT NULL AND orthogonal_fate IS NOT NULL) AS orthogonal_agreement
 FROM st WHERE timepoint = 'endpoint' AND donor IS NOT NULL AND intervention IS NOT NULL GROUP BY 1, 2)"""


@query(rounded_sql(_ST, "obs_no; intervention; ~coalesce(p, y) AS outcome", "FROM st WHERE timepoint = 'endpoint' AND viable"))
def viable_endpoint_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Viable cells of the endpoint with their outcome."""
    cells = X.endpoint_cells(_study(spark, folder), viable_only=True)
    return rounded(cells.select("obs_no", "intervention", X.measured(TARGET).alias("outcome")))


@query("WITH " + _ERR + " SELECT code, n FROM ec")
def study_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Schema errors of the study by code."""
    return X.study_errors(_study(spark, folder))


@query(rounded_sql(_ST + _GR, "intervention; donor; cells; viable_cells; ~target_fraction AS target_fraction; ~viability_fraction AS viability_fraction; lineages; ~orthogonal_agreement AS orthogonal_agreement", "FROM gr"))
def study_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Donor groups of every intervention at the endpoint."""
    return rounded(X.study_groups(_study(spark, folder), TARGET))


def _effects(groups: DataFrame) -> DataFrame:
    return X.study_effects(groups, CONTROL, ROUNDS)


_EF = f""", pr AS (SELECT a.intervention, a.donor, a.target_fraction - b.target_fraction AS d, a.viability_fraction - b.viability_fraction AS dv, least(a.cells, b.cells) < 10 AS few
  FROM gr a JOIN gr b ON a.donor = b.donor AND b.intervention = '{CONTROL}' WHERE a.intervention <> '{CONTROL}' AND a.target_fraction - b.target_fraction IS NOT NULL),
pn AS (SELECT *, row_number() OVER (PARTITION BY intervention ORDER BY donor) - 1 AS i, count(*) OVER (PARTITION BY intervention) AS n FROM pr),
dw AS (SELECT intervention, rep, {_HASH.format("'17:' || rep || ':' || i")} % n AS i FROM pn CROSS JOIN range({ROUNDS}) t(rep)),
bm AS (SELECT intervention, rep, avg(d) AS m FROM dw JOIN pn USING (intervention, i) GROUP BY 1, 2),
bi AS (SELECT intervention, list_sort(list(m))[1 + {int(0.025 * ROUNDS)}] AS low, list_sort(list(m))[1 + {int(0.975 * ROUNDS)}] AS high FROM bm GROUP BY 1),
pe AS (SELECT intervention, count(*) AS donors, avg(d) AS effect, avg(dv) AS viability_effect, min(d) > 0 AS consistent, bool_or(few) AS few FROM pr GROUP BY 1),
sg AS (SELECT intervention, rep, avg(CASE WHEN {_HASH.format("'117:' || rep || ':' || donor")} / 4294967296.0 < 0.5 THEN -d ELSE d END) AS x FROM pr CROSS JOIN range({ROUNDS}) t(rep) GROUP BY 1, 2),
pv AS (SELECT intervention, (sum((abs(x) >= abs(effect) - 1e-12)::INT) + 1) / (count(*) + 1.0) AS p_value FROM sg JOIN pe USING (intervention) GROUP BY 1),
ar AS (SELECT DISTINCT intervention FROM gr WHERE intervention <> '{CONTROL}'),
ef AS (SELECT intervention, coalesce(donors, 0) AS donors, effect, low, high, CASE WHEN coalesce(donors, 0) < 2 THEN 1.0 ELSE p_value END AS p_value, viability_effect, consistent, few FROM ar LEFT JOIN pe USING (intervention) LEFT JOIN bi USING (intervention) LEFT JOIN pv USING (intervention)),
es AS (SELECT *, CASE WHEN donors = 0 THEN 'not_comparable' WHEN few THEN 'inconclusive_underpowered_groups' WHEN donors < 3 THEN 'inconclusive_insufficient_replication'
  WHEN effect >= 0.1 AND low > 0 AND consistent AND viability_effect >= -0.1 AND (p_value <= 0.05 OR donors < 4) THEN 'experimentally_supported_candidate' ELSE 'inconclusive_or_falsified' END AS status,
  concat_ws('|', CASE WHEN donors < 3 THEN 'insufficient_independent_donors' END, CASE WHEN viability_effect < -0.1 THEN 'viability_loss_exceeds_threshold' END, CASE WHEN few THEN 'minimum_cells_per_group_not_met' END) AS warnings FROM ef)"""


@query(rounded_sql(_ST + _GR + _EF, "intervention; donors; ~effect AS effect; ~low AS low; ~high AS high; ~p_value AS p_value; ~viability_effect AS viability_effect; consistent; status; warnings", "FROM es"))
def study_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Donor-paired effect of every intervention at the endpoint, with interval, p and status."""
    return rounded(_effects(X.study_groups(_study(spark, folder), TARGET)))


@query("WITH " + _ERR + _GR + _EF + f""", bl AS (SELECT list_sort(list(code)) AS codes FROM ec), bs AS (SELECT list_concat(coalesce(codes, []), CASE WHEN EXISTS (SELECT 1 FROM gr WHERE intervention = '{CONTROL}') THEN [] ELSE ['missing_control_intervention'] END) AS b FROM bl),
tt AS (SELECT count(*) AS interventions, count(*) FILTER (WHERE status = 'experimentally_supported_candidate') AS supported FROM es)
SELECT CASE WHEN len(b) > 0 THEN 'invalid_study_schema' WHEN supported > 0 THEN 'experimentally_supported_candidate' WHEN interventions > 0 THEN 'inconclusive_or_falsified' ELSE 'no_treatment_comparisons' END AS status, interventions, supported, array_to_string(b, '|') AS blockers FROM bs CROSS JOIN tt""")
def study_report(spark: SparkSession, folder: str) -> DataFrame:
    """Status of the whole study and what blocks it."""
    cells = _study(spark, folder)
    groups = X.study_groups(cells, TARGET)
    return X.study_report(X.study_errors(cells), _effects(groups), groups, CONTROL)


_TR = """td AS (SELECT DISTINCT trial_no, cell_id, regexp_replace(coalesce(donor_id, ''), '[^0-9]', '', 'g') AS dn, intervention, fate_probability AS p, viability, lineage_id, barcode_id, orthogonal_fate FROM trial_observations),
tr AS (SELECT *, CASE WHEN dn = '' THEN NULL ELSE dn::BIGINT END AS donor FROM td), va AS (SELECT * FROM tr WHERE donor IS NOT NULL AND intervention IS NOT NULL AND isfinite(p) AND isfinite(viability)),
tg AS (SELECT donor, count(*) FILTER (WHERE intervention = 'control') AS control_cells, count(*) FILTER (WHERE intervention = 'program_A') AS treatment_cells, avg(p) FILTER (WHERE intervention = 'control') AS control_mean, avg(p) FILTER (WHERE intervention = 'program_A') AS treatment_mean,
  avg((lineage_id IS NOT NULL OR barcode_id IS NOT NULL)::INT) AS marked_fraction, avg((orthogonal_fate IS NOT NULL)::INT) AS orthogonal_fraction, avg(viability) FILTER (WHERE intervention = 'control') AS control_viability, avg(viability) FILTER (WHERE intervention = 'program_A') AS treatment_viability
 FROM va WHERE viability >= 0.7 AND intervention IN ('control', 'program_A') GROUP BY 1), gg AS (SELECT *, treatment_mean - control_mean AS effect FROM tg WHERE least(control_cells, treatment_cells) >= 2)"""


def _trial_groups(spark: SparkSession, folder: str) -> DataFrame:
    return X.trial_groups(_trial(spark, folder), "program_A", "control", 2)


@query(rounded_sql(_TR, "donor; control_cells; treatment_cells; ~control_mean AS control_mean; ~treatment_mean AS treatment_mean; ~effect AS effect; ~marked_fraction AS marked_fraction; ~orthogonal_fraction AS orthogonal_fraction; ~control_viability AS control_viability; ~treatment_viability AS treatment_viability", "FROM gg"))
def trial_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Donors with at least two viable cells in both arms."""
    return rounded(_trial_groups(spark, folder))


_TB = f""", tn AS (SELECT effect, row_number() OVER (ORDER BY donor) - 1 AS i, count(*) OVER () AS n FROM gg), tw AS (SELECT rep, {_HASH.format("'41:' || rep || ':' || i")} % n AS i FROM tn CROSS JOIN range({ROUNDS}) t(rep)), tm AS (SELECT rep, avg(effect) AS m FROM tw JOIN tn USING (i) GROUP BY 1),
ti AS (SELECT list_sort(list(m))[1 + {int(0.025 * (ROUNDS - 1))}] AS low, list_sort(list(m))[1 + {int(0.975 * (ROUNDS - 1))}] AS high FROM tm),
ts AS (SELECT count(*) AS valid, count(DISTINCT donor) AS donors, count(*) FILTER (WHERE intervention = 'program_A') AS t, count(*) FILTER (WHERE intervention = 'control') AS c FROM va), tx AS (SELECT count(*) AS n_rows FROM tr),
ta AS (SELECT count(*) AS paired_donors, avg(effect) AS effect, avg(control_viability) AS control_viability, avg(treatment_viability) AS treatment_viability, min(marked_fraction) AS m, min(orthogonal_fraction) AS o FROM gg),
tc AS (SELECT *, concat_ws('|', CASE WHEN donors < 3 THEN 'too_few_donors' END, CASE WHEN t = 0 OR c = 0 THEN 'missing_arm' END, CASE WHEN paired_donors = 0 THEN 'no_donor_with_both_arms' END, CASE WHEN m < 1 THEN 'incomplete_lineage_or_barcode' END, CASE WHEN o < 1 THEN 'incomplete_orthogonal_fate' END) AS blockers
 FROM ta CROSS JOIN ti CROSS JOIN ts CROSS JOIN tx)"""


@query(rounded_sql(_TR + _TB, "paired_donors; ~effect AS effect; ~low AS low; ~high AS high; ~control_viability AS control_viability; ~treatment_viability AS treatment_viability; n_rows - valid AS excluded; blockers; CASE WHEN blockers = '' THEN 'measured_intervention_result_ready_for_replication' ELSE 'blocked_pending_measured_experiment' END AS status", "FROM tc"))
def trial_report(spark: SparkSession, folder: str) -> DataFrame:
    """Mean donor effect of the trial with its gates."""
    return rounded(X.trial_report(_trial(spark, folder), _trial_groups(spark, folder), "program_A", "control", True, ROUNDS))


_RANKED = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_RS = _ST + f""", el AS (SELECT * FROM st WHERE batch IS NOT NULL AND viable AND isfinite(p) AND y IS NOT NULL), rk AS (SELECT batch, donor, lineage_id, {_RANKED.format('batch', 'p')} AS a, {_RANKED.format('batch', 'y')} AS b FROM el),
re AS (SELECT batch, count(*) AS eligible_cells, count(DISTINCT donor) AS donors, count(DISTINCT lineage_id) AS clones, CASE WHEN count(*) < 2 OR var_pop(a) = 0 OR var_pop(b) = 0 THEN 0 ELSE corr(a, b) END AS rho FROM rk GROUP BY 1),
rs AS (SELECT batch, coalesce(eligible_cells, 0) AS eligible_cells, coalesce(donors, 0) AS donors, coalesce(clones, 0) AS clones, coalesce(rho, 0) AS spearman FROM (SELECT DISTINCT batch FROM st WHERE batch IS NOT NULL) LEFT JOIN re USING (batch))"""


def _replicated(spark: SparkSession, folder: str) -> DataFrame:
    return X.replication_studies(_study(spark, folder).where("batch is not null"), "batch")


@query(rounded_sql(_RS, "batch; eligible_cells; donors; clones; ~spearman AS spearman", "FROM rs"))
def replication_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of prediction and fate in every batch, a batch being a study."""
    return rounded(_replicated(spark, folder))


@query(rounded_sql(_RS + f""", ok AS (SELECT *, row_number() OVER (ORDER BY batch) - 1 AS i, count(*) OVER () AS n FROM rs WHERE eligible_cells >= 8), rw AS (SELECT rep, {_HASH.format("'991:' || rep || ':' || i")} % n AS i FROM ok CROSS JOIN range({ROUNDS}) t(rep)), rm AS (SELECT rep, avg(spearman) AS m FROM rw JOIN ok USING (i) GROUP BY 1),
ri AS (SELECT list_sort(list(m))[1 + {int(0.025 * (ROUNDS - 1))}] AS low, list_sort(list(m))[1 + {int(0.975 * (ROUNDS - 1))}] AS high FROM rm), ra AS (SELECT count(*) AS eligible, avg(spearman) AS effect, var_samp(spearman) AS variance, min(donors) AS least FROM ok), rn AS (SELECT count(*) AS studies FROM rs),
rb AS (SELECT *, concat_ws('|', CASE WHEN eligible < 2 THEN 'too_few_studies' END, CASE WHEN least < 2 THEN 'single_donor_study' END) AS blockers FROM ra CROSS JOIN ri CROSS JOIN rn)""",
    "studies; eligible; ~effect AS effect; ~low AS low; ~high AS high; ~variance AS variance; blockers; CASE WHEN blockers = '' THEN 'replicated_predictive_result' ELSE 'independent_replication_not_established' END AS status", "FROM rb"))
def replication_report(spark: SparkSession, folder: str) -> DataFrame:
    """Replication of the correlation over batches."""
    return rounded(X.replication_report(_replicated(spark, folder), "batch", ROUNDS))


_TS = _ST + f""", cl AS (SELECT intervention, obs_no, p, y, row_number() OVER (PARTITION BY intervention ORDER BY obs_no) - 1 AS i, count(*) OVER (PARTITION BY intervention) AS n FROM st WHERE intervention IS NOT NULL AND isfinite(p) AND y IS NOT NULL),
cr AS (SELECT *, {_RANKED.format('intervention', 'p')} AS a, {_RANKED.format('intervention', 'y')} AS b, row_number() OVER (PARTITION BY intervention ORDER BY p DESC, obs_no) AS rp, row_number() OVER (PARTITION BY intervention ORDER BY y DESC, obs_no) AS ry, ceil(0.1 * n) AS k FROM cl),
cm AS (SELECT intervention, count(*) AS n, CASE WHEN count(*) < 2 OR var_pop(a) = 0 OR var_pop(b) = 0 THEN 0 ELSE corr(a, b) END AS spearman, CASE WHEN stddev_pop(p) * stddev_pop(y) > 0 THEN covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)) ELSE 0 END AS pearson, sum((rp <= k AND ry <= k)::INT) / max(k) AS recall FROM cr GROUP BY 1),
cd AS (SELECT intervention, rep, {_HASH.format("'23:' || rep || ':' || i")} % n AS i FROM cl CROSS JOIN range(100) t(rep)), cx AS (SELECT intervention, rep, p, y FROM cd JOIN cl USING (intervention, i)),
cy AS (SELECT intervention, rep, {_RANKED.format('intervention, rep', 'p')} AS a, {_RANKED.format('intervention, rep', 'y')} AS b FROM cx), cz AS (SELECT intervention, rep, CASE WHEN var_pop(a) = 0 OR var_pop(b) = 0 THEN 0 ELSE corr(a, b) END AS r FROM cy GROUP BY 1, 2),
cb AS (SELECT intervention, list_sort(list(r))[3] AS low, list_sort(list(r))[98] AS high FROM cz GROUP BY 1)"""


@query(rounded_sql(_TS, "intervention; n; ~spearman AS spearman; ~pearson AS pearson; ~recall AS recall; ~low AS low; ~high AS high", "FROM cm JOIN cb USING (intervention)"))
def transport_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations of prediction and fate by intervention, an intervention being a study."""
    return rounded(X.transport_studies(_study(spark, folder), "intervention", "obs_no"))


@query(rounded_sql(_TS + f""", ng AS (SELECT *, intervention = '{CONTROL}' AS neg, greatest(1, n - 3)::DOUBLE AS w, atanh(least(greatest(spearman, -0.999999), 0.999999)) AS z FROM cm),
nt AS (SELECT count(*) AS studies, sum(n)::BIGINT AS cells, avg(spearman) AS s, avg(pearson) AS p, avg(recall) AS rc, sum(spearman * n) / sum(n) AS cs, sum(pearson * n) / sum(n) AS cp, count(*) FILTER (WHERE n >= 4) AS k, sum(w) FILTER (WHERE n >= 4) AS sw, sum(w * w) FILTER (WHERE n >= 4) AS sw2,
  sum(w * z) FILTER (WHERE n >= 4) AS swz, sum(w * z * z) FILTER (WHERE n >= 4) AS swzz, avg((spearman > 0)::INT) FILTER (WHERE n >= 4) AS sign, min(n) AS least, count(*) FILTER (WHERE neg) AS controls, count(*) FILTER (WHERE neg AND abs(spearman) > 0.2) AS failed FROM ng),
nq AS (SELECT *, CASE WHEN k >= 2 THEN greatest(0, swzz - swz * swz / sw) END AS q FROM nt),
nh AS (SELECT *, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) WHEN k >= 2 THEN 0 END AS i2, CASE WHEN k >= 2 THEN greatest(0, (q - (k - 1)) / greatest(1e-12, sw - sw2 / sw)) END AS tau2 FROM nq),
nb AS (SELECT *, concat_ws('|', CASE WHEN studies < 2 THEN 'insufficient_independent_studies' END, CASE WHEN least < 20 THEN 'study_below_minimum_finite_cells' END, CASE WHEN i2 > 0.75 THEN 'excessive_between_study_heterogeneity' END,
  CASE WHEN k >= 2 AND sign < 0.7 THEN 'inconsistent_effect_direction_across_studies' END, CASE WHEN failed > 0 THEN 'negative_control_signal_detected' END) AS blockers FROM nh)""",
    "studies; cells; ~s AS spearman; ~p AS pearson; ~rc AS recall; ~cs AS cell_spearman; ~cp AS cell_pearson; ~q AS q; ~i2 AS i2; ~tau2 AS tau2; ~sign AS sign; controls; failed; blockers; CASE WHEN blockers = '' THEN 'transportable_predictive_signal_under_audited_benchmark' ELSE 'transportability_not_established' END AS status", "FROM nb"))
def transport_report(spark: SparkSession, folder: str) -> DataFrame:
    """The predictor's transport over interventions, the vehicle as negative control."""
    studies = X.transport_studies(_study(spark, folder), "intervention", "obs_no").withColumn("negative", F.col("intervention") == CONTROL)
    return rounded(X.transport_report(studies, "negative"))
