"""Matched experiments: donor-paired studies, trials, replication and transport of a predictor over studies.

The donor, or the study, is the unit: cells are averaged within it first. Resampling draws by portable
hashes; its rounds are a parameter. Thresholds are parameters with the usual defaults. Null and
non-finite measurements are left out where a docstring does not say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite
from fellscape.operators import stats as S


def endpoint_cells(cells: DataFrame, endpoint: str = "endpoint", viable_only: bool = False) -> DataFrame:
    """Cells of the endpoint's timepoint, and only viable ones if asked (a null is not viable)."""
    kept = cells.where(F.col("timepoint") == endpoint)
    return kept.where("viable") if viable_only else kept


def measured(target: str) -> Column:
    """Outcome of a cell: its target probability, else whether its fate is the target; null without either."""
    return F.coalesce("p", (F.col("fate") == target).cast("double"))


def study_errors(cells: DataFrame, endpoint: str = "endpoint", orthogonal: bool = False, lineage: bool = True) -> DataFrame:
    """(code, n): schema errors of a study; identities of all cells, measurements of the endpoint's.

    ``cells``: cell_id, donor, replicate, intervention, fate, p, viable, lineage_id, timepoint,
    orthogonal_fate. An id of several rows counts once as ``duplicate_cell_ids``; no cells at all give ``empty_study``.
    """
    end, alive = F.col("timepoint") == endpoint, F.col("viable")
    none = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rules = {
        "missing_donor": none("donor"), "missing_intervention": none("intervention"), "missing_replicate": none("replicate"),
        "missing_lineage": end & none("lineage_id") if lineage else F.lit(False), "missing_outcome": end & alive & F.col("fate").isNull() & F.col("p").isNull(),
        "missing_orthogonal_fate": end & alive & none("orthogonal_fate") if orthogonal else F.lit(False),
    }
    codes = cells.select(F.explode(F.array_compact(F.array(*[F.when(cond, code) for code, cond in rules.items()]))).alias("code"))
    twice = cells.where(F.col("cell_id").isNotNull()).groupBy("cell_id").agg(F.count("*").alias("k")).where("k > 1").select(F.lit("duplicate_cell_ids").alias("code"))
    empty = cells.agg(F.count("*").alias("k")).where("k = 0").select(F.lit("empty_study").alias("code"))
    return codes.unionByName(twice).unionByName(empty).groupBy("code").agg(F.count("*").alias("n"))


def study_groups(cells: DataFrame, target: str, endpoint: str = "endpoint") -> DataFrame:
    """(intervention, donor, cells, viable_cells, target_fraction, viability_fraction, lineages, orthogonal_agreement) at the endpoint."""
    alive = F.col("viable")
    both = alive & F.col("fate").isNotNull() & F.col("orthogonal_fate").isNotNull()
    known = endpoint_cells(cells, endpoint).where("intervention is not null and donor is not null")
    return known.groupBy("intervention", "donor").agg(
        F.count("*").alias("cells"), F.count(F.when(alive, 1)).alias("viable_cells"), F.avg(F.when(alive, measured(target))).alias("target_fraction"), (F.count(F.when(alive, 1)) / F.count("*")).alias("viability_fraction"),
        F.count_distinct(F.when(alive, F.col("lineage_id"))).alias("lineages"), F.avg(F.when(both, (F.col("fate") == F.col("orthogonal_fate")).cast("double"))).alias("orthogonal_agreement"),
    )


def interval(means: DataFrame, by: list[str], rounds: int, last: int) -> DataFrame:
    """(by, low, high): 2.5 and 97.5 percent order statistics of replicate means, by position among ``last``."""
    ordered = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("m"))  # a number for each round
    at = lambda q: F.get("m", F.lit(min(rounds - 1, int(q * last))))
    return ordered.select(*by, at(0.025).alias("low"), at(0.975).alias("high"))


def study_effects(groups: DataFrame, control: str, rounds: int = 2000, min_donors: int = 3, min_cells: int = 10, min_effect: float = 0.1, alpha: float = 0.05, max_loss: float = 0.1, seed: int = 17) -> DataFrame:
    """Donor-paired effects of every intervention against the control, with interval, sign-flip p, status and warnings.

    Donors with viable cells in both arms are paired. Interventions that share no donor with the control are ``not_comparable``.
    """
    base = groups.where(F.col("intervention") == control).select("donor", F.col("target_fraction").alias("c"), F.col("viability_fraction").alias("cv"), F.col("cells").alias("cn"))
    arms = groups.where(F.col("intervention") != control)
    pairs = arms.join(base, "donor").select("intervention", "donor", (F.col("target_fraction") - F.col("c")).alias("d"), (F.col("viability_fraction") - F.col("cv")).alias("dv"), (F.least("cells", "cn") < min_cells).alias("few")).where("d is not null")
    by = ["intervention"]
    per = pairs.groupBy(*by).agg(F.count("*").alias("donors"), F.avg("d").alias("effect"), F.avg("dv").alias("viability_effect"), (F.min("d") > 0).alias("consistent"), F.max("few").alias("few"))
    bounds = interval(S.bootstrap_means(pairs, "d", "donor", rounds, by, seed), by, rounds, rounds)
    p = S.sign_flip_test(pairs, "d", "donor", rounds, by, seed + 100).select(*by, "p_value")
    met = arms.select(*by).distinct().join(per, by, "left").join(bounds, by, "left").join(p, by, "left").withColumn("donors", F.coalesce("donors", F.lit(0)))
    lost = F.col("viability_effect") < -max_loss
    strong = (F.col("effect") >= min_effect) & (F.col("low") > 0) & F.col("consistent") & ~lost & ((F.col("p_value") <= alpha) | (F.col("donors") < 4))
    status = F.when(F.col("donors") == 0, "not_comparable").when(F.col("few"), "inconclusive_underpowered_groups").when(F.col("donors") < min_donors, "inconclusive_insufficient_replication").when(strong, "experimentally_supported_candidate").otherwise("inconclusive_or_falsified")
    warnings = F.array_compact(F.array(F.when(F.col("donors") < min_donors, "insufficient_independent_donors"), F.when(lost, "viability_loss_exceeds_threshold"), F.when(F.col("few"), "minimum_cells_per_group_not_met")))
    p_value = F.when(F.col("donors") < 2, 1.0).otherwise(F.col("p_value"))
    return met.select(*by, "donors", "effect", "low", "high", p_value.alias("p_value"), "viability_effect", "consistent", status.alias("status"), F.array_join(warnings, "|").alias("warnings"))


def study_report(errors: DataFrame, effects: DataFrame, groups: DataFrame, control: str) -> DataFrame:
    """One row: status of the study, its blockers and the number of supported interventions."""
    codes = errors.agg(F.sort_array(F.collect_list("code")).alias("codes"))  # a code for each rule
    found = effects.agg(F.count("*").alias("interventions"), F.count(F.when(F.col("status") == "experimentally_supported_candidate", 1)).alias("supported"))
    there = groups.agg(F.count(F.when(F.col("intervention") == control, 1)).alias("controls"))
    met = codes.crossJoin(found).crossJoin(there)  # one row each
    blockers = F.concat("codes", F.when(F.col("controls") == 0, F.array(F.lit("missing_control_intervention"))).otherwise(F.array().cast("array<string>")))
    status = F.when(F.size(blockers) > 0, "invalid_study_schema").when(F.col("supported") > 0, "experimentally_supported_candidate").when(F.col("interventions") > 0, "inconclusive_or_falsified").otherwise("no_treatment_comparisons")
    return met.select(status.alias("status"), "interventions", "supported", F.array_join(blockers, "|").alias("blockers"))


def _valid_trial(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("donor").isNotNull() & F.col("intervention").isNotNull() & finite("p") & finite("viability"))


def trial_groups(obs: DataFrame, treated: str, control: str, min_cells: int = 8, min_viability: float = 0.7) -> DataFrame:
    """Per donor with enough viable cells in both arms: counts, means, effect, marked and orthogonal shares, viabilities."""
    two = _valid_trial(obs).where((F.col("viability") >= min_viability) & F.col("intervention").isin(treated, control))
    side = lambda f, a, c: f(F.when(F.col("intervention") == a, F.col(c)))
    marked = (F.col("lineage_id").isNotNull() | F.col("barcode_id").isNotNull()).cast("double")
    per = two.groupBy("donor").agg(
        side(F.count, control, "p").alias("control_cells"), side(F.count, treated, "p").alias("treatment_cells"), side(F.avg, control, "p").alias("control_mean"), side(F.avg, treated, "p").alias("treatment_mean"),
        F.avg(marked).alias("marked_fraction"), F.avg(F.col("orthogonal_fate").isNotNull().cast("double")).alias("orthogonal_fraction"), side(F.avg, control, "viability").alias("control_viability"), side(F.avg, treated, "viability").alias("treatment_viability"),
    )
    return per.where(F.least("control_cells", "treatment_cells") >= min_cells).withColumn("effect", F.col("treatment_mean") - F.col("control_mean"))


def trial_report(obs: DataFrame, groups: DataFrame, treated: str, control: str, registered: bool, rounds: int = 2000, min_donors: int = 3, seed: int = 41) -> DataFrame:
    """One row: the mean donor effect with its interval, viabilities, excluded rows, blockers and status."""
    valid = _valid_trial(obs)
    rows = obs.agg(F.count("*").alias("rows"))
    seen = valid.agg(F.count("*").alias("valid"), F.count_distinct("donor").alias("donors"), F.count(F.when(F.col("intervention") == treated, 1)).alias("t"), F.count(F.when(F.col("intervention") == control, 1)).alias("c"))
    mean = groups.agg(F.count("*").alias("paired_donors"), F.avg("effect").alias("effect"), F.avg("control_viability").alias("control_viability"), F.avg("treatment_viability").alias("treatment_viability"), F.min("marked_fraction").alias("m"), F.min("orthogonal_fraction").alias("o"))
    draws = S.bootstrap_means(groups.withColumn("_all", F.lit(1)), "effect", "donor", rounds, ["_all"], seed)
    bounds = interval(draws, ["_all"], rounds, rounds - 1).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    met = rows.crossJoin(seen).crossJoin(mean).crossJoin(bounds)  # one row each
    codes = F.array_compact(F.array(
        F.lit(None).cast("string") if registered else F.lit("missing_preregistration"), F.when(F.col("donors") < min_donors, "too_few_donors"), F.when((F.col("t") == 0) | (F.col("c") == 0), "missing_arm"),
        F.when(F.col("paired_donors") == 0, "no_donor_with_both_arms"), F.when(F.col("m") < 1, "incomplete_lineage_or_barcode"), F.when(F.col("o") < 1, "incomplete_orthogonal_fate"),
    ))
    status = F.when(F.size(codes) > 0, "blocked_pending_measured_experiment").otherwise("measured_intervention_result_ready_for_replication")
    return met.select("paired_donors", "effect", "low", "high", "control_viability", "treatment_viability", (F.col("rows") - F.col("valid")).alias("excluded"), F.array_join(codes, "|").alias("blockers"), status.alias("status"))


def distinct_studies(obs: DataFrame, study: str, content: list[str]) -> DataFrame:
    """(study, is_copy): whether a study has the content of one with a smaller name; rows in any order."""
    h = F.xxhash64(*content)
    per = obs.groupBy(study).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    first = per.groupBy("n", "x", "s").agg(F.min(study).alias("_first"))
    return per.join(first, ["n", "x", "s"]).select(study, (F.col(study) != F.col("_first")).alias("is_copy"))


def replication_studies(obs: DataFrame, study: str) -> DataFrame:
    """(study, eligible_cells, donors, clones, spearman) over viable cells with finite prediction p and outcome y; copies of a study left out."""
    own = distinct_studies(obs, study, ["cell_id", "donor", "intervention", "p", "y", "viable"]).where("not is_copy").select(study)
    eligible = obs.join(own, study).where(F.col("viable") & finite("p") & finite("y"))
    per = eligible.groupBy(study).agg(F.count("*").alias("eligible_cells"), F.count_distinct("donor").alias("donors"), F.count_distinct("lineage_id").alias("clones"))
    rho = S.spearman(eligible, "p", "y", [study]).select(study, F.col("rho").alias("spearman"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("eligible_cells", "donors", "clones")]
    return own.join(per, study, "left").join(rho, study, "left").select(study, *zero, F.coalesce("spearman", F.lit(0.0)).alias("spearman"))


def replication_report(studies: DataFrame, study: str, rounds: int = 256, min_cells: int = 8, min_studies: int = 2, seed: int = 991) -> DataFrame:
    """One row: mean correlation over the studies with enough cells, its interval and variance, blockers and status."""
    t = studies.withColumn("ok", F.col("eligible_cells") >= min_cells)
    per = t.agg(F.count("*").alias("studies"), F.count(F.when(F.col("ok"), 1)).alias("eligible"), F.avg(F.when(F.col("ok"), F.col("spearman"))).alias("effect"), F.var_samp(F.when(F.col("ok"), F.col("spearman"))).alias("variance"), F.min(F.when(F.col("ok"), F.col("donors"))).alias("least"))
    draws = S.bootstrap_means(t.where("ok").withColumn("_all", F.lit(1)), "spearman", study, rounds, ["_all"], seed)
    bounds = interval(draws, ["_all"], rounds, rounds - 1).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    codes = F.array_compact(F.array(F.when(F.col("eligible") < min_studies, "too_few_studies"), F.when(F.col("least") < 2, "single_donor_study")))
    met = per.crossJoin(bounds)  # one row each
    status = F.when(F.size(codes) > 0, "independent_replication_not_established").otherwise("replicated_predictive_result")
    return met.select("studies", "eligible", "effect", "low", "high", "variance", F.array_join(codes, "|").alias("blockers"), status.alias("status"))


def transport_studies(obs: DataFrame, study: str, key: str, rounds: int = 100, seed: int = 23) -> DataFrame:
    """(study, n, spearman, pearson, recall, low, high): a fixed predictor p against outcomes y, study by study.

    Recall is of the top tenth. The interval is of the rank correlation of pairs drawn with replacement.
    """
    by = [study]
    clean = obs.where(finite("p") & finite("y") & F.col(study).isNotNull()).select(study, key, "p", "y")
    rho = S.spearman(clean, "p", "y", by).withColumnRenamed("rho", "spearman")
    spread = F.stddev_pop("p") * F.stddev_pop("y")
    linear = clean.groupBy(*by).agg(F.when(spread > 0, F.covar_pop("p", "y") / spread).otherwise(0.0).alias("pearson"))
    recall = S.top_share_recall(clean, "p", "y", key, 0.1, by).select(*by, "recall")
    placed = S.with_ordinal_rank(clean, [key], by, "_r").select(*by, "p", "y", (F.col("_r") - 1).alias("at"))
    drawn = S.drawn_rows(placed, by, rounds, seed)
    again = S.spearman(drawn, "p", "y", [*by, "rep"]).select(*by, F.col("rho").alias("mean"))
    return rho.join(linear, by).join(recall, by).join(interval(again, by, rounds, rounds), by)


def transport_report(studies: DataFrame, control: str, min_studies: int = 2, min_cells: int = 20, max_i2: float = 0.75, min_sign: float = 0.7, max_control: float = 0.2) -> DataFrame:
    """One row: correlations pooled by study and by cell, heterogeneity, negative controls, blockers and status.

    ``control`` is a boolean column of the studies: a negative control whose correlation exceeds ``max_control`` blocks.
    """
    n, r = F.col("n").cast("double"), F.col("spearman")
    z, w = F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999))), F.greatest(F.lit(1.0), n - 3)
    big = lambda c: F.sum(F.when(n >= 4, c))
    t = studies.agg(
        F.count("*").alias("studies"), F.sum("n").alias("cells"), F.avg(r).alias("spearman"), F.avg("pearson").alias("pearson"), F.avg("recall").alias("recall"), (F.sum(r * n) / F.sum(n)).alias("cell_spearman"), (F.sum(F.col("pearson") * n) / F.sum(n)).alias("cell_pearson"),
        F.count(F.when(n >= 4, 1)).alias("k"), big(w).alias("sw"), big(w * w).alias("sw2"), big(w * z).alias("swz"), big(w * z * z).alias("swzz"), F.avg(F.when(n >= 4, (r > 0).cast("double"))).alias("sign"),
        F.min("n").alias("least"), F.count(F.when(F.col(control), 1)).alias("controls"), F.count(F.when(F.col(control) & (F.abs(r) > max_control), 1)).alias("failed"),
    )
    some = F.col("k") >= 2
    q = F.when(some, F.greatest(F.lit(0.0), F.col("swzz") - F.col("swz") * F.col("swz") / F.col("sw")))
    free = F.col("k") - 1
    i2 = F.when(q > 0, F.greatest(F.lit(0.0), (q - free) / q)).when(some, 0.0)
    tau2 = F.when(some, F.greatest(F.lit(0.0), (q - free) / F.greatest(F.lit(1e-12), F.col("sw") - F.col("sw2") / F.col("sw"))))
    codes = F.array_compact(F.array(
        F.when(F.col("studies") < min_studies, "insufficient_independent_studies"), F.when(F.col("least") < min_cells, "study_below_minimum_finite_cells"), F.when(i2 > max_i2, "excessive_between_study_heterogeneity"),
        F.when(some & (F.col("sign") < min_sign), "inconsistent_effect_direction_across_studies"), F.when(F.col("failed") > 0, "negative_control_signal_detected"),
    ))
    status = F.when(F.size(codes) > 0, "transportability_not_established").otherwise("transportable_predictive_signal_under_audited_benchmark")
    return t.select("studies", "cells", "spearman", "pearson", "recall", "cell_spearman", "cell_pearson", q.alias("q"), i2.alias("i2"), tau2.alias("tau2"), "sign", "controls", "failed", F.array_join(codes, "|").alias("blockers"), status.alias("status"))
