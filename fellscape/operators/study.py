"""Study, trial, replication and evidence operators over observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite


def donor_effects(obs: DataFrame, arm: str, donor: str, outcome: str, control: str) -> DataFrame:
    """(arm, donors, effect, sd, positive): donor-paired differences of mean outcome against the control arm."""
    means = obs.where(F.col(donor).isNotNull() & F.col(arm).isNotNull() & finite(outcome)).groupBy(arm, donor).agg(F.avg(outcome).alias("m"))
    base = means.where(F.col(arm) == control).select(donor, F.col("m").alias("c"))
    diff = means.where(F.col(arm) != control).join(base, donor).withColumn("d", F.col("m") - F.col("c"))
    return diff.groupBy(arm).agg(F.count("*").alias("donors"), F.avg("d").alias("effect"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), F.avg((F.col("d") > 0).cast("double")).alias("positive"))


def trial_effects(obs: DataFrame, arm: str, donor: str, outcome: str, treated: str, control: str, min_cells: int = 1) -> DataFrame:
    """(donor, treated, control, effect, blocked): per donor both arms' means, blocked below ``min_cells`` cells an arm."""
    two = obs.where(F.col(donor).isNotNull() & F.col(arm).isin(treated, control) & finite(outcome))
    side = lambda a, f: f(F.when(F.col(arm) == a, F.col(outcome)))
    both = two.groupBy(donor).agg(side(treated, F.avg).alias("treated"), side(control, F.avg).alias("control"), side(treated, F.count).alias("n_treated"), side(control, F.count).alias("n_control"))
    return both.select(donor, "treated", "control", (F.col("treated") - F.col("control")).alias("effect"), (F.least("n_treated", "n_control") < min_cells).alias("blocked"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys shared, only left, only right."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    met = a.join(b, key, "full")
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return met.agg(F.coalesce(F.sum((l & r).cast("bigint")), F.lit(0)).alias("shared"), F.coalesce(F.sum((l & ~r).cast("bigint")), F.lit(0)).alias("only_left"), F.coalesce(F.sum((~l & r).cast("bigint")), F.lit(0)).alias("only_right"))


def fate_shares(obs: DataFrame, cell: str, fate: str) -> DataFrame:
    """(cell, fate, n, share): frequency of each fate of a cell."""
    n = obs.where(F.col(cell).isNotNull() & F.col(fate).isNotNull()).groupBy(cell, fate).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cell)))


def fate_calibration(predicted: DataFrame, observed: DataFrame, key: str, share: str) -> DataFrame:
    """Gap of predicted and observed shares over the union of categories; a missing side is 0."""
    a = predicted.select(key, F.col(share).alias("predicted"))
    b = observed.select(key, F.col(share).alias("observed"))
    met = a.join(b, key, "full").select(key, F.coalesce("predicted", F.lit(0.0)).alias("predicted"), F.coalesce("observed", F.lit(0.0)).alias("observed"))
    return met.withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def keep_first(df: DataFrame, content: Sequence[str], key: str) -> DataFrame:
    """Rows whose content was not seen under a smaller key."""
    mark = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    return df.withColumn("fingerprint", mark).withColumn("_n", F.row_number().over(Window.partitionBy("fingerprint").orderBy(key))).where("_n = 1").drop("_n")


def transportability(per_study: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """One row pooling studies' correlations: means, Fisher z heterogeneity Q, I^2, tau^2, sign consistency."""
    z = F.atanh(F.least(F.greatest(F.col(rho), F.lit(-0.999999)), F.lit(0.999999)))
    s = per_study.where((F.col(n) > 3) & finite(rho)).select(z.alias("z"), (F.col(n) - 3.0).alias("w"), F.col(rho).alias("r"), F.col(n).alias("m"))
    t = s.agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("z")).alias("swz"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("swzz"),
              F.avg("r").alias("equal_mean"), (F.sum(F.col("r") * F.col("m")) / F.sum("m")).alias("cell_mean"), F.avg((F.col("r") > 0).cast("double")).alias("pos"))
    q = F.greatest(F.lit(0.0), F.col("swzz") - F.col("swz") * F.col("swz") / F.col("sw"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    return t.select("k", "equal_mean", "cell_mean", F.tanh(F.col("swz") / F.col("sw")).alias("pooled"), q.alias("q"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"),
                    F.when(c > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / c)).otherwise(0.0).alias("tau2"), F.greatest("pos", 1 - F.col("pos")).alias("sign_consistency"))


def holdout_donors(donors: DataFrame, donor: str, share: float = 0.25, seed: int = 3) -> DataFrame:
    """(donor, held_out): the ceil(share * n) donors of the smallest hashes are held out."""
    from fellscape.functions.scalar import hash_uniform
    from fellscape.operators.stats import with_ordinal_rank

    d = donors.select(donor).where(F.col(donor).isNotNull()).distinct().withColumn("_u", hash_uniform(F.lit(seed), donor))
    n = d.agg(F.ceil(F.lit(share) * F.count("*")).alias("_k"))  # one row
    return with_ordinal_rank(d, ["_u", donor], [], "_r").crossJoin(n).select(donor, (F.col("_r") <= F.col("_k")).alias("held_out"))


def path_ensemble(works: DataFrame, by: Sequence[str], direction: str, forward: str, temperature: float = 1.0) -> DataFrame:
    """Per protocol: forward and reverse free energies, gap, dissipation; log-mean-exp with a max shift."""
    signed = works.select(*by, (F.col(direction) == forward).alias("fwd"), F.col("work"))
    top = signed.groupBy(*by, "fwd").agg(F.max(-F.col("work") / temperature).alias("m"))
    side = signed.join(top, [*by, "fwd"]).groupBy(*by, "fwd", "m").agg((-temperature * (F.col("m") + F.log(F.avg(F.exp(-F.col("work") / temperature - F.col("m")))))).alias("df"), F.count("*").alias("n"), F.avg("work").alias("w"))
    pick = lambda c, fwd: F.max(F.when(F.col("fwd") == fwd, F.col(c)))
    wide = side.groupBy(*by).agg(pick("df", True).alias("forward"), (-pick("df", False)).alias("reverse"), pick("n", True).alias("n_forward"), pick("n", False).alias("n_reverse"), pick("w", True).alias("w"))
    return wide.select(*by, "n_forward", "n_reverse", "forward", "reverse", F.abs(F.col("forward") - F.col("reverse")).alias("gap"), (F.col("w") - F.col("forward")).alias("dissipation"))


def crooks_crossing(works: DataFrame, by: Sequence[str], direction: str, forward: str, bins: int = 20) -> DataFrame:
    """(by, crossing): first zero of the smoothed log ratio of forward works and negated reverse works, interpolated."""
    x = F.when(F.col(direction) == forward, F.col("work")).otherwise(-F.col("work"))
    rows = works.select(*by, (F.col(direction) == forward).alias("fwd"), x.alias("x"))
    edge = rows.groupBy(*by).agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / bins).alias("width"))
    counts = rows.join(edge, list(by)).where("width > 0").groupBy(*by, "lo", "width", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.col("width"))).cast("int").alias("bin")).agg(
        F.sum(F.col("fwd").cast("int")).alias("f"), F.sum((~F.col("fwd")).cast("int")).alias("r")
    )
    grid = edge.where("width > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts.select(*by, "bin", "f", "r"), [*by, "bin"], "left")
    ratio = full.select(*by, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("mid"), F.log((F.coalesce("f", F.lit(0)) + 0.5) / (F.coalesce("r", F.lit(0)) + 0.5)).alias("y"))
    w = Window.partitionBy(*by).orderBy("bin")
    step = ratio.withColumn("y1", F.lead("y").over(w)).withColumn("mid1", F.lead("mid").over(w)).where("y * y1 <= 0 and y <> y1")
    at = F.col("mid") - F.col("y") * (F.col("mid1") - F.col("mid")) / (F.col("y1") - F.col("y"))
    return step.groupBy(*by).agg(F.min_by(at, "bin").alias("crossing"))


def work_histogram(works: DataFrame, by: Sequence[str], bins: int = 24) -> DataFrame:
    """(by, bin, n): equal-width histogram of work per group."""
    from fellscape.operators.stats import equal_width_bins

    return equal_width_bins(works.where(finite("work")), ["work"], bins, by).groupBy(*by, F.col("work_bin").alias("bin")).agg(F.count("*").alias("n"))


def protocol_check(works: DataFrame, by: Sequence[str], direction: str, min_each: int = 5) -> DataFrame:
    """Per protocol: finite works, directions, issue codes joined by a bar, and a ready flag."""
    t = works.groupBy(*by).agg(F.sum(finite("work").cast("int")).alias("finite"), F.count("*").alias("n"), F.count_distinct(direction).alias("directions"))
    codes = F.array_compact(F.array(F.when(F.col("finite") < F.col("n"), "non_finite_work"), F.when(F.col("directions") < 2, "no_reverse"), F.when(F.col("finite") < min_each, "too_few")))
    return t.withColumn("issues", F.array_join(codes, "|")).withColumn("ready", F.size(codes) == 0)


def gate(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, blockers, decision): sorted codes of the rules (SQL conditions) that hold; blocked, else pass."""
    codes = F.array_compact(F.array(*[F.when(F.expr(cond), code) for code, cond in sorted(rules.items())]))
    return rows.select(key, F.array_join(codes, "|").alias("blockers"), F.when(F.size(codes) > 0, "blocked").otherwise("pass").alias("decision"))


def posterior(obs: DataFrame, arm: str, success: str, donor: str, prior: tuple[float, float] = (1.0, 1.0), min_donors: int = 2) -> DataFrame:
    """Beta posterior of each arm's success, with its mean, deviation and a donor gate."""
    t = obs.where(F.col(arm).isNotNull() & F.col(success).isNotNull()).groupBy(arm).agg(F.sum(F.col(success).cast("int")).alias("s"), F.count("*").alias("n"), F.count_distinct(donor).alias("donors"))
    a, b = prior[0] + F.col("s"), prior[1] + F.col("n") - F.col("s")
    return t.select(arm, a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"), "donors", (F.col("donors") >= min_donors).alias("replicated"))
