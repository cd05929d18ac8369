"""Ranks, robust statistics, calibration, information and resampling over grouped tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite, hash_index, hash_uniform
from fellscape.session import cut


def average_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1 with ties averaged."""
    order = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def ordinal_rank(x: str, key: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1 with ties in the order of the key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(x, key))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of a weight over the rows of its group up to each row, in an order without ties.

    Rows are range-partitioned by (group, order): windows run inside partitions only and are lifted by
    the totals of the partitions before, so neither a group nor the whole table is sorted in one task.
    """
    spread = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).withColumn("_w", weight))
    per = spread.groupBy(*by, "_p").agg(F.sum("_w").alias("_s"))  # one row a group and partition
    before = per.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_p").alias("_q"), (F.sum("_s").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_s")).alias("_o"))
    inner = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    out = spread.withColumn("_i", F.sum("_w").over(inner)).join(before, same)
    return out.withColumn(name, F.col("_o") + F.col("_i")).select(*df.columns, name)


def with_average_rank(df: DataFrame, x: str, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the rank of x from 1, ties averaged; equal values are counted before they are ordered."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("_n"))
    ranks = running_total(counts, by, [x], F.col("_n"), "_upto").select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col(x).alias("_x"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    same = F.col(x) == F.col("_x")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return df.join(ranks, same).select(*df.columns, name)


def with_ordinal_rank(df: DataFrame, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place from 1 in an order without ties."""
    return running_total(df, by, order, F.lit(1), name)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with averaged ties over finite pairs; 0 for constant input or fewer than two pairs."""
    clean = df.where(finite(x) & finite(y)).select(*by, x, y)
    ranked = with_average_rank(with_average_rank(clean, x, by, "_rx"), y, by, "_ry")
    flat = (F.var_pop("_rx") == 0) | (F.var_pop("_ry") == 0) | (F.count("*") < 2)
    rho = F.covar_pop("_rx", "_ry") / (F.stddev_pop("_rx") * F.stddev_pop("_ry"))  # corr() itself fails on constants
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(flat, 0.0).otherwise(rho).alias("rho"))


def spearman_ordinal(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) on ordinal ranks; 0 for fewer than two rows."""
    clean = df.where(finite(x) & finite(y)).select(*by, x, y, key)
    ranked = with_ordinal_rank(with_ordinal_rank(clean, [x, key], by, "_rx"), [y, key], by, "_ry")
    d, n = (F.col("_rx") - F.col("_ry")).cast("double"), F.count("*").cast("double")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(n < 2, 0.0).otherwise(1 - 6 * F.sum(d * d) / (n * (n * n - 1))).alias("rho"))


def robust_summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, unscaled MAD, p05, p95 and sample deviation of finite values."""
    clean = df.where(finite(x))
    base = clean.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_p"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd")
    )
    gap = (clean.join(base.select(*by, F.col("_p")[1].alias("_m")), list(by)) if by else clean.crossJoin(base.select(F.col("_p")[1].alias("_m")))).groupBy(*by).agg(F.percentile(F.abs(F.col(x) - F.col("_m")), 0.5).alias("mad"))
    met = base.join(gap, list(by)) if by else base.crossJoin(gap)
    return met.select(*by, "n", "mean", F.col("_p")[1].alias("median"), "mad", F.col("_p")[0].alias("p05"), F.col("_p")[2].alias("p95"), "sd")


def winsorized_mean(df: DataFrame, x: str, by: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean of values moved into the range of two percentiles."""
    clean = df.where(finite(x))
    edge = clean.groupBy(*by).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("_e"))
    met = clean.join(edge, list(by)) if by else clean.crossJoin(edge)
    return met.groupBy(*by).agg(F.avg(F.least(F.greatest(F.col(x), F.col("_e")[0]), F.col("_e")[1])).alias("winsorized_mean"))


def weighted_quantile(df: DataFrame, x: str, weight: str, key: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """First value at which the running weight reaches q of the total; weights at or below 0 count nothing."""
    clean = df.where(finite(x) & (F.col(weight) > 0)).select(*by, x, weight, key)
    seen = running_total(clean, by, [x, key], F.col(weight), "_c")
    total = clean.groupBy(*by).agg(F.sum(weight).alias("_t"))
    met = seen.join(total, list(by)) if by else seen.crossJoin(total)
    return met.where(F.col("_c") >= q * F.col("_t")).groupBy(*by).agg(F.min(x).alias("value"))


def weighted_moments(df: DataFrame, x: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and variance, effective sample size and coefficient of variation."""
    w, v = F.col(weight), F.col(x)
    m = F.sum(w * v) / F.sum(w)
    return df.where(finite(x) & (w > 0)).groupBy(*by).agg(
        m.alias("weighted_mean"), (F.sum(w * v * v) / F.sum(w) - m * m).alias("weighted_variance"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"),
        F.when(F.avg(x) != 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.abs(F.avg(x))).otherwise(0.0).alias("variation"),
    )


def jackknife(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Range and standard error of the leave-one-out means, in one pass over sums."""
    clean = df.where(finite(x))
    n, s, s2 = F.count("*").cast("double"), F.sum(x), F.sum(F.col(x) * F.col(x))
    return clean.groupBy(*by).agg(
        F.count("*").alias("n"), ((s - F.max(x)) / F.nullif(n - 1, F.lit(0.0))).alias("low"), ((s - F.min(x)) / F.nullif(n - 1, F.lit(0.0))).alias("high"), F.sqrt(F.greatest(F.lit(0.0), s2 - s * s / n) / F.nullif(n * (n - 1), F.lit(0.0))).alias("standard_error")
    ).where("n > 1")


def scores(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss (probabilities kept 1e-12 off the ends), mean absolute and root mean square error."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    e = F.col(p) - F.col(y)
    return df.where(finite(p) & finite(y)).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("brier"), F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def reliability_bins(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Half-open bins of predictions (1.0 in the last) with mean prediction, mean outcome and gap."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins).cast("int"))
    return df.where(finite(p) & finite(y) & F.col(p).between(0, 1)).groupBy(*by, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"), F.abs(F.avg(p) - F.avg(y)).alias("gap")
    )


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and greatest calibration error of reliability bins."""
    return bins.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def top_share_recall(df: DataFrame, p: str, y: str, key: str, share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Share of the top ceil(share * n) outcomes that are among as many top predictions."""
    clean = df.where(finite(p) & finite(y)).select(*by, F.col(key).alias("_key"), (-F.col(p)).alias("_p_"), (-F.col(y)).alias("_y_"))
    size = clean.groupBy(*by).agg(F.ceil(F.lit(share) * F.count("*")).alias("k"))
    ranked = with_ordinal_rank(with_ordinal_rank(clean, ["_p_", "_key"], by, "_rp"), ["_y_", "_key"], by, "_ry")
    met = ranked.join(size, list(by)) if by else ranked.crossJoin(size)
    return met.groupBy(*by).agg(F.max("k").alias("k"), (F.sum(((F.col("_rp") <= F.col("k")) & (F.col("_ry") <= F.col("k"))).cast("double")) / F.max("k")).alias("recall"))


def least_squares(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, R^2, RMSE and ranges of a straight line."""
    clean = df.where(finite(x) & finite(y))
    a, b = F.regr_slope(y, x), F.regr_intercept(y, x)
    r2 = F.regr_r2(y, x)
    return clean.groupBy(*by).agg(F.count("*").alias("n"), a.alias("slope"), b.alias("intercept"), r2.alias("r2"), F.sqrt(F.var_pop(y) * (1 - r2)).alias("rmse"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with bin numbers ``<column>_bin`` over each group's range; a group without width has bin 0."""
    edge = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.join(edge, list(by)) if by else df.crossJoin(edge)
    out = {}
    for c in columns:
        lo, width = F.col(f"_lo_{c}"), (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins
        out[f"{c}_bin"] = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / width).cast("int"))).otherwise(0)
    return met.withColumns(out).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def entropy_of(df: DataFrame, symbols: Sequence[str], by: Sequence[str] = (), name: str = "entropy") -> DataFrame:
    """Shannon entropy (natural) of the joint symbols per group."""
    counts = df.groupBy(*by, *symbols).agg(F.count("*").alias("_n"))
    total = F.sum("_n")
    return counts.groupBy(*by).agg((F.log(total) - F.sum(F.col("_n") * F.log("_n")) / total).alias(name), total.alias("n"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """H(x) + H(y) - H(x, y) of equal-width histograms, one aggregation per entropy over shared counts."""
    binned = equal_width_bins(df.where(finite(x) & finite(y)), [x, y], bins, by)
    parts = [entropy_of(binned, s, by, n) for s, n in (([f"{x}_bin"], "hx"), ([f"{y}_bin"], "hy"), ([f"{x}_bin", f"{y}_bin"], "hxy"))]
    if by:
        met = parts[0].join(parts[1].drop("n"), list(by)).join(parts[2].drop("n"), list(by))
    else:
        met = parts[0].crossJoin(parts[1].drop("n")).crossJoin(parts[2].drop("n"))
    return met.select(*by, "n", "hx", "hy", F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")).alias("mutual_information"))


def transfer_entropy(df: DataFrame, source: str, target: str, order: Sequence[str], bins: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """Lag-1 transfer entropy: H(t, t-) + H(t-, s-) - H(t-) - H(t, t-, s-)."""
    binned = equal_width_bins(df.where(finite(source) & finite(target)), [source, target], bins, by)
    w = Window.partitionBy(*by).orderBy(*order)
    lagged = binned.select(*by, F.col(f"{target}_bin").alias("t"), F.lag(f"{target}_bin").over(w).alias("t0"), F.lag(f"{source}_bin").over(w).alias("s0")).where("t0 is not null")
    parts = [entropy_of(lagged, s, by, n) for s, n in ((["t", "t0"], "a"), (["t0", "s0"], "b"), (["t0"], "c"), (["t", "t0", "s0"], "d"))]
    met = parts[0]
    for p in parts[1:]:
        met = met.join(p.drop("n"), list(by)) if by else met.crossJoin(p.drop("n"))
    return met.select(*by, "n", F.greatest(F.lit(0.0), F.col("a") + F.col("b") - F.col("c") - F.col("d")).alias("transfer_entropy"))


def roughness(df: DataFrame, x: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Square root of the sample variance of successive differences."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.where(finite(x)).withColumn("_d", F.col(x) - F.lag(x).over(w)).groupBy(*by).agg(F.sqrt(F.coalesce(F.var_samp("_d"), F.lit(0.0))).alias("roughness"))


def bootstrap_means(df: DataFrame, x: str, key: str, replicates: int, by: Sequence[str] = (), seed: int = 11) -> DataFrame:
    """(by, rep, mean): means of samples with replacement, drawn by portable hashes.

    Rows are numbered per group in the order of ``key``; draw i of replicate r takes row
    hash(seed, r, i) mod n, so the same samples come out in any engine.
    """
    clean = with_ordinal_rank(df.where(finite(x)).select(*by, F.col(x).alias("x"), key), [key], by, "_r").select(*by, "x", (F.col("_r") - 1).alias("at"))
    return drawn_rows(clean, by, replicates, seed).groupBy(*by, "rep").agg(F.avg("x").alias("mean"))


def drawn_rows(placed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Samples with replacement of every group, by ``rep``; ``placed`` numbers the rows of a group from 0 in ``at``."""
    n = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    draws = (placed.join(n, list(by)) if by else placed.crossJoin(n)).select(*by, "_n", "at", reps.alias("rep"))
    draws = draws.select(*by, "rep", hash_index(F.col("_n"), F.lit(seed), "rep", "at").alias("at"))
    return draws.join(placed, [*by, "at"])


def bootstrap_interval(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, standard error and interpolated 2.5 and 97.5 percentiles of replicate means."""
    return means.groupBy(*by).agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("standard_error"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def permutation_test(df: DataFrame, x: str, group: str, key: str, replicates: int, seed: int = 13) -> DataFrame:
    """Two-sample test of the difference of means (true minus false), labels permuted by hashes; add-one p."""
    clean = df.where(finite(x) & F.col(group).isNotNull()).select(F.col(x).alias("x"), F.col(group).cast("boolean").alias("g"), F.col(key).alias("k"))
    diff = F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))
    seen = clean.agg(diff.alias("observed"), F.sum(F.col("g").cast("int")).alias("m"))
    reps = clean.select("x", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = reps.withColumn("u", hash_uniform(F.lit(seed), "rep", "k"))
    mixed = with_ordinal_rank(drawn, ["u", "k"], ["rep"], "place").crossJoin(seen).withColumn("g", F.col("place") <= F.col("m"))
    null = mixed.groupBy("rep", "observed").agg(diff.alias("d"))
    return null.groupBy("observed").agg(((F.sum((F.abs("d") >= F.abs("observed") - 1e-12).cast("int")) + 1) / (F.count("*") + 1.0)).alias("p_value"), F.avg("d").alias("null_mean"))


def sign_flip_test(df: DataFrame, x: str, key: str, replicates: int, by: Sequence[str] = (), seed: int = 17) -> DataFrame:
    """Mean of paired differences against random signs drawn by hashes; add-one p."""
    clean = df.where(finite(x))
    seen = clean.groupBy(*by).agg(F.avg(x).alias("observed"), F.count("*").alias("n"))
    reps = clean.select(*by, F.col(x).alias("x"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    sign = F.when(hash_uniform(F.lit(seed), "rep", "k") < 0.5, -1.0).otherwise(1.0)
    null = reps.groupBy(*by, "rep").agg(F.avg(sign * F.col("x")).alias("d"))
    met = null.join(seen, list(by)) if by else null.crossJoin(seen)
    return met.groupBy(*by, "observed", "n").agg(((F.sum((F.abs("d") >= F.abs("observed") - 1e-12).cast("int")) + 1) / (F.count("*") + 1.0)).alias("p_value"))


def kde_profile(df: DataFrame, q: str, by: Sequence[str] = (), points: int = 60, bandwidth: float = 0.08, temperature: float = 1.0) -> DataFrame:
    """(by, at, density, free_energy): mirrored Gaussian density of q in [0, 1] on a grid, F = -T ln density, least 0.

    Values are first counted in 2^-10 wide bins, so the grid meets at most 1,024 weighted rows a group.
    """
    binned = df.where(finite(q)).groupBy(*by, F.round(F.col(q) * 1024).alias("_b")).agg(F.count("*").alias("_n"))
    rows = binned.select(*by, (F.col("_b") / 1024.0).alias("_q"), "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("at"))
    x = F.col("at") / float(points - 1)
    k = lambda m: F.exp(-((x - m) ** 2) / (2 * bandwidth**2))
    mass = F.sum(F.col("_n") * (k(F.col("_q")) + k(-F.col("_q")) + k(2 - F.col("_q"))))
    dens = rows.groupBy(*by, "at").agg((mass / F.sum("_n") / (bandwidth * 2.5066282746310002)).alias("density"))
    low = F.min(-temperature * F.log(F.greatest("density", F.lit(1e-12)))).over(Window.partitionBy(*by))
    return dens.withColumn("free_energy", -temperature * F.log(F.greatest("density", F.lit(1e-12))) - low)
