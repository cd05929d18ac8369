"""Gene-program scores, modalities, top genes and per-cell ledgers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite, gene_name, sigmoid


def long_genes(cells: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, gene, value): one row per finite number of a vector, genes numbered from 0."""
    return cells.select(key, F.posexplode(vector).alias("gene", "value")).where(finite("value"))


def alias_table(programs: DataFrame, program: str, genes: str) -> DataFrame:
    """(program, gene, position): genes of a list parted by bars or semicolons, canonical, first position kept."""
    parts = programs.select(program, F.posexplode(F.split(genes, "[|;]")).alias("position", "g"))
    named = parts.select(program, "position", gene_name("g").alias("gene")).where("gene <> ''")
    return named.groupBy(program, "gene").agg(F.min("position").alias("position"))


def program_scores(genes: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """(key, program, score, z, coverage): mean of a program's markers, z against the other genes of the cell.

    ``markers``: program, gene. The background sums are the cell's totals minus the markers', so no
    cell meets its non-markers once per program. The deviation is at least 1e-6.
    """
    total = genes.groupBy(key).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    size = markers.groupBy("program").agg(F.count_distinct("gene").alias("size"))
    hit = genes.join(markers.select("program", "gene").distinct(), "gene").groupBy(key, "program").agg(F.count("*").alias("m"), F.sum("value").alias("ms"), F.sum(F.col("value") * F.col("value")).alias("ms2"))
    x = hit.join(total, key).join(size, "program")
    bn = (F.col("n") - F.col("m")).cast("double")
    mean = (F.col("s") - F.col("ms")) / bn
    var = F.greatest(F.lit(0.0), (F.col("s2") - F.col("ms2") - bn * mean * mean) / (bn - 1))
    z = F.when(bn > 1, (F.col("ms") / F.col("m") - mean) / F.greatest(F.sqrt(var), F.lit(1e-6)))
    return x.select(key, "program", (F.col("ms") / F.col("m")).alias("score"), z.alias("z"), (F.col("m") / F.col("size")).alias("coverage"))


def dominant_programs(scores: DataFrame, key: str, top: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """(key, rank, program, z, evidence): the highest z per cell with an evidence level."""
    w = Window.partitionBy(key).orderBy(F.desc("z"), "program")
    level = F.when(F.col("coverage") >= min_coverage, "measured").otherwise("partial")
    return scores.where("z is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "rank", "program", "z", level.alias("evidence"))


def predicted_state(scores: DataFrame, key: str, positive: str, negative: str) -> DataFrame:
    """(key, probability, state): logistic of the difference of two programs' z, with a state ladder."""
    pick = lambda p: F.coalesce(F.max(F.when(F.col("program") == p, F.col("z"))), F.lit(0.0))
    p = sigmoid(pick(positive) - pick(negative))
    out = scores.groupBy(key).agg(p.alias("probability"))
    return out.withColumn("state", F.when(F.col("probability") >= 0.7, "committed").when(F.col("probability") <= 0.3, "uncommitted").otherwise("undecided"))


def top_variance_genes(genes: DataFrame, top: int) -> DataFrame:
    """(gene, variance): the genes of the greatest population variance, ties to the smaller gene."""
    return genes.groupBy("gene").agg(F.var_pop("value").alias("variance")).orderBy(F.desc("variance"), "gene").limit(top)


def gathered(cells: DataFrame, key: str, vector: str, genes: Sequence[int]) -> DataFrame:
    """Cells with only the numbers of ``genes``, in that order."""
    return cells.select(key, F.array(*[F.get(vector, F.lit(int(g))) for g in genes]).alias(vector))


def feature_z(genes: DataFrame, key: str) -> DataFrame:
    """(key, gene, z): z-score per gene across cells, sample deviation at least 1e-9."""
    stats = genes.groupBy("gene").agg(F.avg("value").alias("m"), F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-9)).alias("sd"))
    return genes.join(stats, "gene").select(key, "gene", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))


def population_context(z: DataFrame, key: str, top: int = 8) -> DataFrame:
    """(key, rms, genes): root mean square z and the genes of the greatest |z|, as text joined by bars."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("z")), "gene")
    ranked = z.withColumn("r", F.row_number().over(w))
    rms = z.groupBy(key).agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"))
    best = ranked.where(F.col("r") <= top).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "gene"))), lambda s: s["gene"]).alias("g"))
    return rms.join(best, key).select(key, "rms", F.array_join(F.transform("g", lambda x: x.cast("string")), "|").alias("genes"))


def column_moments(genes: DataFrame) -> DataFrame:
    """(gene, n, mean, variance): Welford-stable moments; partial and final aggregates merge across tasks."""
    return genes.groupBy("gene").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))


def covariance_matrix(cells: DataFrame, vector: str, dim: int, shrink: float = 0.0) -> DataFrame:
    """(a, b, cov) for a <= b: sample covariance of the vectors of ``dim`` finite numbers; others are left out.

    Every task adds up the products of its rows, shifted by the means, in numpy and sends
    dim * (dim + 1) / 2 sums; there is no self join of genes. ``shrink`` moves the matrix towards
    the isotropic one of equal trace. Fewer than two vectors give nulls.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = cells.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, bad)).select(F.col(vector).cast("array<double>").alias("x"))
    first = rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(dim)]).first()
    shift = np.array([v or 0.0 for v in first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - shift
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        a, c = np.triu_indices(dim)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(np.full(len(a), n)), pa.array(s[a]), pa.array(s[c]), pa.array(p[a, c])], names=["a", "b", "n", "sa", "sb", "p"])

    t = rows.mapInArrow(run, "a INT, b INT, n BIGINT, sa DOUBLE, sb DOUBLE, p DOUBLE").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "p")])
    c = (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    out = t.select("a", "b", c.alias("cov"))
    if not shrink:
        return out
    trace = out.where("a = b").agg(F.sum("cov").alias("t"))  # one row
    return out.crossJoin(trace).select("a", "b", ((1 - shrink) * F.col("cov") + F.when(F.col("a") == F.col("b"), shrink * F.col("t") / dim).otherwise(0.0)).alias("cov"))


def principal_axes(cells: DataFrame, vector: str, dim: int, k: int) -> tuple[DataFrame, list[list[float]]]:
    """(cells with pc0.., loadings): principal components from the covariance of all rows.

    Only the dim x dim covariance reaches the driver. The sign makes the largest absolute loading
    of each axis positive.
    """
    c = np.zeros((dim, dim))
    for a, b, v in covariance_matrix(cells, vector, dim).collect():  # dim * (dim + 1) / 2 rows
        c[a, b] = c[b, a] = v or 0.0
    values, vectors = np.linalg.eigh(c)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    axes *= np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
    means = cells.agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    out = cells
    for n, axis in enumerate(axes):
        e = F.lit(0.0)
        for i in range(dim):
            e = e + (F.get(vector, F.lit(i)) - float(means[i])) * float(axis[i])
        out = out.withColumn(f"pc{n}", e)
    return out, axes.tolist()
