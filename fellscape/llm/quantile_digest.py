"""Percentiles of very large numeric columns with a deterministic rank error (problem 6).

A value is quantized to an ordered universe of 2^24 leaves: the top bits of its order-preserving
64-bit form, a relative resolution of 2^-12. A digest is a set of counted nodes of the dyadic tree over
these leaves. Two digests merge by adding the counts of equal nodes; compression folds a pair of
siblings and their parent into the parent while their sum is at most n/k. No inner node then
counts more than n/k, so a rank is wrong by at most depth * n / k = ``error`` * n, however often
digests were merged. Groups of fewer than k values are kept exactly (on the quantized universe).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 24
#: Rows of counted nodes a task holds before it compresses them.
BUFFER = 400_000


def leaf_of(values: np.ndarray) -> np.ndarray:
    """Leaf (0 .. 2^DEPTH - 1) of finite doubles; order-preserving, -0.0 as 0.0."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - DEPTH)).astype(np.int64)


def value_of(leaf: np.ndarray) -> np.ndarray:
    """The middle of a leaf's values."""
    ordered = (np.asarray(leaf).astype(np.uint64) << np.uint64(64 - DEPTH)) + np.uint64(1 << (63 - DEPTH))
    signed = ordered.view(np.int64)
    return np.where(signed < 0, signed ^ np.int64(-(2**63)), ~signed).view(np.float64)


def _summed(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(group) == 0:
        return group, node, count
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])])
    return group[start], node[start], np.add.reduceat(count, start)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded digests of all groups at once; nodes are numbered as in a heap (root 1).

    ``limit`` is n/k by group number. Groups with a limit of zero come back as they are.
    """
    group, node, count = _summed(group, node, count)
    small = limit[group] < 1
    kept = [(group[small], node[small], count[small])]
    group, node, count = group[~small], node[~small], count[~small]
    level = np.floor(np.log2(node.astype(np.float64))).astype(np.int64)
    rows = [(group[level == d], node[level == d], count[level == d]) for d in range(DEPTH + 1)]
    for d in range(DEPTH, 0, -1):
        g, n, c = rows[d]
        if len(g) == 0:
            continue
        pg, pn, pc = rows[d - 1]
        # sums of parents with their children
        ag, an, ac = _summed(np.r_[g, pg], np.r_[n >> 1, pn], np.r_[c, pc])
        fold = ac <= limit[ag]
        key = ag * (1 << (DEPTH + 2)) + an
        child = fold[np.searchsorted(key, g * (1 << (DEPTH + 2)) + (n >> 1))]
        parent = fold[np.searchsorted(key, pg * (1 << (DEPTH + 2)) + pn)]
        kept.append((g[~child], n[~child], c[~child]))
        rows[d - 1] = (np.r_[pg[~parent], ag[fold]], np.r_[pn[~parent], an[fold]], np.r_[pc[~parent], ac[fold]])
        # a parent that is not folded keeps its own row; a folded sum may be of a parent without children
        rows[d - 1] = _summed(*rows[d - 1])
    kept.append(rows[0])
    return tuple(np.concatenate(x) for x in zip(*kept))


def _limits(sizes: np.ndarray, error: float) -> np.ndarray:
    return np.floor(sizes * error / DEPTH).astype(np.int64)


def _digests(parts: Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]], by: list[str], error: float) -> Iterator[pd.DataFrame]:
    """Compressed digests of (group columns, node, count) parts that one task reads."""
    known: dict[tuple, int] = {}
    held: list[tuple] = []
    rows, most = 0, BUFFER

    def pressed():
        g, n, c = (np.concatenate(x) for x in zip(*held))
        sizes = np.bincount(g, weights=c, minlength=len(known)).astype(np.int64)
        return compress(g, n, c, _limits(sizes, error))

    for keys, node, count in parts:
        if len(node) == 0:
            continue
        codes, uniques = pd.MultiIndex.from_frame(keys).factorize() if len(by) > 1 else pd.factorize(keys[by[0]])
        labels = [u if isinstance(u, tuple) else (u,) for u in uniques]
        mine = np.array([known.setdefault(u, len(known)) for u in labels], np.int64)
        held.append(_summed(mine[codes], node, count))
        rows += len(held[-1][0])
        if rows > most:
            held = [pressed()]
            rows = len(held[0][0])
            most = max(BUFFER, 2 * rows)
    if held:
        g, n, c = pressed()
        names = list(known)
        out = pd.DataFrame({b: pd.Series([x[i] for x in names], dtype=object).to_numpy()[g] for i, b in enumerate(by)})
        out["node"], out["cnt"] = n, c
        yield out


def build_digests(df: DataFrame, by: list[str], value: str, error: float = 0.005) -> DataFrame:
    """Digest rows (``by``, node, cnt) of the finite values of every group.

    Null, NaN and infinite values and rows with a null in ``by`` are left out; empty groups and
    tables give no rows. Every task compresses what it reads before the shuffle, so a group with a
    third of all rows sends at most 3k nodes per task. ``by`` columns must be strings.
    """
    if [t for c, t in df.select(*by).dtypes if t != "string"]:
        raise TypeError("group columns must be strings")
    x = F.col(value).cast("double")
    clean = df.select(*by, x.alias("_x")).dropna().where(~F.isnan("_x") & (F.abs("_x") < float("inf")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _digests(((b[by], leaf_of(b["_x"].to_numpy()) + (1 << DEPTH), np.ones(len(b), np.int64)) for b in batches), by, error)

    schema = ", ".join(f"`{c}` STRING" for c in by) + ", node BIGINT, cnt BIGINT"
    return merge_digests(clean.mapInPandas(run, schema), by, error)


def merge_digests(digests: DataFrame, by: list[str], error: float = 0.005) -> DataFrame:
    """Digests of coarser groups: counts of equal nodes added, then compressed again.

    ``digests`` may come from different days or partitions and may have more group columns than
    ``by``. Counts are added by (group, node) first, so no task sees more rows of a group than
    the tree has nodes.
    """
    added = digests.groupBy(*by, "node").agg(F.sum("cnt").alias("cnt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _digests(((b[by], b["node"].to_numpy(np.int64), b["cnt"].to_numpy(np.int64)) for b in batches), by, error)

    schema = ", ".join(f"`{c}` STRING" for c in by) + ", node BIGINT, cnt BIGINT"
    return added.repartition(*[F.col(c) for c in by]).mapInPandas(run, schema)


def digest_quantiles(digests: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """``by``, n and one column per percentile: the value at rank ceil(q * n), within the error.

    Nodes are read in the order of their right ends, narrower first; the answer is the right end
    of the first node at which the running count reaches the rank. A group has at most 3k nodes.
    """
    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    right = F.expr(f"shiftleft(node + 1, {DEPTH} - level) - 1 - {1 << DEPTH}L")
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    run = w.orderBy("right_end", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    cum = digests.withColumn("level", level).withColumn("right_end", right).withColumn("seen", F.sum("cnt").over(run)).withColumn("n", F.sum("cnt").over(w))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
    leafs = cum.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("seen") >= rank(q), F.col("right_end"))).alias(c) for c, q in qs.items()])

    @F.pandas_udf("double")
    def decoded(s: pd.Series) -> pd.Series:
        return pd.Series(value_of(s.to_numpy(np.int64)))

    return leafs.select(*by, "n", *[decoded(c).alias(c) for c in qs])
