"""Exact nearest neighbours without comparing all pairs.

Points are put into the cells of pivot points. A cell's own points bound each point's k-th
distance; only the cells that this ball can reach across the bisecting plane of two pivots are
searched as well. The result is exact, and a point meets the points near it, not all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.functions.arrow import matrix, packed, sorted_groups
from fellscape.session import cut, parallelism

#: Points a cell should hold, pivots at most (they reach the driver), points scanned in one piece.
CELL, MAX_PIVOTS, PIECE = 1024, 4096, 4096
#: Distances are held for so many pairs at once.
PAIRS = 1 << 20

_FOUND = "src BIGINT, dst BIGINT, dist DOUBLE, probe BOOLEAN, cell INT, piece INT, key BIGINT, x BINARY, reach DOUBLE"
_NAMES = ["src", "dst", "dist", "probe", "cell", "piece", "key", "x", "reach"]


def exact_knn(points: DataFrame, key: str, dims: Sequence[str], k: int, digits: int = 9) -> DataFrame:
    """(src, dst, rank, dist): the k nearest other points of every point by Euclidean distance.

    Order by (distance rounded to ``digits``, key). Points with a null key or coordinate take no
    part; a point alone has no neighbours; an empty table gives no rows. Keys must be unique.
    """
    spark, width = points.sparkSession, len(dims)
    clean = points.select(F.col(key).cast("bigint").alias("key"), *[F.col(d).cast("double").alias(f"d{i}") for i, d in enumerate(dims)]).dropna()
    n = clean.count()
    count = int(min(MAX_PIVOTS, max(1, n // CELL)))
    pivots = np.zeros((1, width))
    if count > 1:
        picked = clean.select(*[f"d{i}" for i in range(width)]).orderBy(F.xxhash64("key"), "key").limit(count).collect()
        pivots = np.unique(np.array([tuple(r) for r in picked]), axis=0)
    placed = clean.mapInArrow(_placing(pivots, width), "cell INT, key BIGINT, x BINARY")
    by = ["cell", "piece"]
    if count > 1:
        placed = cut(placed)
        full = placed.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # one row a pivot
        placed = placed.join(full, "cell").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    else:
        # one cell only where n < 2 * CELL, so one piece
        placed = placed.withColumn("pieces", F.lit(1)).withColumn("piece", F.lit(0))
    parts = 1 if count == 1 else 2 * parallelism(spark)
    home = placed.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(_own_cell(pivots, width, k, digits), _FOUND)
    best = Window.partitionBy("src").orderBy(F.round("dist", digits), "dst")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("src", "dst", "rank", "dist")
    if count == 1:
        return ranked(home.select("src", "dst", "dist"))
    home = cut(home)
    asked = home.where("probe").join(full, "cell").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("piece is null or piece <> to")
    asked = asked.select("cell", F.col("to").alias("piece"), "key", "x", "reach", F.lit(1).alias("role"))
    met = placed.select(*by, "key", "x", F.lit(0.0).alias("reach"), F.lit(0).alias("role")).unionByName(asked)
    far = met.repartition(parts, *by).sortWithinPartitions(*by, "role").mapInArrow(_other_cells(width, k, digits), "src BIGINT, dst BIGINT, dist DOUBLE")
    return ranked(home.where("not probe").select("src", "dst", "dist").unionByName(far))


def nearest(q: np.ndarray, qk: np.ndarray, base: np.ndarray, bk: np.ndarray, k: int, digits: int, reach: np.ndarray | None = None):
    """(query row, base row, distance) of the k nearest base rows of each query, itself excluded."""
    out = []
    step = max(1, PAIRS // max(1, len(base)))
    for s in range(0, len(q), step):
        d2 = np.zeros((len(q[s : s + step]), len(base)))
        for j in range(q.shape[1]):
            d2 += (q[s : s + step, j, None] - base[None, :, j]) ** 2
        d = np.sqrt(d2)
        d[qk[s : s + step, None] == bk[None]] = np.inf
        if reach is not None:
            d[d > reach[s : s + step, None] + 1e-8] = np.inf
        order = np.lexsort((np.broadcast_to(bk, d.shape), np.round(d, digits)), axis=1)[:, :k]
        near = np.take_along_axis(d, order, 1)
        i, c = np.nonzero(np.isfinite(near))
        out.append((s + i, order[i, c], near[i, c]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances to the pivots up to a constant of each row."""
    return (pivots * pivots).sum(1) - 2.0 * (x @ pivots.T)


def _placing(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy() for i in range(width)]).reshape(-1, width)
            step = max(1, PAIRS // len(pivots))
            cell = np.concatenate([_gaps(x[s : s + step], pivots).argmin(1) for s in range(0, len(x), step)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), packed(x)], names=["cell", "key", "x"])

    return run


def _own_cell(pivots: np.ndarray, width: int, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["cell", "piece"]):
            x, keys = matrix(t.column("x"), width), t.column("key").to_numpy()
            cell, piece, pieces = (t.column(c)[0].as_py() for c in ("cell", "piece", "pieces"))
            i, j, d = nearest(x, keys, x, keys, k, digits)
            m = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j]), pa.array(d), pa.array(np.zeros(m, bool)), *(pa.nulls(m, y) for y in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64()))], names=_NAMES)
            held = np.bincount(i, minlength=len(keys))
            reach = np.full(len(keys), np.inf)
            full = held >= k
            reach[full] = d[(np.cumsum(held) - 1)[full]]
            if len(pivots) > 1:
                apart = np.sqrt(((pivots - pivots[cell]) ** 2).sum(1))
                apart[cell] = np.inf
                step = max(1, PAIRS // len(pivots))
                for s in range(0, len(x), step):
                    g = _gaps(x[s : s + step], pivots)
                    if len(pivots) > k + 1:  # pivots are points themselves: the k + 1 nearest bound the k-th distance
                        d2 = np.partition(g, k, axis=1)[:, k] + (x[s : s + step] ** 2).sum(1)
                        reach[s : s + step] = np.minimum(reach[s : s + step], np.sqrt(np.maximum(d2, 0.0)) + 1e-7)
                    margin = (g - g[:, cell, None]) / (2.0 * apart)
                    near = margin <= reach[s : s + step, None] + 1e-8
                    near[:, cell] = False
                    q, to = np.nonzero(near)
                    if len(q):
                        yield _asking(to, None, keys[s + q], x[s + q], reach[s + q])
            if pieces > 1:
                yield _asking(np.full(len(keys), cell), piece, keys, x, reach)

    return run


def _asking(cells: np.ndarray, piece: int | None, keys: np.ndarray, x: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    m = len(keys)
    own = pa.nulls(m, pa.int32()) if piece is None else pa.array(np.full(m, piece, np.int32))
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(np.ones(m, bool)), pa.array(cells.astype(np.int32)), own, pa.array(keys), packed(x), pa.array(reach)], names=_NAMES)


def _other_cells(width: int, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["cell", "piece"]):
            x, keys, reach = matrix(t.column("x"), width), t.column("key").to_numpy(), t.column("reach").to_numpy()
            at = int(np.searchsorted(t.column("role").to_numpy(), 1))
            if 0 < at < len(keys):
                i, j, d = nearest(x[at:], keys[at:], x[:at], keys[:at], k, digits, reach[at:])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:][i]), pa.array(keys[:at][j]), pa.array(d)], names=["src", "dst", "dist"])

    return run
