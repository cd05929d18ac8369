"""Most similar vectors for every vector: adaptive dimension scan inside probed lists (problem 2).

Index: k-means lists over a bounded sample (``SAMPLE_PER_LIST`` vectors per list, those with the
smallest key hashes); every vector is put into the list of its nearest centroid. A list beyond
``CHUNK`` vectors is cut again by centroids of its own, its cells, so that the first codebook stays
small (``MAX_LISTS``) while cells keep their size. Scan: vectors are
rotated by a random orthogonal matrix and compared in column blocks; after each block a candidate
is abandoned if its partial distance proves it too far or if, by the hypothesis test on the scaled
partial distance (error factor ``EPSILON``), it is too far with near certainty. The first pass
scans a vector's own cell and gives its k-th distance; the second probes only the lists, and in
them the cells, that the ball of that radius can reach across the bisecting plane of two centroids. Survivors get their
exact distance from the unrotated values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscape.session import cut, parallelism

#: Vectors a list or cell should hold, centroids of a codebook at most, sampled vectors per centroid.
LIST_SIZE, MAX_LISTS, SAMPLE_PER_LIST = 512, 4096, 16
#: A list beyond this many vectors is cut into cells; a cell beyond it is scanned in several tasks.
CHUNK = 4096
#: Error factor of the hypothesis test; 2.1 loses about one neighbour in ten thousand.
EPSILON = 2.1
#: Query-candidate pairs held at once in a task.
BLOCK_PAIRS = 1 << 20


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def column_blocks(dim: int) -> list[tuple[int, int]]:
    """Column ranges of growing width: 4, 4, 8, 16, ..."""
    edges = [0]
    while edges[-1] < dim:
        edges.append(min(dim, max(4, edges[-1] * 2 if edges[-1] else 4)))
    return list(zip(edges, edges[1:]))


def thresholds(dim: int, epsilon: float = EPSILON) -> list[float]:
    """Per block: the share of the squared radius above which a partial distance is abandoned."""
    out = []
    for _, d in column_blocks(dim):
        tested = d / dim * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else 1.0
        out.append(min(1.0, tested) * (1 + 1e-9))
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def scan(queries: np.ndarray, qkeys: np.ndarray, radius2: np.ndarray, base: np.ndarray, bkeys: np.ndarray, k: int):
    """(query row, base row, squared distance) of the k nearest base rows within each radius.

    Order by (distance, key); a row is not its own neighbour. Works in blocks of bounded size.
    """
    dim = base.shape[1]
    rot = rotation(dim)
    rq, rb = queries @ rot, base @ rot
    blocks, limits = column_blocks(dim), thresholds(dim)
    step = max(1, BLOCK_PAIRS // max(1, len(base)))
    found = []
    for s in range(0, len(queries), step):
        q, b0 = rq[s : s + step], blocks[0]
        part = _squared(q[:, : b0[1]], rb[:, : b0[1]])
        part[qkeys[s : s + step, None] == bkeys[None]] = np.inf
        r2 = radius2[s : s + step].copy()
        if len(base) > k:
            # the exact distances of the k best first blocks bound the k-th neighbour's distance
            best = np.argpartition(part, k - 1, axis=1)[:, :k]
            exact = ((queries[s : s + step, None, :] - base[best]) ** 2).sum(2)
            exact[~np.isfinite(np.take_along_axis(part, best, 1))] = np.inf
            r2 = np.minimum(r2, exact.max(1))
        slack = 1e-9 * (1.0 + r2)
        i, j = np.nonzero((part <= (r2 * limits[0] + slack)[:, None]) & np.isfinite(part))
        p = part[i, j]
        for (lo, hi), lim in zip(blocks[1:], limits[1:]):
            p = p + ((q[i, lo:hi] - rb[j, lo:hi]) ** 2).sum(1)
            keep = p <= r2[i] * lim + slack[i]
            i, j, p = i[keep], j[keep], p[keep]
        d2 = ((queries[s + i] - base[j]) ** 2).sum(1)
        keep = d2 <= radius2[s + i]
        i, j, d2 = i[keep], j[keep], d2[keep]
        order = np.lexsort((bkeys[j], d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        found.append((s + i[top], j[top], d2[top]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([]))


def lloyd(sample: np.ndarray, lists: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """k-means centroids of a sample; an emptied list takes over a random sample vector."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centroid(sample, centroids)
        size = np.bincount(near, minlength=lists)
        for d in range(sample.shape[1]):
            centroids[:, d] = np.bincount(near, weights=sample[:, d], minlength=lists) / np.maximum(size, 1)
        lost = np.flatnonzero(size == 0)
        centroids[lost] = sample[rng.choice(len(sample), len(lost))]
    return centroids


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids * centroids).sum(1)
    step = max(1, (4 << 20) // len(centroids))
    return np.concatenate([np.argmax(x[s : s + step] @ centroids.T - half, axis=1) for s in range(0, len(x), step)] or [np.array([], np.int64)])


def complete(vector: Column, dim: int) -> Column:
    """The vector has ``dim`` finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, bad)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``by`` out of a sorted stream; only the current group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            tail = [last.column(last.schema.get_field_index(c))[-1].as_py() for c in by]
            change[0] = any(t != c[0] for t, c in zip(tail, cols))
        cuts = [*np.flatnonzero(change), b.num_rows]
        if cuts[0] > 0:
            held.append(b.slice(0, cuts[0]))
        for lo, hi in zip(cuts, cuts[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(lo, hi - lo)]
    if held:
        yield pa.Table.from_batches(held)


def meetings(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """(bases, queries) of every group of a stream sorted by group and ``role``.

    The bases (role 0) of a group are held, they are no more than a chunk; its queries (role 1), of which
    there may be any number, come a batch at a time.
    """
    group, bases = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in [*by, "role"]]
        values = [c.to_numpy(zero_copy_only=False) for c in cols]
        change = np.zeros(b.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change), b.num_rows] if b.num_rows else []
        for lo, hi in zip(cuts, cuts[1:]):
            *here, role = (v[lo] for v in values)
            if here != group:
                group, bases = here, []
            if role == 0:
                bases.append(b.slice(lo, hi - lo))
            elif bases:
                yield pa.Table.from_batches(bases), b.slice(lo, hi - lo)


def _level_lists(lists: int) -> list[int]:
    return [n for n in (4**e for e in range(8)) if n <= lists] or [1]


def nearest_vectors(rows: DataFrame, dim: int, k: int = 5, max_distance: float | None = None, list_size: int = LIST_SIZE) -> DataFrame:
    """The k nearest other vectors of every vector: (scope, key, neighbour, d2), at most k a key.

    ``rows``: scope STRING (only vectors of one scope are compared; never null), key BIGINT
    (unique in a scope), vec ARRAY<DOUBLE> of ``dim`` finite numbers. Ties in distance go to the
    smaller key. Beyond ``max_distance`` nothing is a neighbour. Of vectors equal in every number
    the k + 1 smallest keys take part in the search, and every further copy has the k smallest as
    its neighbours, so a copy that makes up a third of all rows meets no copy of itself. An empty
    table gives no rows; a vector alone in its scope has none.
    """
    spark = rows.sparkSession
    flat = F.transform("vec", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    rows = rows.select("scope", "key", flat.alias("vec"))
    rows = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vec")))
    place = F.row_number().over(Window.partitionBy("scope", "h1", "h2").orderBy("key"))
    ranked = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    index = build_index(cut(_packed(ranked, dim)), list_size)
    if index is None:
        return spark.createDataFrame([], "scope STRING, key BIGINT, neighbour BIGINT, d2 DOUBLE")
    limit2 = float("inf") if max_distance is None else float(max_distance) ** 2
    parts = 4 * parallelism(spark)

    home = cut(index.placed.repartition(parts, *CELL).sortWithinPartitions(*CELL).mapInArrow(_home_scan(k, limit2, index.books), _HOME))
    probes = index.targets(home.where("probe").select("scope", "list", "own_cell", "own_chunk", "key", "vec", "radius2"))
    bases = index.placed.select(*CELL, "key", "vec", F.lit(0.0).alias("radius2"), F.lit(0).alias("role"))
    met = bases.unionByName(probes.withColumn("role", F.lit(1))).repartition(parts, *CELL).sortWithinPartitions(*CELL, "role").mapInArrow(_probe_scan(k), _PAIRS)
    best = Window.partitionBy("scope", "key").orderBy("d2", "neighbour")
    near = home.where("not probe").select("scope", "key", "neighbour", "d2").unionByName(met)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    return near.unionByName(_further_copies(rows, k))


CELL = ["scope", "list", "cell", "chunk"]
_PAIRS = "scope STRING, key BIGINT, neighbour BIGINT, d2 DOUBLE"
_PROBE = "list INT, own_cell INT, own_chunk INT, vec BINARY, radius2 DOUBLE"
_HOME = _PAIRS + ", probe BOOLEAN, " + _PROBE


@dataclass(frozen=True)
class Index:
    """Vectors in lists, cells and chunks.

    ``placed``: scope, key, vec, level, list, cell, chunk, chunks, and ``alone``, whether the list has
    no other chunk; ``books``: centroids of the lists
    by level; ``cells``: (scope, list, book, slices), the centroids of the cells of every list that
    is cut, or None; ``crowded``: (scope, list, cell, chunks) of the cells that have several chunks.
    """

    placed: DataFrame
    books: dict[int, np.ndarray]
    cells: DataFrame | None
    crowded: DataFrame

    def targets(self, probes: DataFrame) -> DataFrame:
        """Probes of lists (scope, list, own_cell, own_chunk, key, vec, radius2) as probes of chunks.

        A vector that comes from the list itself has its own cell and chunk, which is left out.
        """
        whole = probes.withColumn("cell", F.lit(0))
        if self.cells is not None:
            lists = self.cells.select("scope", "list")
            inside = _with_books(probes.join(F.broadcast(lists), ["scope", "list"], "left_semi"), self.cells, _cell_probes, f"scope STRING, key BIGINT, {_PROBE}, cell INT")
            whole = whole.join(F.broadcast(lists), ["scope", "list"], "left_anti").unionByName(inside)
        met = whole.join(self.crowded, ["scope", "list", "cell"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        other = F.col("own_cell").isNull() | (F.col("own_cell") != F.col("cell")) | (F.col("own_chunk") != F.col("chunk"))
        return met.where(other).select(*CELL, "key", "vec", "radius2")


def build_index(kept: DataFrame, list_size: int = LIST_SIZE) -> Index | None:
    """The index of packed vectors (scope, key, vec); None if there are none."""
    sizes = kept.groupBy("scope").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    if not largest:
        return None
    books = _codebooks(kept, int(min(MAX_LISTS, max(1, largest // list_size))))
    listed = cut(_assign(kept, sizes, books, list_size))
    full = listed.groupBy("scope", "list").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    cells = cut(_cell_books(listed, full, list_size))
    if cells.isEmpty():
        cells, celled = None, listed.withColumn("cell", F.lit(0))
    else:
        lists = F.broadcast(cells.select("scope", "list"))  # lists beyond CHUNK vectors, at most MAX_LISTS a scope
        schema = "scope STRING, key BIGINT, vec BINARY, level INT, list INT, cell INT"
        celled = _with_books(listed.join(lists, ["scope", "list"], "left_semi"), cells, _nearest_cell, schema)
        celled = cut(celled.unionByName(listed.join(lists, ["scope", "list"], "left_anti").withColumn("cell", F.lit(0))))
    crowded = celled.groupBy("scope", "list", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    crowded = crowded.select("scope", "list", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    placed = celled.join(crowded, ["scope", "list", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    alone = F.col("chunks") == 1
    if cells is not None:
        placed = placed.join(lists.withColumn("is_cut", F.lit(True)), ["scope", "list"], "left")
        alone = alone & F.col("is_cut").isNull()
    return Index(placed.withColumn("alone", alone).drop("is_cut"), books, cells, crowded)


def _cell_books(listed: DataFrame, full: DataFrame, list_size: int) -> DataFrame:
    """(scope, list, book, slices): centroids of the cells of every list in ``full``, from a sample of the list."""
    wanted = F.least(F.lit(MAX_LISTS), F.greatest(F.lit(2), F.floor(F.col("n") / list_size))).cast("int")
    want = full.select("scope", "list", "n", wanted.alias("want"), F.ceil(F.col("n") / (16 * CHUNK)).cast("int").alias("slices"))
    share = SAMPLE_PER_LIST * F.col("want") / F.col("n")
    picked = listed.select("scope", "list", "key", "vec").join(F.broadcast(want), ["scope", "list"]).where(F.pmod(F.xxhash64("key", "scope"), F.lit(1 << 30)) < share * (1 << 30))
    samples = picked.groupBy("scope", "list", "want", "slices").agg(F.sort_array(F.collect_list("vec")).alias("vecs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books = [lloyd(np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1), n).tobytes() for n, v in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(books, pa.binary()), b.column(3)], names=["scope", "list", "book", "slices"])

    return samples.mapInArrow(run, "scope STRING, list INT, book BINARY, slices INT")


def _with_books(rows: DataFrame, cells: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` over the rows of every list together with the centroids of its cells.

    The rows of a list are cut into slices, each of which begins with the list's book.
    """
    sliced = rows.join(F.broadcast(cells.select("scope", "list", "slices")), ["scope", "list"])
    sliced = sliced.withColumn("_slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).drop("slices").withColumn("_role", F.lit(1))
    heads = cells.select("scope", "list", F.col("book").alias("vec"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("_slice"), F.lit(0).alias("_role"))
    by = ["scope", "list", "_slice"]
    met = sliced.unionByName(heads, True).repartition(*by).sortWithinPartitions(*by, "_role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, by):
            vecs = t.column("vec")
            if t.num_rows > 1:
                rows = t.slice(1)
                x = _matrix(rows.column("vec"))
                yield from kernel(rows, x, np.frombuffer(vecs[0].as_py(), np.float64).reshape(-1, x.shape[1]))

    return met.mapInArrow(run, schema)


def _nearest_cell(rows: pa.Table, x: np.ndarray, book: np.ndarray) -> Iterator[pa.RecordBatch]:
    cell = pa.array(nearest_centroid(x, book).astype(np.int32))
    yield from rows.select(["scope", "key", "vec", "level", "list"]).append_column("cell", cell).to_batches()


def _cell_probes(rows: pa.Table, x: np.ndarray, book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for every cell that the radius reaches from the nearest cell, that one included."""
    radius = np.sqrt(rows.column("radius2").to_numpy())
    step = max(1, (4 << 20) // len(book))
    for s in range(0, len(x), step):
        q, to = np.nonzero(reached(x[s : s + step], radius[s : s + step], book))
        part = rows.slice(s, step).take(pa.array(q)).select(["scope", "key", "list", "own_cell", "own_chunk", "vec", "radius2"])
        yield from part.append_column("cell", pa.array(to.astype(np.int32))).combine_chunks().to_batches()


def reached(x: np.ndarray, radius: np.ndarray, book: np.ndarray, own: int | None = None) -> np.ndarray:
    """(vectors, centroids): whether the ball of a vector reaches a centroid's side of the bisecting plane.

    Planes lie between that centroid and the vector's own, or its nearest one, which counts as reached.
    """
    half = (book * book).sum(1)
    rel = half - 2.0 * (x @ book.T)
    near = np.full(len(x), own) if own is not None else rel.argmin(1)
    apart = np.sqrt(np.maximum(0.0, half[near][:, None] + half[None] - 2.0 * (book[near] @ book.T)))
    apart[apart == 0] = np.inf
    margin = (rel - np.take_along_axis(rel, near[:, None], 1)) / (2.0 * apart)
    hit = margin <= radius[:, None] + 1e-9
    hit[np.arange(len(x)), near] = True
    return hit


def _further_copies(rows: DataFrame, k: int) -> DataFrame:
    """Copies beyond the first k + 1 of a vector, each with the k smallest keys at distance 0."""
    by = ["scope", "h1", "h2"]
    many = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select(*by)
    copies = rows.select(*by, "key").join(many, by, "left_semi")
    low = copies.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("place") <= k + 1)
    heads = low.groupBy(*by).agg(F.sort_array(F.collect_list("key")).alias("ks"))
    late = copies.join(heads, by).where(F.col("key") > F.element_at("ks", k + 1))
    return late.select("scope", "key", F.explode(F.slice("ks", 1, k)).alias("neighbour"), F.lit(0.0).alias("d2"))


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in flat], pa.binary())], names=["scope", "key", "vec"])

    return rows.select("scope", "key", "vec").mapInArrow(run, "scope STRING, key BIGINT, vec BINARY")


def _codebooks(kept: DataFrame, lists: int) -> dict[int, np.ndarray]:
    """Centroids for 1, 4, 16, ... and ``lists`` lists, from a bounded sample of all scopes."""
    levels = sorted({*_level_lists(lists), lists})
    if lists == 1:
        return {1: np.zeros((1, 1))}
    take = SAMPLE_PER_LIST * lists
    picked = kept.select("vec", F.xxhash64("key", "scope").alias("h")).orderBy("h").limit(take).collect()
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in picked), np.float64).reshape(len(picked), -1)
    return {n: lloyd(sample, n) if n > 1 else sample.mean(0, keepdims=True) for n in levels}


def _assign(kept: DataFrame, sizes: DataFrame, books: dict[int, np.ndarray], list_size: int) -> DataFrame:
    """(scope, level, list, key, vec): the codebook that fits the scope's size and the nearest list."""
    levels = sorted(books)
    level = F.lit(levels[0])
    for n in levels[1:]:
        level = F.when(F.col("n") >= n * list_size, F.lit(n)).otherwise(level)
    rows = kept.join(sizes.select("scope", level.alias("level")), "scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level, near = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int32)
            if level.max(initial=1) > 1:
                x = _matrix(b.column(2))
                for n in np.unique(level):
                    if n > 1:
                        near[level == n] = nearest_centroid(x[level == n], books[n])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(near)], names=["scope", "key", "vec", "level", "list"])

    return rows.select("scope", "key", "vec", "level").mapInArrow(run, "scope STRING, key BIGINT, vec BINARY, level INT, list INT")


def _home_scan(k: int, limit2: float, books: dict[int, np.ndarray]) -> Callable:
    """Own cell: pairs, and the probes of other lists (of the own one if it has more) that the radius reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, CELL):
            x, keys = _matrix(t.column("vec")), t.column("key").to_numpy()
            scope = t.column("scope")[0].as_py()
            n = len(keys)
            i, j, d2 = scan(x, keys, np.full(n, limit2), x, keys, k)
            count = np.bincount(i, minlength=n)
            radius2 = np.full(n, limit2)
            last = np.cumsum(count) - 1
            full = count >= k
            radius2[full] = np.minimum(limit2, d2[last[full]])
            nothing = [pa.nulls(len(i), f) for f in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([scope] * len(i), pa.string()), pa.array(keys[i], pa.int64()), pa.array(keys[j], pa.int64()), pa.array(d2, pa.float64()), pa.array(np.zeros(len(i), bool)), *nothing], names=_NAMES)
            for b in list_probes(t, x, keys, radius2, books):
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(np.ones(m, bool)), *b.columns[2:]], names=_NAMES)

    return run


def list_probes(t: pa.Table, x: np.ndarray, keys: np.ndarray, radius2: np.ndarray, books: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(scope, key, list, own_cell, own_chunk, vec, radius2): lists that the vectors of a chunk reach.

    The own list, with the own cell and chunk, is among them unless it has no other chunk.
    """
    scope, own, cell, chunk = (t.column(c)[0].as_py() for c in CELL)
    level = t.column("level")[0].as_py()
    book = books[level] if level > 1 else np.zeros((1, x.shape[1]))  # one list: number 0
    step = max(1, (4 << 20) // len(book))
    for s in range(0, len(keys), step):
        q, to = np.nonzero(reached(x[s : s + step], np.sqrt(radius2[s : s + step]), book, own))
        if t.column("alone")[0].as_py():
            q, to = q[to != own], to[to != own]
        n, mine = len(q), to == own
        home = [pa.array(np.full(n, v, np.int32), mask=~mine) for v in (cell, chunk)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([scope] * n, pa.string()), pa.array(keys[s + q], pa.int64()), pa.array(to.astype(np.int32)), *home, pa.array([v.tobytes() for v in x[s + q]], pa.binary()), pa.array(radius2[s + q], pa.float64())],
            names=["scope", "key", "list", "own_cell", "own_chunk", "vec", "radius2"],
        )


_NAMES = ["scope", "key", "neighbour", "d2", "probe", "list", "own_cell", "own_chunk", "vec", "radius2"]


def _probe_scan(k: int) -> Callable:
    """Vectors of a chunk against the vectors of other chunks that probe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, q in meetings(batches, CELL):
            x, keys, qkeys = _matrix(t.column("vec")), t.column("key").to_numpy(), q.column("key").to_numpy()
            i, j, d2 = scan(_matrix(q.column("vec")), qkeys, q.column("radius2").to_numpy(), x, keys, k)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([t.column("scope")[0].as_py()] * len(i), pa.string()), pa.array(qkeys[i]), pa.array(keys[j]), pa.array(d2)], names=["scope", "key", "neighbour", "d2"])

    return run


def similar_pairs(near: DataFrame) -> DataFrame:
    """Distinct pairs, smaller key first, of which at least one is a neighbour of the other."""
    return near.select("scope", F.least("key", "neighbour").alias("left_no"), F.greatest("key", "neighbour").alias("right_no")).distinct()
