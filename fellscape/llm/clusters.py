"""Groups of mutually similar records (problem 3).

A vector becomes a set of ``TOKENS`` tokens (j, floor((a_j x + b_j) / width)): the Jaccard
similarity of two sets falls with the distance of the vectors. MinHash banding over the sets gives
candidate pairs; exact Jaccard and exact distance verify them; connected components form groups.
Records of one k-means list (centroids of a bounded sample, as in ``vectors``) come to one task,
which links what the first bands bring together. Then all bands are looked at in rounds. A round
shuffles one summary for each component in a bucket: the corners of its records' sketches, which
bound distances from below. Only where summaries of two components come within the limit are the
records fetched and verified. Shuffle files of a round are deleted before the next. Inside a
bucket no pair list is built: pivots link what they reach, and only records near the border of a
pivot are compared further, which finds the same components. A bucket beyond ``BUCKET`` records is
cut into chunks and every pair of chunks is checked, so no bucket is skipped or capped. Degrees count all members within
the limit, found through the lists and cells of ``vectors.build_index``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.llm.components import boruvka_components
from fellscape.llm.vectors import CELL, MAX_LISTS, SAMPLE_PER_LIST, Index, _groups, _matrix, _packed, build_index, list_probes, lloyd, meetings, nearest_centroid
from fellscape.session import cut, parallelism, release

TOKENS, WIDTH = 64, 4.0  # tokens a record; width of a token's cell in units of the distance limit
BANDS, ROWS = 96, 5
#: Bands whose links are contracted before the other bands are looked at.
FIRST_BANDS = 4
#: Records a task links at once, and those a list of the first placing should hold.
PIECE, LIST = 8192, 4096
#: Projections that bound distances from below, and their steps a limit.
SKETCH, STEPS = 6, 8
#: Bytes that a round of bands may shuffle at least (else as many as the vectors take), and those of a part of it.
ROUND, PART = 256 << 20, 8 << 20
#: Least Jaccard similarity of a link; two records at the limit share 0.67 in expectation.
JACCARD = 0.4
BUCKET = 8192
#: Pairs a task compares at once.
BLOCK = 1 << 22


def token_cells(x: np.ndarray, limit: float, seed: int = 3) -> np.ndarray:
    """(records, TOKENS) cell numbers; token j of a record is the pair (j, cell)."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(x.shape[1], TOKENS)), rng.uniform(size=TOKENS)
    return np.floor(x @ a / (WIDTH * limit) + b).astype(np.int64)


def min_hash_bands(cells: np.ndarray, seed: int = 9, bands: range = range(BANDS)) -> np.ndarray:
    """(records, bands) bucket numbers of the token sets.

    A hash is computed once for each distinct token; records only compare its ranks.
    """
    seeds = np.random.default_rng(seed).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)[bands.start * ROWS : bands.stop * ROWS]
    one, two, far = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
    out = np.zeros((len(cells), len(bands)), np.uint64)
    if not len(cells):
        return out.view(np.int64)
    with np.errstate(over="ignore"):
        low, high = cells.min(0), cells.max(0)
        if (high.astype(float) - low).sum() < 1 << 14:  # all numbers between the ends
            width = high - low + 1
            first = np.cumsum(width) - width
            at, token = cells - low + first, np.repeat(np.arange(TOKENS), width)
            known = (np.arange(width.sum()) - first[token] + low[token]).astype(np.uint64) * np.uint64(TOKENS) + token.astype(np.uint64)
        else:
            tokens = cells.astype(np.uint64) * np.uint64(TOKENS) + np.arange(TOKENS, dtype=np.uint64)
            known, at = np.unique(tokens, return_inverse=True)
            at = at.reshape(tokens.shape)
        step = max(1, BLOCK // (4 * len(known) + 1)) // ROWS * ROWS or ROWS
        for lo in range(0, len(seeds), step):
            h = (known[:, None] ^ seeds[None, lo : lo + step]) * one
            h ^= h >> far
            h *= two
            h ^= h >> far
            h *= one
            order = np.argsort(h, axis=0)
            ranks = np.empty(h.shape, np.uint16 if len(known) < 1 << 16 else np.uint32)
            np.put_along_axis(ranks, order, np.arange(len(known), dtype=ranks.dtype)[:, None], 0)
            h = np.take_along_axis(h, order, 0)
            for s in range(0, len(cells), 1024):
                least = ranks[at[s : s + 1024, 0]]
                for j in range(1, TOKENS):
                    np.minimum(least, ranks[at[s : s + 1024, j]], out=least)
                least = h[least, np.arange(h.shape[1])].reshape(len(least), -1, ROWS)
                part = out[s : s + 1024, lo // ROWS : (lo + h.shape[1]) // ROWS]
                for r in range(ROWS):
                    part[:] = (part ^ least[:, :, r]) * two
                    part ^= part >> far
        out += np.arange(bands.start, bands.stop, dtype=np.uint64)
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of token sets, row by row."""
    same = (a == b).sum(-1)
    return same / (2.0 * a.shape[-1] - same)


def reach(x: np.ndarray, limit: float, cells: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of records within ``limit`` (and Jaccard ``least``): labels and linking edges.

    Breadth first over pivots: what a pivot reaches is linked to it; a reached record can only
    reach further what lies within twice the limit of the pivot, so only that border is compared.
    """
    n, near2, wide2 = len(x), limit * limit * (1 + 1e-12), 4 * limit * limit
    label, a, b = np.full(n, -1), [], []
    left, current = np.arange(n), -1
    ok = lambda i, j: np.ones(np.broadcast(i, j).shape, bool) if cells is None else jaccard(cells[i], cells[j]) >= least
    while len(left):
        p, left, current = left[0], left[1:], current + 1
        label[p] = current
        pivots = [p]
        while pivots and len(left):
            p = pivots.pop()
            d2 = ((x[left] - x[p]) ** 2).sum(1)
            hit = d2 <= near2
            hit[hit] = ok(left[hit], p)
            new, border = left[hit], left[~hit & (d2 <= wide2)]
            left = left[~hit]
            label[new] = current
            a += [p] * len(new)
            b += new.tolist()
            for s in range(0, len(new), 256):
                if not len(border):
                    break
                part = new[s : s + 256]
                d = (x[part] ** 2).sum(1)[:, None] + (x[border] ** 2).sum(1)[None] - 2 * x[part] @ x[border].T
                i, j = np.nonzero(d <= near2 + 1e-6)
                exact = ((x[part[i]] - x[border[j]]) ** 2).sum(1) <= near2
                i, j = i[exact], j[exact]
                good = ok(part[i], border[j])
                i, j = i[good], j[good]
                j, at = np.unique(j, return_index=True)
                found = border[j]
                label[found] = current
                a += part[i[at]].tolist()
                b += found.tolist()
                pivots += found.tolist()
                border = np.delete(border, j)
                left = left[label[left] < 0]
    return label, np.array(a, np.int64), np.array(b, np.int64)


def _pack(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    return [h.tobytes() if e else d.tobytes() for h, d, e in zip(half, x, (half == x).all(1))]


def _unpack(rows: list[bytes], dim: int) -> np.ndarray:
    out, short = np.empty((len(rows), dim)), np.array([len(r) == 4 * dim for r in rows], bool)
    for kind, these in ((np.float32, short), (np.float64, ~short)):
        out[these] = np.frombuffer(b"".join(r for r, s in zip(rows, these) if s), kind).reshape(-1, dim)
    return out


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its component) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def link_piece(x: np.ndarray, limit: float) -> np.ndarray:
    """Components of the records of a task by what the first bands bring together; labels as of ``_merged``."""
    cells, label = token_cells(x, limit), np.arange(len(x))
    for bucket in min_hash_bands(cells, bands=range(FIRST_BANDS)).T:
        order = np.lexsort((label, bucket))
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        ends = np.r_[starts[1:], len(x)]
        mixed = label[order[starts]] != label[order[ends - 1]]
        found = []
        for s, e in zip(starts[mixed], ends[mixed]):
            rows = order[s:e]
            _, a, b = reach(x[rows], limit, cells[rows], JACCARD)
            found.append((rows[a], rows[b]))
        if found:
            label = _merged(label, *(np.concatenate(c) for c in zip(*found)))
    return label


def _pieces(vecs: DataFrame, dim: int, limit: float) -> DataFrame:
    """(piece, keys, comps, vecs): records in pieces of at most ``PIECE``, sorted by component.

    Records of one k-means list come to one task, so that most groups lie in one piece and are
    linked there; where a group is cut, the buckets of ``_requests`` bring its parts together.
    """
    spark, piece = vecs.sparkSession, PIECE
    lists = min(MAX_LISTS, vecs.count() // LIST)
    picked = vecs.orderBy(F.xxhash64("key")).limit(SAMPLE_PER_LIST * lists).select("vec").collect() if lists > 1 else []
    book = lloyd(_unpack([bytes(r[0]) for r in picked], dim), lists) if picked else np.zeros((1, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest_centroid(_unpack(b.column(1).to_pylist(), dim), book)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), b.column(1)], names=["list", "key", "vec"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def linked():
            t = pa.Table.from_batches(held)
            keys = t.column("key").to_numpy()
            order = np.argsort(keys)
            keys, rows = keys[order], t.column("vec").to_pylist()
            rows = [rows[i] for i in order]
            comps = keys[link_piece(_unpack(rows, dim), limit)]
            order = np.argsort(comps, kind="stable")
            return _piece_rows([(int(keys[0]), keys[order], comps[order], [rows[i] for i in order])])

        for b in batches:
            at = b.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.diff(at)) + 1, b.num_rows] if b.num_rows else []
            lo = 0
            for hi in cuts:
                new = not held or held[-1].column(0)[-1].as_py() != at[lo]
                if new and n >= piece // 2:
                    yield linked()
                    held, n = [], 0
                while lo < hi:
                    take = min(hi - lo, piece - n)
                    held.append(b.slice(lo, take))
                    lo, n = lo + take, n + take
                    if n == piece:
                        yield linked()
                        held, n = [], 0
        if held:
            yield linked()

    placed = vecs.select("key", "vec").mapInArrow(place, "list INT, key BIGINT, vec BINARY")
    return cut(placed.repartition(parallelism(spark), "list").sortWithinPartitions("list").mapInArrow(link, _PIECE), free=True)


_PIECE = "piece BIGINT, keys BINARY, comps BINARY, sizes BINARY, vecs BINARY"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of pieces; ``sizes`` are the bytes of each vector."""
    cols = [(p, k.tobytes(), c.tobytes(), np.array([len(r) for r in v], np.int32).tobytes(), b"".join(v)) for p, k, c, v in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cols), [pa.int64(), *[pa.binary()] * 4])], names=["piece", "keys", "comps", "sizes", "vecs"])


def _read_pieces(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(piece, keys, comps, vectors) of every row."""
    for k in range(b.num_rows):
        piece, keys, comps, sizes, vecs = (b.column(c)[k].as_py() for c in range(5))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        yield piece, np.frombuffer(keys, np.int64), np.frombuffer(comps, np.int64), [vecs[s:e] for s, e in zip([0, *ends], ends)]


#: What a piece says of one component in one bucket: how many of its records, between which corners of their sketches.
_SUMMARY = np.dtype([("bucket", "<i8"), ("comp", "<i8"), ("piece", "<i8"), ("n", "<i4"), ("lo", "<i2", SKETCH), ("hi", "<i2", SKETCH)])
_REQUEST = np.dtype([("bucket", "<i8"), ("comp", "<i8"), ("chunks", "<i4")])


def _sketch(x: np.ndarray, limit: float) -> np.ndarray:
    """Orthonormal projections, rounded down to ``STEPS`` a limit; clipped, which brings none farther apart."""
    side = np.linalg.qr(np.random.default_rng(1).normal(size=(x.shape[1], min(SKETCH, x.shape[1]))))[0]
    out = np.zeros((len(x), SKETCH), np.int16)
    out[:, : side.shape[1]] = np.clip(np.floor(x @ side * (STEPS / limit)), -32768, 32767)
    return out


def _summaries(pieces: DataFrame, dim: int, limit: float, bands: range, parts: int) -> DataFrame:
    """(part, blob): the ``_SUMMARY`` of every component in every bucket of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, _, comps, rows in _read_pieces(b):
                x = _unpack(rows, dim)
                sketch, out = _sketch(x, limit), []
                for bucket in min_hash_bands(token_cells(x, limit), bands=bands).T:
                    order = np.argsort(bucket, kind="stable")  # the components are sorted
                    at, comp = bucket[order], comps[order]
                    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (comp[1:] != comp[:-1])])
                    one = np.zeros(len(starts), _SUMMARY)
                    one["bucket"], one["comp"], one["piece"], one["n"] = at[starts], comp[starts], piece, np.diff(np.r_[starts, len(at)])
                    one["lo"], one["hi"] = np.minimum.reduceat(sketch[order], starts), np.maximum.reduceat(sketch[order], starts)
                    out.append(one)
                all_ = np.concatenate(out)
                to = (all_["bucket"].view(np.uint64) % np.uint64(parts)).astype(np.int64)
                all_ = all_[np.argsort(to, kind="stable")]
                ends = np.cumsum(np.bincount(to, minlength=parts))
                some = np.flatnonzero(np.diff(np.r_[0, ends]))
                blobs = [all_[(ends[p - 1] if p else 0) : ends[p]].tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return pieces.mapInArrow(run, "part INT, blob BINARY")


def near_summaries(all_: np.ndarray) -> np.ndarray:
    """Which summaries, sorted by bucket and lo[0], a summary of another component in the bucket may have records within the limit of."""
    n = len(all_)
    near, bucket, comp = np.zeros(n, bool), all_["bucket"], all_["comp"]
    lo, hi = all_["lo"].astype(np.int32), all_["hi"].astype(np.int32)
    i, step = np.arange(n - 1), 1
    while len(i):
        j = i + step
        same = (bucket[i] == bucket[j]) & (lo[j, 0] - hi[i, 0] <= STEPS + 1)
        i, j = i[same], j[same]
        other = comp[i] != comp[j]
        for s in range(0, len(i), BLOCK >> 2):
            k = slice(s, s + (BLOCK >> 2))
            p, q = i[k][other[k]], j[k][other[k]]
            gap = np.maximum(np.maximum(lo[q] - hi[p], lo[p] - hi[q]) - 1, 0)
            hit = (gap.astype(np.int64) ** 2).sum(1) <= STEPS * STEPS
            near[p[hit]] = near[q[hit]] = True
        step += 1
        i = i[i + step < n]
    return near


def _requests(pieces: DataFrame, dim: int, limit: float, bands: range, parts: int) -> DataFrame:
    """(piece, blob): the ``_REQUEST`` of every component that may have records near those of another in a bucket."""
    bucket_rows = BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["part"]):
            all_ = np.frombuffer(b"".join(t.column("blob").to_pylist()), _SUMMARY)
            bucket = all_["bucket"]
            order = np.argsort(bucket, kind="stable")
            again = bucket[order][1:] == bucket[order][:-1]
            all_ = all_[order[np.r_[again, False] | np.r_[False, again]]]  # buckets of several summaries
            all_ = all_[np.lexsort((all_["lo"][:, 0], all_["bucket"]))]
            all_ = all_[near_summaries(all_)] if len(all_) else all_
            if not len(all_):
                continue
            starts = np.flatnonzero(np.r_[True, np.diff(all_["bucket"]) != 0])
            many = np.add.reduceat(all_["n"].astype(np.int64), starts)
            out = np.zeros(len(all_), _REQUEST)
            out["bucket"], out["comp"] = all_["bucket"], all_["comp"]
            out["chunks"] = np.repeat(-(-many // bucket_rows), np.diff(np.r_[starts, len(all_)]))
            order = np.argsort(all_["piece"], kind="stable")
            names, at = np.unique(all_["piece"][order], return_index=True)
            blobs = [out[order[s:e]].tobytes() for s, e in zip(at, [*at[1:], len(out)])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["piece", "blob"])

    rows = _summaries(pieces, dim, limit, bands, parts).repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "piece BIGINT, blob BINARY")


def _links(pieces: DataFrame, requests: DataFrame, dim: int, limit: float, bands: range) -> DataFrame:
    """(a, b): components that a verified link of two records in a bucket joins.

    A bucket beyond ``BUCKET`` records comes as all pairs of its chunks.
    """
    by = ["bucket", "i", "j"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (_, keys, comps, rows) in enumerate(_read_pieces(b)):
                asked = np.frombuffer(b"".join(b.column(5)[k].as_py()), _REQUEST)
                x = _unpack(rows, dim)
                for bucket in min_hash_bands(token_cells(x, limit), bands=bands).T:
                    mine = asked[np.isin(asked["bucket"], bucket)]
                    if not len(mine):
                        continue
                    # (bucket, component) of the records among those asked for
                    near = np.flatnonzero(np.isin(bucket, mine["bucket"]))
                    pair = np.concatenate([np.stack([mine["bucket"], mine["comp"]], 1), np.stack([bucket[near], comps[near]], 1)])
                    _, code = np.unique(pair, axis=0, return_inverse=True)
                    code = code.ravel()
                    at = np.full(code.max() + 1, -1)
                    at[code[: len(mine)]] = np.arange(len(mine))
                    at = at[code[len(mine) :]]
                    near, at = near[at >= 0], at[at >= 0]
                    chunks = mine["chunks"][at].astype(np.int64)
                    own = (keys[near].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(chunks, 1)
                    again = np.repeat(np.arange(len(near)), chunks)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                    for s in range(0, len(again), BUCKET):
                        g = again[s : s + BUCKET]
                        o, w = other[s : s + BUCKET], own[g]
                        cols = [bucket[near[g]], np.minimum(o, w), np.maximum(o, w), comps[near[g]]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([rows[r] for r in near[g]], pa.binary())], names=[*by, "comp", "vec"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, by):
            comp = t.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            x = _unpack(t.column("vec").to_pylist(), dim)
            _, a, b = reach(x, limit, token_cells(x, limit), JACCARD)
            pair = np.unique(np.sort(np.stack([comp[a], comp[b]], 1)[comp[a] != comp[b]], axis=1), axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    asked = requests.groupBy("piece").agg(F.collect_list("blob").alias("asked"))
    found = pieces.join(asked, "piece").select("piece", "keys", "comps", "sizes", "vecs", "asked").mapInArrow(fetch, "bucket BIGINT, i BIGINT, j BIGINT, comp BIGINT, vec BINARY")
    parts = 2 * parallelism(pieces.sparkSession)
    return found.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(verify, "a BIGINT, b BIGINT").distinct()


def _renamed(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """The pieces with the components that the links leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (piece, keys, comps, rows) in enumerate(_read_pieces(b)):
                told = b.column(5)[k].as_py()
                if told:
                    names, at = np.unique(comps, return_inverse=True)
                    old, new = (np.array([x[c] for x in told]) for c in ("node", "component"))
                    names = names.copy()
                    names[np.searchsorted(names, old)] = new
                    comps = names[at]
                order = np.argsort(comps, kind="stable")
                yield _piece_rows([(piece, keys[order], comps[order], [rows[i] for i in order])])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, _, comps, _ in _read_pieces(b):
                names = np.unique(comps)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), piece)), pa.array(names)], names=["piece", "node"])

    top = boruvka_components(links, "a", "b").where("node <> component")
    told = pieces.mapInArrow(homes, "piece BIGINT, node BIGINT").join(top, "node").groupBy("piece").agg(F.collect_list(F.struct("node", "component")).alias("told"))
    return cut(pieces.join(told, "piece", "left").select("piece", "keys", "comps", "sizes", "vecs", "told").mapInArrow(run, _PIECE), free=True)


def _members(pieces: DataFrame) -> DataFrame:
    """(key, component) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, keys, comps, _ in _read_pieces(b):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(comps)], names=["key", "component"])

    return pieces.mapInArrow(run, "key BIGINT, component BIGINT")


def similarity_groups(rows: DataFrame, dim: int, limit: float, keep_vectors: bool = False) -> DataFrame:
    """(key, group): groups of records chained by steps of at most ``limit``; group is the smallest key.

    ``rows``: key BIGINT (unique), vec ARRAY<DOUBLE> of ``dim`` finite numbers. Records without a
    similar one are their own group. An empty table gives no rows. All bands are looked at, in rounds
    that shuffle about as much as the vectors take, so the disk needed does not grow with the bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_pack(flat), pa.binary())], names=["key", "vec"])

    pieces = _pieces(cut(rows.select("key", "vec").mapInArrow(run, "key BIGINT, vec BINARY"), free=True), dim, limit)
    release(pieces.sparkSession)
    size = pieces.agg(F.sum(F.length("vecs"))).first()[0] or 0
    seen, links, at, step = 0, None, 0, FIRST_BANDS
    while at < BANDS:
        bands = range(at, min(BANDS, at + step))
        parts = max(2 * parallelism(rows.sparkSession), seen * len(bands) // PART)
        requests = cut(_requests(pieces, dim, limit, bands, parts), free=True)
        if not requests.isEmpty():
            new = cut(_links(pieces, requests, dim, limit, bands), free=True)
            if at == 0:
                pieces = _renamed(pieces, new)
                release(pieces.sparkSession)
            else:
                links = new if links is None else links.unionByName(new)
        if at == 0:  # bytes of a band, from the components there are now
            some = _summaries(pieces, dim, limit, bands, 1).agg(F.sum(F.length("blob"))).first()[0]
            seen = max(1, (some or 0) // len(bands))
        at = bands.stop
        step = max(1, int(max(ROUND, size) // seen))
    found = _members(pieces)
    if links is None:
        return found.select("key", F.col("component").alias("group"))
    top = cut(boruvka_components(links, "a", "b")).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return found.join(top, "component", "left").select("key", F.coalesce("top", "component").alias("group"))


def describe_groups(groups: DataFrame, rows: DataFrame, dim: int, limit: float, loose: float = 0.5, typical: int = 3) -> DataFrame:
    """(group, cluster, size, typical): clusters with their size and most typical members.

    The degree of a member is the number of the group's members within ``limit``, itself included;
    copies count each. The medoid has the highest degree, of equal ones the smaller key. A group
    whose medoid reaches less than the share ``loose`` of it is split: in rounds, every member
    that no unassigned member within the limit exceeds in (degree, smaller key) becomes a medoid, and
    the unassigned members within its limit join the highest of the medoids they reach, until all are
    assigned; so every cluster of a split group lies within the limit of its medoid. ``typical``
    are the keys of the highest degrees within the cluster, ``cluster`` is its smallest key. An
    empty table gives no rows.
    """
    vec = F.transform("vec", lambda x: x + F.lit(0.0))
    named = rows.select("key", vec.alias("vec")).join(groups.select("key", "group"), "key")
    named = named.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vec")))
    by = ["group", "h1", "h2"]
    first = named.groupBy(*by).agg(F.min("key").alias("rep"), F.count("*").cast("double").alias("weight"))
    member = cut(named.select("key", *by).join(first, by).select("key", "group", "rep", "weight"))
    reps = cut(member.where("key = rep").select("key", "group", "weight"))
    packed = cut(_packed(named.join(reps.select("key"), "key", "left_semi").select(F.lit("").alias("scope"), "key", "vec"), dim))
    degrees = _degrees(build_index(packed), reps.select("key", F.col("group").alias("part"), "weight"), limit)
    judged = cut(reps.join(degrees, "key"))
    top = F.max(F.struct("degree", (-F.col("key")).alias("k")))
    medoids = judged.groupBy("group").agg(top.alias("m"), F.sum("weight").alias("size")).select("group", (-F.col("m.k")).alias("center"), (F.col("m.degree") < loose * F.col("size")).alias("is_loose"))
    judged = cut(judged.join(medoids, "group"))
    done = judged.where("not is_loose").select("key", "group", "center", "degree")
    split = judged.where("is_loose")
    if not split.isEmpty():
        index = build_index(cut(packed.join(split.select("key"), "key", "left_semi")))
        centers = _stars(index, split.select("key", F.col("group").alias("part"), F.col("degree").alias("value")), limit)
        inner = _degrees(index, split.select("key", "weight").join(centers.withColumnRenamed("center", "part"), "key"), limit)
        done = done.unionByName(split.select("key", "group").join(centers, "key").join(inner, "key").select("key", "group", "center", "degree"))
    everyone = member.select("key", "rep").join(done.withColumnRenamed("key", "rep"), "rep")
    order = Window.partitionBy("group", "center").orderBy(F.desc("degree"), "key")
    best = everyone.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    names = best.groupBy("group", "center").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda s: s["key"]).alias("typical"))
    size = everyone.groupBy("group", "center").agg(F.count("*").alias("size"), F.min("key").alias("cluster"))
    return size.join(names, ["group", "center"]).select("group", "cluster", "size", "typical")


def _reach(index: Index, limit: float) -> DataFrame:
    """(list, cell, chunk, key, vec): every chunk that the limit reaches from a vector, its own included."""
    books = index.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, CELL):
            keys = t.column("key").to_numpy()
            yield from list_probes(t, _matrix(t.column("vec")), keys, np.full(len(keys), limit * limit), books)

    parts = 2 * parallelism(index.placed.sparkSession)
    schema = "scope STRING, key BIGINT, list INT, own_cell INT, own_chunk INT, vec BINARY, radius2 DOUBLE"
    probes = index.placed.repartition(parts, *CELL).sortWithinPartitions(*CELL).mapInArrow(run, schema)
    return index.targets(probes).select(*CELL, "key", "vec").unionByName(index.placed.select(*CELL, "key", "vec"))


def _within(bases: DataFrame, queries: DataFrame, limit: float, best: bool) -> DataFrame:
    """What the bases of the same ``part`` within the limit of a query hold, the query itself included.

    Both sides have the columns of a chunk, key, vec and part, the bases also ``value``. The result is
    (key, value): the sum of the values; or, with ``best``, (key, value, best): the greatest value and the
    smallest key that has it. No pair leaves a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, q in meetings(batches, CELL):
            keys, value, part = (t.column(c).to_numpy() for c in ("key", "value", "part"))
            order = np.lexsort((keys, -value))
            x, keys, value, part = _matrix(t.column("vec"))[order], keys[order], value[order], part[order]
            y, ykeys, ypart = _matrix(q.column("vec")), q.column("key").to_numpy(), q.column("part").to_numpy()
            half = (x * x).sum(1)
            step = max(1, BLOCK // len(x))
            for s in range(0, len(y), step):
                z = y[s : s + step]
                hit = ((z * z).sum(1)[:, None] + half[None] - 2.0 * (z @ x.T) <= limit * limit + 1e-9) & (ypart[s : s + step, None] == part[None])
                some = hit.any(1)
                at = hit.argmax(1)[some]  # the first in the order
                amount = value[at] if best else (hit @ value)[some]
                yield pa.RecordBatch.from_arrays([pa.array(ykeys[s : s + step][some]), pa.array(amount), pa.array(keys[at])], names=["key", "value", "best"])

    rows = bases.select(*CELL, "key", "vec", "part", "value", F.lit(0).alias("role")).unionByName(queries.select(*CELL, "key", "vec", "part", F.lit(0.0).alias("value"), F.lit(1).alias("role")))
    parts = 2 * parallelism(rows.sparkSession)
    met = rows.repartition(parts, *CELL).sortWithinPartitions(*CELL, "role").mapInArrow(run, "key BIGINT, value DOUBLE, best BIGINT")
    if not best:
        return met.groupBy("key").agg(F.sum("value").alias("value"))
    first = met.groupBy("key").agg(F.max(F.struct("value", (-F.col("best")).alias("k"))).alias("m"))
    return first.select("key", F.col("m.value").alias("value"), (-F.col("m.k")).alias("best"))


def _degrees(index: Index | None, state: DataFrame, limit: float) -> DataFrame:
    """(key, degree): weights of the members of the same part within the limit; ``state`` is key, part, weight."""
    if index is None:
        return state.select("key", F.col("weight").alias("degree"))
    bases = index.placed.join(state.withColumnRenamed("weight", "value"), "key")
    queries = _reach(index, limit).join(state.select("key", "part"), "key")
    return _within(bases, queries, limit, False).withColumnRenamed("value", "degree")


def _stars(index: Index, state: DataFrame, limit: float) -> DataFrame:
    """(key, center): stars around the members that no unassigned one within the limit exceeds; ``state`` is key, part, value."""
    placed, reached = cut(index.placed.select(*CELL, "key", "vec")), cut(_reach(index, limit))
    left, done = cut(state), None
    while True:
        queries = reached.join(left.select("key", "part"), "key")
        top = cut(_within(placed.join(left, "key"), queries, limit, True))
        heads = left.join(top.where("key = best").select("key"), "key", "left_semi")
        near = cut(_within(placed.join(heads, "key"), queries, limit, True).select("key", F.col("best").alias("center")))
        done = near if done is None else done.unionByName(near)
        left = cut(left.join(near.select("key"), "key", "left_anti"))
        if left.isEmpty():
            return done
