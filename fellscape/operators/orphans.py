"""References to records that do not exist: Bloom filter proof, exact verification, report.

A Bloom filter over the parents' keys travels to the tasks that scan the references. A reference
whose key is not in the filter certainly has no parent and never enters a join; only the rest is
joined exactly with the parents, which also tells whether the parent was deleted or came later.
One filter that fits ``MAX_BITS`` is broadcast. More parents are cut by the hash of their keys into
parts with a filter each, and the references of a part meet the filter of that part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import _to_java_column, _to_seq

from fellscape.session import cut

#: Largest filter that is broadcast, in bits (8 MB).
MAX_BITS = 1 << 26
BITS_PER_KEY = 10
#: Bits of the filter of one part (4 MB), hashes of a key in it, and references a task takes from a part.
PART_BITS, HASHES, SLICE = 1 << 25, 7, 4_000_000


@dataclass(frozen=True)
class References:
    """References of one field: ``rows`` has ref_no, key columns, and the time ``at``."""

    table: str
    field: str
    rows: DataFrame


def _bloom_agg(value: Column, items: int, bits: int, session) -> Column:
    sc = session.sparkContext
    args = [value, F.lit(items).cast("bigint"), F.lit(bits).cast("bigint")]
    return Column(sc._jvm.PythonSQLUtils.internalFn("bloom_filter_agg", _to_seq(sc, args, _to_java_column)))


def bloom_of(keys: DataFrame, columns: list[str], items: int) -> DataFrame | None:
    """One row with the Bloom filter of ``columns``; None if ``items`` need more than ``MAX_BITS``."""
    bits = 1 << max(13, (max(1, items) * BITS_PER_KEY - 1).bit_length())
    if items * BITS_PER_KEY > MAX_BITS:
        return None
    hashed = F.xxhash64(*[F.col(c) for c in columns])
    return keys.select(_bloom_agg(hashed, max(1, items), min(bits, MAX_BITS), keys.sparkSession).alias("bloom"))


def might_contain(bloom: DataFrame, columns: list[str]) -> Column:
    """True where the key may be in the filter, false where it certainly is not."""
    jvm = bloom.sparkSession.sparkContext._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    hashed = F.xxhash64(*[F.col(c) for c in columns])
    return F.coalesce(Column(utils.column(test(utils.expression(bloom.scalar()._jc), utils.expression(hashed._jc)))), F.lit(False))


def _positions(hashed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bits of a key in a filter of a power of two of bits, from its 64-bit hash."""
    with np.errstate(over="ignore"):
        x = hashed.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        step = (x * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        for _ in range(HASHES):
            yield (x >> np.uint64(20)) & np.uint64(bits - 1)
            x = x + step


def part_filters(parents: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """(part, bloom): the filter of every part of the keys, a part being the key's hash modulo ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, hashed = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part):
                flags = held.setdefault(int(p), np.zeros(bits, bool))
                for at in _positions(hashed[part == p], bits):
                    flags[at] = True
        for p, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bloom"])

    bits = PART_BITS
    h = F.xxhash64(*[F.col(c) for c in columns])
    rows = parents.select(F.pmod(h, F.lit(parts)).cast("bigint").alias("part"), h.alias("h"))
    return rows.repartition(parts, "part").mapInArrow(run, "part BIGINT, bloom BINARY")


def flag_by_parts(refs: DataFrame, parents: DataFrame, columns: list[str], n_parents: int) -> DataFrame:
    """``refs`` with ``_maybe``: whether the filter of the key's part may hold the key.

    The references of a part are cut into slices of about ``SLICE`` rows, each of which gets the
    filter of its part as its first row, so neither a part nor a hot key is bound to one task.
    """
    parts = -(-max(1, n_parents) * BITS_PER_KEY // PART_BITS)
    names = refs.columns
    h = F.xxhash64(*[F.col(c) for c in columns])
    tagged = refs.withColumn("_h", h).withColumn("_part", F.pmod("_h", F.lit(parts)).cast("bigint"))
    # a row for each part: as many as the parents' keys need filters
    sizes = tagged.groupBy("_part").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_slices"))
    rows = tagged.join(F.broadcast(sizes), "_part").withColumn("_slice", F.pmod(F.xxhash64(*names), F.col("_slices")).cast("int")).drop("_slices")
    filters = sizes.join(part_filters(parents, columns, parts).withColumnRenamed("part", "_part"), "_part", "left")
    filters = filters.select("_part", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), F.coalesce("bloom", F.lit(b"")).alias("_bloom"), F.lit(0).cast("bigint").alias("_h"), F.lit(0).alias("_role"))
    met = rows.withColumn("_role", F.lit(1)).unionByName(filters, True).repartition("_part", "_slice").sortWithinPartitions("_part", "_slice", "_role")
    shape = met.select(*names, "_role", "_h", "_bloom")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(0, bool)
        for b in batches:
            n = len(names)
            role, hashed = b.column(n).to_numpy(), b.column(n + 1).to_numpy()
            heads = np.flatnonzero(role == 0)
            maybe = np.zeros(b.num_rows, bool)
            for lo, hi in zip([-1, *heads], [*heads, b.num_rows]):
                if lo >= 0:
                    flags = np.unpackbits(np.frombuffer(b.column(n + 2)[int(lo)].as_py(), np.uint8)).view(bool)
                if hi > lo + 1 and len(flags):
                    part = np.ones(hi - lo - 1, bool)
                    for at in _positions(hashed[lo + 1 : hi], len(flags)):
                        part &= flags[at]
                    maybe[lo + 1 : hi] = part
            out = pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(maybe)], names=[*names, "_maybe"])
            yield out.filter(pa.array(role == 1)) if len(heads) else out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields)
    return cut(shape.mapInArrow(run, f"{fields}, `_maybe` BOOLEAN"))


def failing_references(refs: DataFrame, parents: DataFrame, key: list[str], n_parents: int) -> DataFrame:
    """References that fail, with the reason.

    ``refs``: tags, ``key`` columns and ``at`` (time of the reference); ``parents``: one row per
    key with ``appeared`` and ``deleted_at``. Reasons, first that holds: ``missing`` (no such
    key), ``late`` (appeared after the reference), ``deleted`` (deleted at or before it). A null
    in a key column is no reference. A null time fails only as ``missing``. Duplicated references
    stay duplicated; the caller decides what counts once. An empty parent table makes every
    reference ``missing``. ``n_parents`` bounds the number of keys; it sizes the filters only.
    """
    refs = refs.dropna(subset=key)
    bloom = bloom_of(parents, key, n_parents)
    tags = refs.columns
    flagged = flag_by_parts(refs, parents, key, n_parents) if bloom is None else refs.withColumn("_maybe", might_contain(bloom, key))
    proven = flagged.where("not _maybe").select(*tags, F.lit("missing").alias("reason"))
    maybe = flagged.where("_maybe").drop("_maybe")
    side = parents.select(*key, F.col("appeared").alias("_a"), F.col("deleted_at").alias("_d"), F.lit(True).alias("_there"))
    exact = (
        maybe.join(side, key, "left")
        .withColumn(
            "reason",
            F.when(F.col("_there").isNull(), "missing").when(F.col("_a") > F.col("at"), "late").when(F.col("_d") <= F.col("at"), "deleted"),
        )
        .where(F.col("reason").isNotNull())
        .select(*tags, "reason")
    )
    return proven.unionByName(exact)


def monthly_report(failing: DataFrame) -> DataFrame:
    """Failing references per table, field, month and reason."""
    return failing.groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.count("*").alias("n"), F.min("ref_no").alias("first_ref_no"))
