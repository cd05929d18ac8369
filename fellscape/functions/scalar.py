"""Scalar functions on columns; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def clipped_exp(x: Column | str, bound: float) -> Column:
    """exp of a value clipped to +-bound."""
    return F.exp(clip(x, -bound, bound))


def safe_log(x: Column | str, floor: float = TINY) -> Column:
    return F.log(F.greatest(col(x), F.lit(floor)))


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def dot(a: Sequence[str], b: Sequence[str]) -> Column:
    """Scalar product of two vectors held in columns (generated code, unlike array functions)."""
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + F.col(x) * F.col(y)
    return out


def norm(a: Sequence[str]) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Sequence[str], b: Sequence[str]) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def array_dot(a: Column | str, b: Column | str) -> Column:
    """Scalar product of two array columns; the shorter decides the length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def array_norm(a: Column | str) -> Column:
    return F.sqrt(array_dot(a, a))


def hash_uniform(*parts: Column | str) -> Column:
    """A portable uniform number in [0, 1): the first 32 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_index(n: Column, *parts: Column | str) -> Column:
    """A portable index 0 .. n - 1."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def hash_normal(*parts: Column | str) -> Column:
    """A standard normal number from two hash-uniform ones (Box-Muller)."""
    u = F.greatest(hash_uniform(*parts, F.lit("u")), F.lit(2.0**-33))
    return F.sqrt(-2 * F.log(u)) * F.cos(hash_uniform(*parts, F.lit("v")) * 6.283185307179586)


def gene_name(x: Column | str) -> Column:
    """Canonical gene name: upper case, without dashes and underscores, without a leading MT."""
    plain = F.translate(F.upper(F.trim(col(x))), "-_", "")
    return F.regexp_replace(plain, "^MT(?=.)", "")


def normalize_total(counts: Column | str, total: Column | str, target: Column | str) -> Column:
    """Counts scaled so that a cell's total becomes ``target``; size factors are at least 1e-9."""
    factor = F.greatest(col(total) / col(target), F.lit(1e-9))
    return F.transform(col(counts), lambda c: c / factor)


def velocity_in_log_space(x: Column | str, v: Column | str, factor: Column | str) -> Column:
    """log1p((x + v) / f) - log1p(x / f), negative arguments taken as 0."""
    f = F.greatest(col(factor), F.lit(1e-9))
    return F.zip_with(col(x), col(v), lambda a, b: F.log1p(F.greatest((a + b) / f, F.lit(0.0))) - F.log1p(F.greatest(a / f, F.lit(0.0))))


def fingerprint(columns: Sequence[str], length: int = 64) -> Column:
    """SHA-256 of the sorted-key JSON of a row."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)


def phase_of(q: Column | str) -> Column:
    """Commitment phase of a probability, in five bands (fixed names and bounds)."""
    q = col(q)
    return (
        F.when(q < 0.2, "progenitor").when(q < 0.4, "early").when(q < 0.6, "transition state").when(q < 0.8, "late").when(q <= 1.0001, "committed")
    )
