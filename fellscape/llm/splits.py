"""Train, validation and test splits that keep related records together (problem 4).

Records that share any entity are one component (alternating large-star and small-star over
record-entity edges); the component identifier is hashed into ranges proportional to the wanted
shares, so a component lands in one split and the assignment needs no coordination.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscape.llm.components import star_components

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))

#: How a replicate text names a pool: the word or its initial, signs, perhaps "no.", the number.
POOL = r"(?i)(?<![\p{L}\p{N}])p(?:ool)?[\s._:#/-]*(?:(?:number|num|nr|no)[\s._:#°º-]*)?(\d+)"


def _plain_table() -> tuple[str, str]:
    """Decimal digits of every script, and full-width forms, with the ASCII characters they stand for."""
    pairs = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x10000) if unicodedata.decimal(chr(c), None) is not None}
    pairs |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    return "".join(pairs), "".join(pairs.values())


def plain(text: Column) -> Column:
    """The text with digits of any script and full-width forms as ASCII."""
    return F.translate(text, *_plain_table())


def digits_as_number(text: Column) -> Column:
    """All digits of a text as the text of one number of any length, without leading zeros; null without digits."""
    digits = F.regexp_replace(plain(text), "[^0-9]", "")
    return F.nullif(F.regexp_replace(digits, "^0+(?=[0-9])", ""), F.lit(""))


def pool_number(text: Column) -> Column:
    """The number of the pool that a replicate text names, as text; null if it names none."""
    return digits_as_number(F.nullif(F.regexp_extract(plain(text), POOL, 1), F.lit("")))


def split_of(component: Column, shares: tuple = SHARES, seed: int = 17) -> Column:
    """The split whose range holds the component's hash, out of 2^20 equal steps."""
    step = F.pmod(F.xxhash64(component, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(step < upto, name) if out is None else out.when(step < upto, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def _vertices(entities: list[str]) -> Column:
    """The entities of a record as vertices: position of the column, colon, the value's text; nulls tie nothing."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(entities)]))


def entity_components(records: DataFrame, entities: list[str]) -> DataFrame:
    """(entity_kind, entity, component) over records that share any entity.

    ``entities`` are columns of any type with a text form: negative numbers, numbers of any length
    and empty texts are entities like others, only null is none. ``entity_kind`` is the position
    of the column, ``entity`` the text of the value, ``component`` the smallest vertex.
    """
    rows = records.select(_vertices(entities).alias("vs")).where("size(vs) > 0").distinct()
    links = rows.select(F.explode("vs").alias("a"), F.element_at("vs", 1).alias("b"))
    comp = star_components(links, "a", "b")
    at = F.instr("node", ":")
    return comp.select(F.substring("node", F.lit(1), at - 1).cast("int").alias("entity_kind"), F.substring("node", at + 1, F.length("node")).alias("entity"), "component")


def assign_splits(records: DataFrame, key: list[str], entities: list[str], shares: tuple = SHARES, seed: int = 17) -> DataFrame:
    """``key``, component and split of every record.

    A record's component is that of its first non-null entity (all its entities are in one); a
    record without entities is on its own, hashed by its key (a null in the key counts as a value).
    Repeated records count once, an empty table gives no rows, and shares are reached in
    expectation over components: a component that holds a third of all rows stays whole.
    """
    comp = entity_components(records, entities)
    one = records.select(*key, F.get(_vertices(entities), F.lit(0)).alias("_v")).distinct()
    names = comp.select(F.concat(F.col("entity_kind").cast("string"), F.lit(":"), "entity").alias("_v"), F.col("component").alias("_c"))
    own = F.concat(F.lit("r"), F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    tied = one.where("_v is not null").join(names, "_v").select(*key, F.concat(F.lit("c"), "_c").alias("component"))
    return tied.unionByName(one.where("_v is null").select(*key, own.alias("component"))).withColumn("split", split_of(F.col("component"), shares, seed))
