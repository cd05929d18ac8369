"""Adjacency-table shredding of deeply nested JSON records into related flat tables.

``shred`` turns every payload into rows (node, parent, label, ordinal, kind, scalar): one row per
JSON value, numbered in document order. Entity tables are then plain joins of object nodes with
their scalar children (``entity_table`` pivots them) and of child nodes with their parents, so a
parent-child link is always the pair (document, parent node).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.session import cut

ADJACENCY = "node BIGINT, parent BIGINT, label STRING, ordinal BIGINT, kind STRING, scalar STRING, envelope BOOLEAN"


class _Number(str):
    """The text of a JSON number as it was written."""


def _load(text: str):
    return json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def _opened(value):
    """A string that holds JSON of an object or a list becomes that; also when quoted again and again."""
    seen = value
    while isinstance(seen, str) and not isinstance(seen, _Number):
        head = seen.lstrip()[:1]
        if head not in ('{', '[', '"'):
            return value
        try:
            seen = _load(seen)
        except (ValueError, RecursionError):
            return value
    return seen if isinstance(seen, dict | list) else value


def read_object(text: str | None) -> dict | None:
    """The object a payload holds, in itself or as a string; None if it is not one complete object."""
    if not text:
        return None
    try:
        value = _opened(_load(text))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def walk(root: dict, envelopes: tuple[str, ...]) -> Iterator[tuple]:
    """Adjacency rows of one document in document order, without recursion."""
    stack = [(root, -1, None, -1, True)]
    node = 0
    while stack:
        value, parent, label, ordinal, envelope = stack.pop()
        value = _opened(value)
        if isinstance(value, dict):
            yield node, parent, label, ordinal, "object", None, envelope
            stack.extend((v, node, k, -1, envelope and k in envelopes) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            yield node, parent, label, ordinal, "array", None, False
            stack.extend((v, node, None, i, False) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            yield node, parent, label, ordinal, "null", None, False
        elif isinstance(value, bool):
            yield node, parent, label, ordinal, "boolean", "true" if value else "false", False
        else:
            yield node, parent, label, ordinal, "number" if isinstance(value, _Number) else "string", str(value), False
        node += 1


def readable_payloads(df: DataFrame, payload: str, flag: str = "readable") -> DataFrame:
    """``df`` with a boolean column: the payload is one complete JSON object, in itself or as a string."""
    at = df.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([read_object(x) is not None for x in b.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, ok], names=[*b.schema.names, flag])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{flag}` BOOLEAN")


def latest_readable(df: DataFrame, key: str, received: str, payload: str) -> DataFrame:
    """The latest readable delivery of each key.

    Deliveries equal in every column count once; of two readable payloads received at the same
    time the greater text stands. Keys without a readable delivery and null keys have no row. The
    maximum is taken before and after the shuffle, so a key with a third of all deliveries moves
    one payload per map task.
    """
    rows = readable_payloads(df.where(F.col(key).isNotNull() & F.col(payload).isNotNull()).select(key, received, payload), payload)
    return (
        rows.where("readable")
        .groupBy(key)
        .agg(F.max(F.struct(received, payload)).alias("_d"))
        .select(key, F.col(f"_d.{received}").alias(received), F.col(f"_d.{payload}").alias(payload))
    )


def shred(df: DataFrame, key: str, payload: str, envelopes: tuple[str, ...] = ("results",)) -> DataFrame:
    """Adjacency table of every readable payload: ``key`` and the columns of ``ADJACENCY``.

    ``parent`` is -1 at the root, ``ordinal`` the 0-based position in a list (nulls included) and
    -1 elsewhere; ``kind`` is object, array, string, number, boolean or null; ``scalar`` the text
    of a scalar. ``envelope`` marks the root and the objects reached from it through
    ``envelopes`` labels only. Strings that hold JSON of an object or list are opened in place.
    Unreadable payloads (null, empty, cut off, followed by other text, nested beyond the parser's
    depth) give no rows. Of a label that an object repeats the last value stands.
    """
    source = df.select(key, payload)
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "node", "parent", "label", "ordinal", "kind", "scalar", "envelope"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = read_object(text)
                if root is None:
                    continue
                cols = list(zip(*walk(root, envelopes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(cols[0]), b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names
                )

    return source.mapInArrow(run, f"`{key}` {key_type}, {ADJACENCY}")


def children(adj: DataFrame, key: str, parents: DataFrame, label: str | None = None, kinds: tuple[str, ...] = ("object",)) -> DataFrame:
    """Nodes below ``parents`` (key, node and carried columns), by label, of the given kinds.

    The result has key, node, the parents' other columns, ``label`` and ``ordinal``; both sides
    are filtered before the join, so only the wanted level of the tree moves.
    """
    kid = adj.where(F.col("kind").isin(*kinds))
    if label is not None:
        kid = kid.where(F.col("label") == label)
    kid = kid.select(F.col(key), F.col("parent").alias("_p"), F.col("node").alias("_n"), "label", "ordinal", "scalar", "kind")
    carried = [c for c in parents.columns if c not in (key, "node", "label", "ordinal", "scalar", "kind")]
    up = parents.select(F.col(key), F.col("node").alias("_p"), *carried)
    return kid.join(up, [key, "_p"]).select(key, F.col("_n").alias("node"), *carried, "label", "ordinal", "scalar", "kind")


def list_items(adj: DataFrame, key: str, parents: DataFrame, labels: tuple[str, ...], position: str) -> DataFrame:
    """Object items of the list under any of ``labels``; an object in place of the list is a list of one."""
    held = None
    for label in labels:
        part = children(adj, key, parents, label, ("array", "object"))
        held = part if held is None else held.unionByName(part)
    carried = [c for c in held.columns if c not in (key, "node", "label", "ordinal", "scalar", "kind")]
    single = held.where("kind = 'object'").select(key, "node", *carried, F.lit(0).cast("bigint").alias(position))
    many = children(adj, key, held.where("kind = 'array'").select(key, "node", *carried), None, ("object",))
    return single.unionByName(many.select(key, "node", *carried, F.col("ordinal").alias(position)))


def entity_table(adj: DataFrame, key: str, objects: DataFrame, fields: list[str]) -> DataFrame:
    """``objects`` with their scalar children ``fields`` pivoted into columns (null where absent)."""
    kids = adj.where(F.col("label").isin(*fields) & F.col("kind").isin("string", "number", "boolean"))
    wide = kids.groupBy(key, F.col("parent").alias("node")).pivot("label", fields).agg(F.first("scalar"))
    return objects.join(wide, [key, "node"], "left")


def report_tables(deliveries: DataFrame, key: str = "report_no", payload: str = "payload") -> dict[str, DataFrame]:
    """The entity tables of fit and ensemble reports, each with its document, parent and position.

    ``phases``, ``basins``, ``basin_members``, ``modules``, ``cycles`` and ``cycle_nodes``; the
    adjacency table is written once to the shared folder and read by every join.
    """
    adj = cut(shred(deliveries, key, payload))
    roots = adj.where("envelope").select(key, "node")
    tissues = children(adj, key, children(adj, key, roots, "commitment_ensemble")).withColumnRenamed("label", "tissue")
    sds = children(adj, key, tissues.select(key, "node", "tissue"), "sd_by_phase")
    phases = children(adj, key, sds.select(key, "node", "tissue"), None, ("number", "string"))
    phases = phases.select(key, "tissue", F.col("label").alias("phase"), F.expr("try_cast(trim(scalar) AS DOUBLE)").alias("sd"))

    fits = entity_table(adj, key, children(adj, key, roots, "landscape_fit").select(key, "node"), ["fit_id"])
    diagnostics = children(adj, key, fits, "diagnostics").select(key, "node", "fit_id")
    basins = list_items(adj, key, diagnostics, ("basins",), "basin_no")
    members = scalar_items(adj, key, basins, "members", "member_no", "member")

    modules = children(adj, key, children(adj, key, roots, "new_modules")).withColumnRenamed("label", "module").select(key, "node", "module")
    sources = entity_table(adj, key, children(adj, key, modules, "multi_source").select(key, "node", "module"), ["n_components"])
    cycles = list_items(adj, key, children(adj, key, modules, "schnakenberg").select(key, "node", "module"), ("top_5", "top_5_contributions"), "cycle_no")
    nodes = scalar_items(adj, key, cycles, "nodes", "node_pos", "cycle_node")
    number = lambda c: F.expr(f"try_cast(trim({c}) AS DOUBLE)").alias(c)
    return {
        "adjacency": adj,
        "phases": phases,
        "basins": entity_table(adj, key, basins, ["representative", "depth"]).select(key, "fit_id", "basin_no", "representative", number("depth")),
        "basin_members": members.select(key, "fit_id", "basin_no", "member_no", "member"),
        "modules": sources.select(key, "module", F.expr("try_cast(trim(n_components) AS BIGINT)").alias("n_components")),
        "cycles": entity_table(adj, key, cycles, ["affinity", "current", "ep", "ep_contribution"]).select(
            key, "module", "cycle_no", number("affinity"), number("current"), F.expr("try_cast(trim(coalesce(ep_contribution, ep)) AS DOUBLE)").alias("ep")
        ),
        "cycle_nodes": nodes.select(key, "module", "cycle_no", "node_pos", "cycle_node"),
    }


def scalar_items(adj: DataFrame, key: str, parents: DataFrame, label: str, position: str, value: str) -> DataFrame:
    """Non-null scalar items of the list ``label`` below each parent, with their position.

    A scalar in place of the list counts as a list of one.
    """
    carried = [c for c in parents.columns if c not in (key, "node")]
    held = children(adj, key, parents, label, ("array", "number", "string"))
    one = held.where("kind <> 'array'").select(key, *carried, F.lit(0).cast("bigint").alias(position), F.trim("scalar").alias(value))
    kids = children(adj, key, held.where("kind = 'array'").select(key, "node", *carried), None, ("number", "string"))
    return one.unionByName(kids.select(key, *carried, F.col("ordinal").alias(position), F.trim("scalar").alias(value)))
