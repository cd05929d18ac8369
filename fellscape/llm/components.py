"""Connected components over edge tables that never leave the executors.

``boruvka_components`` (problem 5) hooks every component to its smallest neighbour and collapses
the trees by pointer doubling; ``star_components`` (problem 4) alternates large-star and
small-star. Both keep one row per edge or node, aggregate before they shuffle, cut the lineage
with checkpoints in the shared folder and read only counts on the driver. A vertex that holds a
third of all edges is one group of a minimum (partially aggregated) and one key of an equi-join,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.session import cut


def _both_ways(edges: DataFrame, scope: list[str]) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    pairs = F.array(F.struct(u.alias("c"), v.alias("n")), F.struct(v.alias("c"), u.alias("n")))
    return edges.select(*scope, F.inline(pairs))


def canonical_edges(edges: DataFrame, a: str, b: str, scope: list[str]) -> DataFrame:
    """Distinct undirected edges u < v; edges with a null end or scope and self edges drop out."""
    return (
        edges.select(*scope, F.col(a).alias("a"), F.col(b).alias("b"))
        .dropna()
        .where("a <> b")
        .select(*scope, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        .distinct()
    )


def _hook(edges: DataFrame, scope: list[str], max_doublings: int = 64) -> DataFrame:
    """(scope, c, root): every component hooked along its smallest outgoing edge, trees collapsed.

    Edges are ordered by (smaller label, larger label), so the smallest edge of a component leads
    to its smallest neighbour. Two components that choose the same edge form the only possible
    cycle; the smaller of them is the root, and it is the smallest label of its tree.
    """
    chosen = _both_ways(edges, scope).groupBy(*scope, "c").agg(F.min("n").alias("p"))
    # A component below its smallest neighbour is a root if that neighbour chose it back; in this
    # order the smallest neighbour n of c has c as its own smallest neighbour or one below c.
    back = chosen.select(*scope, F.col("c").alias("p"), F.col("p").alias("pp"))
    tree = cut(
        chosen.join(back, [*scope, "p"])
        .select(*scope, "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    )
    for _ in range(max_doublings):
        up = tree.select(*scope, F.col("c").alias("p"), F.col("p").alias("g"))
        doubled = cut(tree.join(up, [*scope, "p"]).select(*scope, "c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")))
        tree = doubled.drop("moved")
        if doubled.where("moved").isEmpty():
            break
    return tree.withColumnRenamed("p", "root")


def boruvka_components(edges: DataFrame, a: str, b: str, scope: list[str] | None = None, max_rounds: int = 64) -> DataFrame:
    """(scope, node, component) for every end of an edge; component is its smallest node.

    Rounds: hook, relabel both ends of every edge by their roots, drop inner edges, make the rest
    distinct, until no edge is left. Every round at least halves the components that still have
    edges. Edges with a null end or scope count for nothing, a self edge only for its node; an
    empty edge table gives an empty result. ``edges`` may repeat rows and have other columns.
    """
    scope = scope or []
    clean = edges.select(*scope, F.col(a).cast("bigint").alias("_a"), F.col(b).cast("bigint").alias("_b")).dropna()
    nodes = clean.select(*scope, F.explode(F.array("_a", "_b")).alias("node")).distinct()
    work = cut(canonical_edges(clean, "_a", "_b", scope))
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if work.isEmpty():
            break
        roots = _hook(work, scope)
        maps.append(roots)
        ru = roots.select(*scope, F.col("c").alias("u"), F.col("root").alias("a"))
        rv = roots.select(*scope, F.col("c").alias("v"), F.col("root").alias("b"))
        work = cut(canonical_edges(work.join(ru, [*scope, "u"]).join(rv, [*scope, "v"]), "a", "b", scope))
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    if not maps:
        return nodes.withColumn("component", F.col("node"))
    total = maps[-1]
    for earlier in reversed(maps[:-1]):  # from the smallest table to the largest
        later = total.select(*scope, F.col("c").alias("root"), F.col("root").alias("r2"))
        total = earlier.join(later, [*scope, "root"], "left").select(*scope, "c", F.coalesce("r2", "root").alias("root"))
    named = total.withColumnRenamed("c", "node")
    return nodes.join(named, [*scope, "node"], "left").select(*scope, "node", F.coalesce("root", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first())


def star_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every end of an edge, by alternating large-star and small-star.

    Large-star links every larger neighbour of a node to the smallest vertex of its neighbourhood,
    small-star every smaller one and the node itself; both keep the components and end in stars
    around their smallest vertices. Vertices may be of any type with an order. Nulls, self edges, repeats and empty tables as in
    ``boruvka_components``.
    """
    clean = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).dropna()
    nodes = clean.select(F.explode(F.array("_a", "_b")).alias("node")).distinct()
    work = cut(canonical_edges(clean, "_a", "_b", []))
    before = _state(work)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large-star: c with neighbours n; every n > c goes to min(neighbours, c)
        two = _both_ways(work, [])
        low = two.groupBy("c").agg(F.min("n").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = two.where("n > c").join(low, "c").select(F.col("n").alias("x"), "m")
        stars = canonical_edges(large, "x", "m", [])
        # small-star: c (larger end) with smaller neighbours; they and c go to the smallest of them
        down = stars.select(F.col("v").alias("c"), F.col("u").alias("n"))
        least = down.groupBy("c").agg(F.min("n").alias("m"))
        small = down.join(least, "c").select(F.col("n").alias("x"), "m").unionByName(least.select(F.col("c").alias("x"), "m"))
        work = cut(canonical_edges(small, "x", "m", []))
        after = _state(work)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    named = work.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
