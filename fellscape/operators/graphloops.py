"""Topology and flow of graphs that do not fit a task: loops of joins, lineage cut in every round.

Nodes of an order are compared as (energy, node). Every loop ends by itself, when nothing is left
to do; none is cut off at a number of rounds. ``by`` columns name the graph and are never null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscape.session import cut


def both_ways(pairs: DataFrame, by: Sequence[str], a: str, b: str, same: Sequence[str] = (), signed: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, ...) of every pair in both directions; ``signed`` columns change their sign with the direction."""
    there = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), *[F.col(c) for c in (*same, *signed)])
    back = F.struct(F.col(b).alias("a"), F.col(a).alias("b"), *[F.col(c) for c in same], *[(-F.col(c)).alias(c) for c in signed])
    return pairs.select(*by, F.inline(F.array(there, back)))


def collapsed(parents: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, c, root): roots of the trees that (c, p) forms, by pointer doubling; a root is its own parent."""
    tree = cut(parents.select(*by, "c", "p"))
    while True:
        up = tree.select(*by, F.col("c").alias("p"), F.col("p").alias("g"))
        new = cut(tree.join(up, [*by, "p"], "left").select(*by, "c", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")))
        tree = new.drop("moved")
        if new.where("moved").isEmpty():
            return tree.withColumnRenamed("p", "root")


def _relabelled(links: DataFrame, roots: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, a, b, ...) with both ends at their roots; links inside a tree drop out. Ends without a root keep their name."""
    out = links
    for end in ("a", "b"):
        named = roots.select(*by, F.col("c").alias(end), F.col("root").alias("_r"))
        out = out.join(named, [*by, end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    return out.where("a <> b")


def persistence(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, birth_node, death_node, birth, death, persistence): lower-star pairs of dimension 0.

    Every node descends to its lowest neighbour; the basins' links carry their saddle. In a round every
    basin looks at its lowest saddle, of equal ones at the oldest basin beyond it, and dies there if
    that basin is older: up to its lowest saddle a basin is the whole component of its minimum.
    """
    by = list(by)
    order = nodes.select(*by, F.col("idx").alias("n"), F.struct("energy", "idx").alias("o"))
    two = both_ways(edges.where("src <> dst"), by, "src", "dst").distinct()
    for end in ("a", "b"):
        two = two.join(order.withColumnsRenamed({"n": end, "o": f"o{end}"}), [*by, end])
    two = cut(two)
    low = two.where("ob < oa").groupBy(*by, F.col("a").alias("c")).agg(F.min("ob").alias("m"))
    down = low.select(*by, "c", F.col("m.idx").alias("p"))
    roots = order.select(*by, F.col("n").alias("c")).join(down, [*by, "c"], "left").select(*by, "c", F.coalesce("p", "c").alias("p"))
    basin = collapsed(roots, by)
    flat = nodes.join(down.select(*by, F.col("c").alias("idx")), [*by, "idx"], "left_semi")
    pairs = [flat.select(*by, F.col("idx").alias("birth_node"), F.col("idx").alias("death_node"), F.col("energy").alias("birth"), F.col("energy").alias("death"))]
    links = _relabelled(two.select(*by, "a", "b", F.greatest("oa", "ob").alias("s")), basin, by)
    while True:
        links = cut(links.groupBy(*by, "a", "b").agg(F.min("s").alias("s")))
        if links.isEmpty():
            break
        ranked = links.join(order.withColumnsRenamed({"n": "b", "o": "ob"}), [*by, "b"])
        first = ranked.groupBy(*by, "a").agg(F.min(F.struct("s", "ob")).alias("m"))
        dies = cut(first.join(order.withColumnsRenamed({"n": "a", "o": "oa"}), [*by, "a"]).where(F.col("m.ob") < F.col("oa")).select(*by, "a", "oa", "m"))
        pairs.append(dies.select(*by, F.col("a").alias("birth_node"), F.col("m.s.idx").alias("death_node"), F.col("oa.energy").alias("birth"), F.col("m.s.energy").alias("death")))
        links = _relabelled(links, collapsed(dies.select(*by, F.col("a").alias("c"), F.col("m.ob.idx").alias("p")), by), by)
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.withColumn("persistence", F.col("death") - F.col("birth"))


def _spread(links: DataFrame, start: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, m): smallest ``m`` that reaches each node along a -> b, from ``start``; only changes are sent on."""
    best, front = cut(start.select(*by, "n", "m")), start
    while not front.isEmpty():
        came = links.join(front.select(*by, F.col("n").alias("a"), "m"), [*by, "a"]).groupBy(*by, F.col("b").alias("n")).agg(F.min("m").alias("m2"))
        new = cut(best.join(came, [*by, "n"], "full").select(*by, "n", F.least("m", "m2").alias("m"), (F.col("m").isNull() | (F.col("m2") < F.col("m"))).alias("less")))
        best, front = new.select(*by, "n", "m"), new.where("less")
    return best


def strong_sizes(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, size) of every strongly connected component, by colouring.

    In a round the smallest node that reaches each node is its colour; what reaches the colour's own
    node within the colour is its component. Links between colours or to a finished node drop out.
    """
    by = list(by)
    nodes = edges.select(*by, F.explode(F.array("src", "dst")).alias("n")).distinct()
    live = cut(edges.select(*by, F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    sizes, done = [], nodes.limit(0)
    while not live.isEmpty():
        here = live.select(*by, F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("m", F.col("n"))
        color = _spread(live, here, by)
        for end in ("a", "b"):
            live = live.join(color.withColumnsRenamed({"n": end, "m": f"c{end}"}), [*by, end])
        live = cut(live.where("ca = cb").select(*by, "a", "b"))
        back = live.select(*by, F.col("a").alias("b"), F.col("b").alias("a"))
        heads = color.where("n = m")
        found = cut(_spread(back, heads, by))
        sizes.append(found.groupBy(*by, "m").agg(F.count("*").alias("size")).select(*by, "size"))
        done = done.unionByName(found.select(*by, "n"))
        for end in ("a", "b"):
            live = live.join(found.select(*by, F.col("n").alias(end)), [*by, end], "left_anti")
        live = cut(live)
    out = nodes.join(done, [*by, "n"], "left_anti").select(*by, F.lit(1).cast("bigint").alias("size"))
    for s in sizes:
        out = out.unionByName(s)
    return out


def potentials(pairs: DataFrame, by: Sequence[str], tolerance: float, rounds: int) -> DataFrame:
    """(by, n, x): least-squares potential of the flows on (i, j), by conjugate gradients over all graphs together."""
    by = list(by)
    ends = both_ways(pairs, by, "i", "j", signed=["flow"])  # what flows from a to b raises b
    near = cut(ends.select(*by, "a", "b"))
    right = ends.groupBy(*by, F.col("b").alias("n")).agg(F.sum("flow").alias("r"), F.count("*").alias("degree"))
    state = cut(right.select(*by, "n", "degree", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    norm = lambda d, a, b, name: d.groupBy(*by).agg(F.sum(F.col(a) * F.col(b)).alias(name))
    rr = cut(norm(state, "r", "r", "rr").withColumn("stop", tolerance * tolerance * F.greatest("rr", F.lit(1e-300))))
    for _ in range(rounds):
        if rr.where("rr > stop").isEmpty():
            return state.select(*by, "n", "x")
        around = near.join(state.select(*by, F.col("n").alias("b"), "p"), [*by, "b"]).groupBy(*by, F.col("a").alias("n")).agg(F.sum("p").alias("s"))
        met = cut(state.join(around, [*by, "n"]).withColumn("ap", F.col("degree") * F.col("p") - F.col("s")).drop("s"))
        # a row for each graph, of which there are no more than one per TASK_EDGES edges
        step = F.broadcast(rr.join(norm(met, "p", "ap", "pap"), by).select(*by, "rr", F.when(F.col("rr") > F.col("stop"), F.col("rr") / F.greatest("pap", F.lit(1e-300))).otherwise(0.0).alias("al")))
        met = cut(met.join(step, by).withColumn("x", F.col("x") + F.col("al") * F.col("p")).withColumn("r", F.col("r") - F.col("al") * F.col("ap")))
        new = cut(rr.select(*by, "stop", F.col("rr").alias("old")).join(norm(met, "r", "r", "rr"), by))
        beta = F.broadcast(new.select(*by, (F.col("rr") / F.greatest("old", F.lit(1e-300))).alias("be")))
        state = cut(met.drop("rr", "al", "ap").join(beta, by).withColumn("p", F.col("r") + F.col("be") * F.col("p")).drop("be"))
        rr = new.drop("old")
    raise RuntimeError(f"flows not resolved after {rounds} rounds")


def tree_heights(links: DataFrame, roots: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, up, depth, height): breadth-first forest over (a, b, f), a level a round; height is the sum of f from the root.

    Of the nodes of a level that reach a new node the smallest is its parent.
    """
    by = list(by)
    seen = cut(roots.select(*by, "n", F.lit(None).cast("bigint").alias("up"), F.lit(0).alias("depth"), F.lit(0.0).alias("height")))
    front = seen
    while not front.isEmpty():
        came = links.join(front.select(*by, F.col("n").alias("a"), "depth", "height"), [*by, "a"])
        first = came.groupBy(*by, F.col("b").alias("n")).agg(F.min(F.struct("a", "f", "depth", "height")).alias("m"))
        new = first.join(seen.select(*by, "n"), [*by, "n"], "left_anti")
        front = cut(new.select(*by, "n", F.col("m.a").alias("up"), (F.col("m.depth") + 1).alias("depth"), (F.col("m.height") + F.col("m.f")).alias("height")))
        seen = cut(seen.unionByName(front))
    return seen


def smallest_of_components(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n): the smallest node of every component of links given in both directions."""
    start = links.select(*by, F.col("a").alias("n")).distinct().withColumn("m", F.col("n"))
    return _spread(links.select(*by, "a", "b"), start, by).select(*by, F.col("m").alias("n")).distinct()


def affinities(flows: DataFrame, by: Sequence[str], beta: float) -> DataFrame:
    """(by, affinity) of every pair outside the breadth-first forest."""
    by = list(by)
    links = cut(both_ways(flows, by, "i", "j", signed=["flow"]).withColumnRenamed("flow", "f"))
    tree = tree_heights(links, smallest_of_components(links, by), by)
    inner = tree.where("up is not null").select(*by, F.least("n", "up").alias("i"), F.greatest("n", "up").alias("j"))
    chords = flows.join(inner, [*by, "i", "j"], "left_anti")
    for end in ("i", "j"):
        chords = chords.join(tree.select(*by, F.col("n").alias(end), F.col("height").alias(f"h{end}")), [*by, end])
    return chords.select(*by, (2 * beta * F.abs(F.col("flow") + F.col("hi") - F.col("hj"))).alias("affinity"))


def minimum_forest(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, i, j) of the minimum spanning forest by (distance, i, j): every component takes its least outgoing pair."""
    by = list(by)
    links = cut(both_ways(pairs.withColumn("e", F.struct("distance", "i", "j")), by, "i", "j", same=["e"]))
    chosen = []
    while not links.isEmpty():
        first = cut(links.groupBy(*by, F.col("a").alias("c")).agg(F.min(F.struct("e", "b")).alias("m")).select(*by, "c", "m.e", F.col("m.b").alias("p")))
        chosen.append(first.select(*by, "e.i", "e.j"))
        other = first.select(*by, F.col("c").alias("p"), F.col("p").alias("pp"))
        hooks = first.join(other, [*by, "p"]).select(*by, "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        links = cut(_relabelled(links, collapsed(hooks, by), by).groupBy(*by, "a", "b").agg(F.min("e").alias("e")))
    out = pairs.select(*by, "i", "j").limit(0)
    for c in chosen:
        out = out.unionByName(c)
    return out.distinct()


def cycle_currents(pairs: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    """(by, rank, a, b, nodes, affinity, current, contribution): the largest cycles of the chords of the minimum forest.

    The force around a chord's cycle is a difference of heights in the tree, so chords are ranked without their
    cycles; only the nodes of the ``top`` are read back, a step of all at a time.
    """
    by = list(by)
    safe = lambda c: F.greatest(F.col(c), F.lit(1e-300))
    rows = cut(pairs.withColumn("f", F.log(safe("forward") / safe("backward"))))
    tree = cut(minimum_forest(rows, by))
    links = cut(both_ways(rows.join(tree, [*by, "i", "j"], "left_semi"), by, "i", "j", signed=["f"]))
    heights = tree_heights(links, smallest_of_components(links, by), by)
    chords = rows.join(tree, [*by, "i", "j"], "left_anti")
    for end in ("i", "j"):
        chords = chords.join(heights.select(*by, F.col("n").alias(end), F.col("height").alias(f"h{end}"), F.col("depth").alias(f"d{end}"), F.col("up").alias(f"u{end}")), [*by, end])
    flux = chords.withColumn("affinity", F.col("f") + F.col("hi") - F.col("hj")).withColumn("current", F.col("forward") - F.col("backward")).withColumn("contribution", F.col("affinity") * F.col("current"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("contribution")), "i", "j")
    best = flux.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    # both ends climb until they meet, the deeper one first, of equal depths the left one
    state = cut(best.select(*by, "rank", "i", "j", "affinity", "current", "contribution", F.array("i").alias("l"), F.array("j").alias("r"), *[c for e in "ij" for c in (f"d{e}", f"u{e}")]))
    last = lambda c: F.element_at(c, -1)
    while True:
        apart = state.where(last("l") != last("r"))
        if apart.isEmpty():
            break
        left = F.col("di") >= F.col("dj")
        moved = apart.withColumn("at", F.when(left, F.col("ui")).otherwise(F.col("uj"))).join(heights.select(*by, F.col("n").alias("at"), F.col("depth").alias("d"), F.col("up").alias("u")), [*by, "at"])
        keep: list[Column] = [F.when(left, F.concat("l", F.array("at"))).otherwise(F.col("l")).alias("l"), F.when(left, F.col("r")).otherwise(F.concat("r", F.array("at"))).alias("r")]
        ends = [F.when(left, F.col("d")).otherwise(F.col("di")).alias("di"), F.when(left, F.col("u")).otherwise(F.col("ui")).alias("ui"), F.when(left, F.col("dj")).otherwise(F.col("d")).alias("dj"), F.when(left, F.col("uj")).otherwise(F.col("u")).alias("uj")]
        same = [*by, "rank", "i", "j", "affinity", "current", "contribution"]
        state = cut(moved.select(*same, *keep, *ends).unionByName(state.where(last("l") == last("r"))))
    # i, then from j up to where both meet, and down to i without i itself
    over = F.when(F.size("l") > 1, F.col("r")).otherwise(F.slice("r", 1, F.size("r") - 1))
    way = F.concat(F.array("i"), over, F.reverse(F.slice("l", 2, F.greatest(F.size("l") - 2, F.lit(0)))))
    return state.select(*by, F.col("rank").cast("int"), F.col("i").alias("a"), F.col("j").alias("b"), way.alias("nodes"), "affinity", "current", "contribution")


def path_energies(sources: DataFrame, edges: DataFrame, by: Sequence[str], temperature: float, max_paths: int) -> DataFrame:
    """(by, idx, energy, reached): propagated free energies, a level of ``topology.propagate_energy`` a round.

    A node takes at most ``max_paths`` works of a round, those of its smallest sources, so a hot target
    is cut down by a ranked window before its works are collected.
    """
    by = list(by)
    starts = sources.select(*by, "idx").distinct()
    e = cut(edges.select(*by, "src", "dst", "work").join(starts.withColumnRenamed("idx", "dst"), [*by, "dst"], "left_anti"))
    state = cut(starts.select(*by, "idx", F.array(F.lit(0.0)).alias("works"), F.lit(0.0).alias("energy"), F.lit(True).alias("front")))
    top = F.array_max(F.transform("works", lambda x: -x / temperature))
    shifted = F.aggregate(F.transform("works", lambda x: F.exp(-x / temperature - F.col("_top"))), F.lit(0.0), lambda s, x: s + x) / F.size("works")
    while not state.where("front").isEmpty():
        way = e.join(state.where("front").select(*by, F.col("idx").alias("src"), "works"), [*by, "src"])
        came = way.select(*by, F.col("dst").alias("idx"), "src", "work", F.posexplode("works").alias("k", "w"))
        w = Window.partitionBy(*by, "idx").orderBy("src", "work", "k")
        first = came.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_paths)
        gained = first.groupBy(*by, "idx").agg(F.sort_array(F.collect_list(F.struct("_n", (F.col("w") + F.col("work")).alias("w")))).alias("new"))
        met = state.join(gained, [*by, "idx"], "full")
        room = max_paths - F.coalesce(F.size("works"), F.lit(0))
        took = F.col("new").isNotNull() & (room > 0)
        works = F.when(took, F.concat(F.coalesce("works", F.array().cast("array<double>")), F.slice(F.col("new.w"), 1, F.greatest(room, F.lit(1))))).otherwise(F.col("works"))
        met = met.select(*by, "idx", works.alias("works"), "energy", took.alias("took")).withColumn("_top", top).withColumn("_e", -temperature * (F.col("_top") + F.log(shifted)))
        falls = F.col("took") & (F.col("energy").isNull() | (F.col("_e") < F.col("energy") - 1e-10))
        state = cut(met.select(*by, "idx", "works", F.when(falls, F.col("_e")).otherwise(F.col("energy")).alias("energy"), F.coalesce(falls, F.lit(False)).alias("front")))
    nodes = edges.select(*by, F.explode(F.array("src", "dst")).alias("idx")).unionByName(starts).distinct()
    worst = F.broadcast(state.groupBy(*by).agg(F.max("energy").alias("worst")))  # a row for each graph
    met = nodes.join(state.select(*by, "idx", "energy"), [*by, "idx"], "left").join(worst, by, "left")
    return met.select(*by, "idx", F.coalesce("energy", "worst", F.lit(0.0)).alias("energy"), F.col("energy").isNotNull().alias("reached"))
