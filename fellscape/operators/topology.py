"""Attractors, basins, persistence, cycles and irreversibility of landscapes.

Set-shaped definitions are joins. Union-find over an energy order, depth-first components and
the least-squares projection are sequential per graph: graphs that fit a task run as numpy kernels,
many in parallel, larger ones as the joins of ``graphloops``, with the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscape.operators import graphloops as L
from fellscape.operators.edges import with_ends
from fellscape.operators.pergraph import coded, solve
from fellscape.session import cut


def _ends_of(edges: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, idx): every end of an edge."""
    return edges.select(*by, F.explode(F.array(a, b)).alias("idx")).distinct()


def local_minima(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, idx, energy): nodes with out-edges and no out-neighbour of lower energy."""
    ends = with_ends(edges.select(*by, "src", "dst"), nodes, ["energy"], by)
    low = ends.groupBy(*by, F.col("src").alias("idx"), F.col("a_energy").alias("energy")).agg(F.min("b_energy").alias("m"))
    return low.where("m >= energy").select(*by, "idx", "energy")


def attractors(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), quantile: float = 0.5) -> DataFrame:
    """Local minima with an energy up to a quantile of all local minima."""
    minima = local_minima(nodes, edges, by)
    bound = minima.groupBy(*by).agg(F.percentile("energy", quantile).alias("bound"))
    return (minima.join(bound, list(by)) if by else minima.crossJoin(bound)).where("energy <= bound").select(*by, "idx", "energy")


def watershed_basins(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, idx, root): every node at the root of the closest energy, of equal gaps the smaller root.

    Roots are nodes without a strictly lower out-neighbour. Closest energies are found by order,
    not by pairs: the roots just below and just above a node's energy are window functions over
    the union of nodes and distinct root energies.
    """
    by = list(by)
    ends = with_ends(edges.select(*by, "src", "dst"), nodes, ["energy"], by)
    lower = ends.where("b_energy < a_energy").select(*by, F.col("src").alias("idx")).distinct()
    roots = nodes.join(lower, [*by, "idx"], "left_anti").groupBy(*by, "energy").agg(F.min("idx").alias("root"))
    rows = nodes.select(*by, "energy", "idx", F.lit(None).cast("bigint").alias("root")).unionByName(roots.select(*by, "energy", F.lit(None).cast("bigint").alias("idx"), "root"))
    at = F.when(F.col("root").isNotNull(), F.struct("energy", "root"))
    down = Window.partitionBy(*by).orderBy("energy", F.col("root").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy(F.desc("energy"), F.col("root").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("lo", F.last(at, True).over(down)).withColumn("hi", F.last(at, True).over(up)).where("idx is not null")
    dl, dh = F.col("energy") - F.col("lo.energy"), F.col("hi.energy") - F.col("energy")
    pick = F.when(F.col("hi").isNull() | (dl < dh), F.col("lo.root")).when(F.col("lo").isNull() | (dh < dl), F.col("hi.root")).otherwise(F.least("lo.root", "hi.root"))
    return both.select(*by, "idx", pick.alias("root"))


def critical_points(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, idx, kind): minimum, maximum or saddle by comparison with the out-neighbours; flat ties count for both."""
    ends = with_ends(edges.where("src <> dst").select(*by, "src", "dst"), nodes, ["energy"], by)
    near = ends.groupBy(*by, F.col("src").alias("idx"), "a_energy").agg(F.min("b_energy").alias("lo"), F.max("b_energy").alias("hi"))
    kind = F.when(F.col("lo") >= F.col("a_energy"), "minimum").when(F.col("hi") <= F.col("a_energy"), "maximum").otherwise("saddle")
    return near.select(*by, "idx", kind.alias("kind"))


def persistence_pairs(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, birth_node, death_node, birth, death, persistence): 0-dimensional lower-star persistence.

    Nodes enter by (energy, node); where components meet all but the oldest die. A node that enters next
    to an older component dies at once: its pair has persistence 0. A graph without edges has no pairs.
    """

    def kernel(own: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["energy", "idx"]).reset_index(drop=True)
        ids, u, v, _ = coded(own, e)
        rank = np.empty(len(ids), np.int64)
        rank[np.searchsorted(ids, own["idx"])] = np.arange(len(ids))  # nodes by their place in the order
        u, v = rank[u], rank[v]
        late, early = np.maximum(u, v)[u != v], np.minimum(u, v)[u != v]
        by_late = np.lexsort((early, late))
        late, early = late[by_late].tolist(), early[by_late].tolist()
        root = list(range(len(ids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        born, died = [], []
        for x, y in zip(late, early):
            p, q = top(x), top(y)
            if p != q:
                old, young = min(p, q), max(p, q)
                root[young] = old
                born.append(young)
                died.append(x)
        node, energy = own["idx"].to_numpy(np.int64), own["energy"].to_numpy(float)
        return pd.DataFrame({"birth_node": node[born], "death_node": node[died], "birth": energy[born], "death": energy[died], "persistence": energy[died] - energy[born]})

    schema = "birth_node BIGINT, death_node BIGINT, birth DOUBLE, death DOUBLE, persistence DOUBLE"
    return solve(nodes.select(graph, "idx", "energy"), edges.select(graph, "src", "dst"), [graph], kernel, schema, L.persistence)


def cycle_summary(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, components, cyclic, largest): strongly connected components, those beyond one node, the largest."""

    def kernel(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, u, v, _ = coded(nodes, e)
        sizes = _strong_sizes(len(ids), u.tolist(), v.tolist())
        return pd.DataFrame({"components": [len(sizes)], "cyclic": [sum(s > 1 for s in sizes)], "largest": [max(sizes)]})

    def loop(nodes: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
        return L.strong_sizes(e, by).groupBy(*by).agg(F.count("*").alias("components"), F.sum((F.col("size") > 1).cast("bigint")).alias("cyclic"), F.max("size").alias("largest"))

    e = edges.select(graph, "src", "dst")
    return solve(_ends_of(e, [graph], "src", "dst"), e, [graph], kernel, "components BIGINT, cyclic BIGINT, largest BIGINT", loop)


def _strong_sizes(n: int, u: list[int], v: list[int]) -> list[int]:
    """Sizes of the strongly connected components, depth first without recursion."""
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(u, v):
        out[a].append(b)
    index, low, on, stack, sizes, count = [-1] * n, [0] * n, [False] * n, [], [], 0
    for s in range(n):
        if index[s] >= 0:
            continue
        work = [(s, 0)]
        while work:
            x, i = work.pop()
            if i == 0:
                index[x] = low[x] = count
                count += 1
                stack.append(x)
                on[x] = True
            deeper = False
            while i < len(out[x]):
                y = out[x][i]
                i += 1
                if index[y] < 0:
                    work += [(x, i), (y, 0)]
                    deeper = True
                    break
                if on[y]:
                    low[x] = min(low[x], index[y])
            if deeper:
                continue
            if low[x] == index[x]:
                size = 0
                while True:
                    y = stack.pop()
                    on[y] = False
                    size += 1
                    if y == x:
                        break
                sizes.append(size)
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
    return sizes


def hodge_split(flows: DataFrame, graph: str, tolerance: float = 1e-10, rounds: int = 20_000) -> DataFrame:
    """(graph, i, j, flow, gradient, cyclic): flows on pairs split into a gradient and a cyclic part.

    The potential is the least-squares solution of B phi = f by conjugate gradients on the graph
    Laplacian from zero, which stays in the range of a singular Laplacian; not to reach the
    tolerance within ``rounds`` is an error.
    """

    def kernel(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, i, j, _ = coded(nodes, e, "i", "j")
        f = e["flow"].to_numpy(float)
        phi = potential(i, j, f, len(ids), tolerance, rounds)
        return e.assign(gradient=phi[j] - phi[i], cyclic=f - (phi[j] - phi[i]))

    def loop(nodes: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
        phi = L.potentials(e, by, tolerance, rounds)
        for end in ("i", "j"):
            e = e.join(phi.select(*by, F.col("n").alias(end), F.col("x").alias(f"_{end}")), [*by, end])
        gradient = F.col("_j") - F.col("_i")
        return e.select(*by, "i", "j", "flow", gradient.alias("gradient"), (F.col("flow") - gradient).alias("cyclic"))

    e = flows.select(graph, "i", "j", "flow")
    return solve(_ends_of(e, [graph], "i", "j"), e, [graph], kernel, "i BIGINT, j BIGINT, flow DOUBLE, gradient DOUBLE, cyclic DOUBLE", loop)


def potential(i: np.ndarray, j: np.ndarray, f: np.ndarray, n: int, tolerance: float = 1e-10, rounds: int = 20_000) -> np.ndarray:
    """Conjugate gradients on the Laplacian of the pairs."""

    def times(x: np.ndarray) -> np.ndarray:
        d = x[j] - x[i]
        return np.bincount(j, d, n) - np.bincount(i, d, n)

    b = np.bincount(j, f, n) - np.bincount(i, f, n)
    x, r = np.zeros(n), b.copy()
    p, rr = r.copy(), r @ r
    stop = tolerance * tolerance * max(rr, 1e-300)
    for _ in range(rounds):
        if rr <= stop:
            return x
        ap = times(p)
        a = rr / max(p @ ap, 1e-300)
        x += a * p
        r -= a * ap
        new = r @ r
        p = r + (new / rr) * p
        rr = new
    raise RuntimeError(f"flows not resolved after {rounds} rounds")


def cyclic_fraction(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of squared flow that no potential explains."""
    return split.groupBy(*by).agg((F.sum(F.col("cyclic") ** 2) / (F.sum(F.col("flow") ** 2) + 1e-12)).alias("cyclic_fraction"), F.count("*").alias("pairs"))


def cyclic_flow_per_node(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, idx, cyclic_fraction): cyclic share of the energy of a node's pairs."""
    ends = split.select(*by, F.explode(F.array("i", "j")).alias("idx"), "cyclic", "gradient")
    c, g = F.sum(F.col("cyclic") ** 2), F.sum(F.col("gradient") ** 2)
    return ends.groupBy(*by, "idx").agg(F.when(c + g > 0, c / (c + g)).otherwise(0.0).alias("cyclic_fraction"))


def cycle_affinities(flows: DataFrame, graph: str, beta: float = 1.0) -> DataFrame:
    """(graph, cycles, rms, largest, mean): affinities 2 beta |f_ab + psi_a - psi_b| of non-tree pairs.

    The forest is breadth first, levels in order of (parent, node), from the smallest node of each
    component, which fixes the values.
    """
    schema = "cycles BIGINT, rms DOUBLE, largest DOUBLE, mean DOUBLE"

    def kernel(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, i, j, _ = coded(nodes, e, "i", "j")
        f = e["flow"].to_numpy(float)
        start, near, flow, _ = _adjacency(len(ids), i, j, f, -f)
        psi, tree = np.zeros(len(ids)), np.zeros(len(ids), np.int64) - 2
        for s in range(len(ids)):
            if tree[s] != -2:
                continue
            tree[s], level = -1, np.array([s])
            while len(level):
                at = np.concatenate([np.arange(start[a], start[a + 1]) for a in level])
                parent, child, g = np.repeat(level, start[level + 1] - start[level]), near[at], flow[at]
                new = tree[child] == -2
                child, first = np.unique(child[new], return_index=True)
                parent, g = parent[new][first], g[new][first]
                tree[child], psi[child] = parent, psi[parent] + g
                level = child
        outside = (tree[i] != j) & (tree[j] != i)
        a = 2 * beta * np.abs(f + psi[i] - psi[j])[outside]
        row = (len(a), float(np.sqrt((a * a).mean())), float(a.max()), float(a.mean())) if len(a) else (0, 0.0, 0.0, 0.0)
        return pd.DataFrame([row], columns=["cycles", "rms", "largest", "mean"])

    def loop(nodes: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
        a = L.affinities(e, by, beta).groupBy(*by).agg(F.count("*").alias("cycles"), F.sqrt(F.avg(F.col("affinity") ** 2)).alias("rms"), F.max("affinity").alias("largest"), F.avg("affinity").alias("mean"))
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        return nodes.select(*by).distinct().join(a, by, "left").select(*by, F.coalesce("cycles", F.lit(0)).alias("cycles"), zero("rms"), zero("largest"), zero("mean"))

    e = flows.select(graph, "i", "j", "flow")
    return solve(_ends_of(e, [graph], "i", "j"), e, [graph], kernel, schema, loop)


def _adjacency(n: int, i: np.ndarray, j: np.ndarray, there: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, neighbour, value, pair): both directions of all pairs by node, neighbours in order."""
    u, v, w, k = np.r_[i, j], np.r_[j, i], np.r_[there, back], np.r_[np.arange(len(i)), np.arange(len(i))]
    order = np.lexsort((v, u))
    return np.searchsorted(u[order], np.arange(n + 1)), v[order], w[order], k[order]


def schnakenberg(pairs: DataFrame, graph: str, top: int = 5) -> DataFrame:
    """(graph, rank, a, b, nodes, affinity, current, contribution): cycles of the chords of a minimum spanning tree.

    ``pairs``: i, j, distance, forward, backward. The tree is the minimum spanning forest by
    (distance, i, j); a chord closes the cycle of its tree path. Affinity is the sum of
    ln(forward / backward) around the cycle, a difference of heights in the tree, current the chord's net
    flux. The ``top`` cycles by absolute contribution are kept; chords alone do not add up to the whole.
    """
    schema = "rank INT, a BIGINT, b BIGINT, nodes ARRAY<BIGINT>, affinity DOUBLE, current DOUBLE, contribution DOUBLE"

    def kernel(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values(["distance", "i", "j"])
        ids, i, j, _ = coded(nodes, e, "i", "j")
        f, b = (e[c].to_numpy(float) for c in ("forward", "backward"))
        force = np.log(np.maximum(f, 1e-300) / np.maximum(b, 1e-300))
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        inner = np.zeros(len(i), bool)
        for k, (a, c) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = find(a), find(c)
            if x != y:
                root[max(x, y)] = min(x, y)
                inner[k] = True
        start, near, rise, _ = _adjacency(len(ids), i[inner], j[inner], force[inner], -force[inner])
        up, depth, height = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros(len(ids))
        for s in range(len(ids)):
            if depth[s] < 0:
                depth[s], todo = 0, [s]
                for x in todo:
                    for at in range(start[x], start[x + 1]):
                        y = near[at]
                        if depth[y] < 0:
                            depth[y], up[y], height[y] = depth[x] + 1, x, height[x] + rise[at]
                            todo.append(y)
        a, c = i[~inner], j[~inner]
        affinity, current = force[~inner] + height[a] - height[c], (f - b)[~inner]
        size = affinity * current
        rows = []
        for rank, k in enumerate(np.lexsort((c, a, -np.abs(size)))[:top], 1):
            left, right = [int(a[k])], [int(c[k])]
            while left[-1] != right[-1]:
                side = left if depth[left[-1]] >= depth[right[-1]] else right
                side.append(int(up[side[-1]]))
            way = [left[0], *(right if len(left) > 1 else right[:-1]), *left[-2:0:-1]]
            rows.append((rank, int(ids[a[k]]), int(ids[c[k]]), [int(ids[x]) for x in way], float(affinity[k]), float(current[k]), float(size[k])))
        return pd.DataFrame(rows, columns=["rank", "a", "b", "nodes", "affinity", "current", "contribution"])

    e = pairs.select(graph, "i", "j", "distance", "forward", "backward")
    return solve(_ends_of(e, [graph], "i", "j"), e, [graph], kernel, schema, lambda nodes, e, by: L.cycle_currents(e, by, top))


def propagate_energy(sources: DataFrame, edges: DataFrame, graph: str, temperature: float = 1.0, max_paths: int = 16) -> DataFrame:
    """(graph, idx, energy, reached): free energy -T ln <exp(-W/T)> over path works from the sources.

    Level-synchronous: in every round the nodes improved in the round before send their path works
    along their out-edges in the order of (source, work); a node holds the first ``max_paths``
    works that come and none is replaced, so the rounds end by themselves, when no energy falls,
    also on cycles of negative work. Nodes not reached have the greatest finite energy of the graph.
    """

    def kernel(first: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        start = set(first["idx"].astype("int64").tolist())
        real = e.sort_values(["src", "work", "dst"])
        out: dict = {}
        for u, v, w in zip(real["src"].astype("int64"), real["dst"].astype("int64"), real["work"]):
            out.setdefault(u, []).append((v, w))
        works = {s: [0.0] for s in start}
        energy = {s: 0.0 for s in start}
        front = sorted(start)
        while front:
            came: dict = {}
            for u in front:
                for v, w in out.get(u, ()):
                    xs = came.setdefault(v, [])
                    xs.extend(x + w for x in works[u][: max_paths - len(xs)])
            front = []
            for v, xs in sorted(came.items()):
                if v in start or len(held := works.setdefault(v, [])) >= max_paths:
                    continue
                held.extend(xs[: max_paths - len(held)])
                a = -np.array(held) / temperature
                x = -temperature * (a.max() + np.log(np.exp(a - a.max()).mean()))
                if v not in energy or x < energy[v] - 1e-10:
                    energy[v] = x
                    front.append(v)
        nodes = sorted({*real["src"].astype("int64"), *real["dst"].astype("int64"), *start})
        worst = max(energy.values(), default=0.0)
        return pd.DataFrame({"idx": nodes, "energy": [float(energy.get(x, worst)) for x in nodes], "reached": [x in energy for x in nodes]})

    e = edges.select(graph, "src", "dst", "work")
    return solve(sources.select(graph, "idx"), e, [graph], kernel, "idx BIGINT, energy DOUBLE, reached BOOLEAN", lambda s, e, by: L.path_energies(s, e, by, temperature, max_paths))


def multi_source_energy(edges: DataFrame, graph: str, temperature: float = 1.0, max_paths: int = 16) -> DataFrame:
    """(graph, idx, component, energy, covered, aligned): propagation from one source of every component at once.

    The source of a weak component is its node of most out-edges, of equal ones the smallest. Nodes that
    no path covers have energy 0 and ``covered`` false; ``aligned`` tells that the graph has several components.
    """
    from fellscape.operators.fixpoint import weak_components

    comp = cut(weak_components(edges.select(graph, "src", "dst"), [graph]))
    degree = edges.groupBy(graph, F.col("src").alias("idx")).agg(F.count("*").alias("n"))
    ranked = comp.join(degree, [graph, "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = ranked.groupBy(graph, "component").agg(F.max(F.struct("n", (-F.col("idx")).alias("k"))).alias("m")).select(graph, (-F.col("m.k")).alias("idx"))
    met = propagate_energy(first, edges, graph, temperature, max_paths).join(comp, [graph, "idx"])
    many = comp.groupBy(graph).agg((F.min("component") != F.max("component")).alias("aligned"))
    return met.join(many, graph).select(graph, "idx", "component", F.when(F.col("reached"), F.col("energy")).otherwise(0.0).alias("energy"), F.col("reached").alias("covered"), "aligned")
