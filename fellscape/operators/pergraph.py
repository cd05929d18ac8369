"""Graphs by size: those that fit a task are solved in one, larger ones by joins over all executors.

An iterative operator has a numpy kernel of one graph and a loop of joins that gives the same values.
Graphs of up to ``TASK_EDGES`` edges are groups of a cogrouped kernel, many graphs in parallel; a
graph beyond that never enters a task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.session import cut

#: Edges of a graph that a task may hold (a few numbers each).
TASK_EDGES = 4_000_000


def solve(nodes: DataFrame, edges: DataFrame, by: Sequence[str], kernel: Callable, schema: str, loop: Callable) -> DataFrame:
    """(by, ``schema``) of every graph with nodes, by ``kernel`` or, beyond ``TASK_EDGES`` edges, by ``loop``.

    ``kernel`` takes the nodes and the edges of one graph as pandas frames, without the ``by`` columns,
    and returns the columns of ``schema``; ``loop`` takes (nodes, edges) of all large graphs. Without
    ``by`` all rows are one graph. Null ``by`` columns are no graph.
    """
    named = list(by)
    if not named:
        nodes, edges = nodes.withColumn("_graph0", F.lit(0)), edges.withColumn("_graph0", F.lit(0))
    # names that clash with no column of an operator
    by = [f"_graph{i}" for i in range(max(1, len(named)))]
    nodes, edges = (d.withColumnsRenamed(dict(zip(named, by))) for d in (nodes, edges))
    nodes, edges = nodes.dropna(subset=by), cut(edges.dropna(subset=by))
    large = cut(edges.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_EDGES).select(*by))
    some = not large.isEmpty()
    small = [d.join(F.broadcast(large), by, "left_anti") if some else d for d in (nodes, edges)]  # at most a graph per TASK_EDGES edges
    kinds = ", ".join(f"`{b}` {nodes.schema[b].dataType.simpleString()}" for b in by)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = kernel(n.drop(columns=by), e.drop(columns=by))[names]
        for i, (b, k) in enumerate(zip(by, key)):
            out.insert(i, b, k)
        return out

    got = small[0].groupBy(*by).cogroup(small[1].groupBy(*by)).applyInPandas(run, f"{kinds}, {schema}")
    if some:
        got = got.unionByName(loop(*(d.join(F.broadcast(large), by, "left_semi") for d in (nodes, edges)), by).select(*by, *names))
    return got.withColumnsRenamed(dict(zip(by, named))) if named else got.drop(*by)


def coded(nodes: pd.DataFrame, edges: pd.DataFrame, src: str = "src", dst: str = "dst", key: str = "idx") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, u, v, known): sorted node ids, the ends of the edges as positions in them, and which edges have both."""
    ids = np.unique(nodes[key].to_numpy(np.int64))
    ends = []
    known = np.ones(len(edges), bool)
    for c in (src, dst):
        x = edges[c].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
        known &= (ids[at] == x) if len(ids) else np.zeros(len(x), bool)
        ends.append(at)
    return ids, ends[0][known], ends[1][known], known
