"""Connected components of a graph given by its edges, without a driver-side graph.

Each round contracts locally first: every task merges the edges it holds, at most ``CHUNK``,
with a union-find and hands on a star per local component (a node and its smallest reachable
node). Where several tasks were needed, the stars run through alternating large-star and
small-star steps, which need grouped minima and an equi-join only, and are contracted again,
until one task holds all that is left or nothing changes. Hot nodes (the centre
of a star with a third of all nodes) meet partial aggregation in the minimum and a
splittable sort-merge join in the step that hands the minimum back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import discard, materialise, prepare

#: Edges that a task merges at once; more edges go through in pieces of this size.
CHUNK = 1 << 18


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but the smallest ones."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if not (lo != hi).any():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def emit() -> pa.RecordBatch:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        u, v = local_stars(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count >= CHUNK:
            yield emit()
            held, count = [], 0
    if held:
        yield emit()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour of a node to the least node around it.
    Small star: link the node and its smaller neighbours to the least of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """n edges in as few tasks as ``CHUNK`` allows, each contracted to its stars."""
    return edges.coalesce(n // CHUNK + 1).mapInArrow(_contract, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, v (longs, null-free) -> (node, component): component is the least node
    reachable. Nodes without an edge to another node are not listed. An empty graph gives
    an empty result; loops and repeated edges change nothing."""
    prepare(edges.sparkSession)
    stars = materialise(edges.filter("u <> v").distinct(), "edges")
    named = lambda df: df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        n, before = stars.count(), stars
        stars = materialise(_contracted(before, n).distinct(), "stars")
        discard(before)
        if n < CHUNK:  # one task has seen all edges
            return named(stars)
        # done when every node hangs on one node, and no centre hangs on another
        loose = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not loose and not stars.join(stars.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return named(stars)
        before, stars = stars, materialise(_star(_star(stars, True), False), "stars")
        discard(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
