"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_unique


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index connected with each of n indexes by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """One step. Edges are (u, v) with u > v, `size` of them. Each node's neighbours link to the least node it sees."""
    both, n = edges, size
    if large:
        both, n = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * size
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
    linked = with_unique(both, least, "u", n)
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge to another node.

    Edges may repeat, point either way, loop or hold nulls (loops and nulls are left out); without edges the result is
    empty. A node's neighbours are never gathered: the minimum is a partial aggregate, and where a node has many edges it
    is broadcast to them. Each round is written to the shared folder; rounds end when the edge set no longer changes,
    compared by its count and an order-free hash.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))
    )
    now, seen = materialize(now.distinct(), "edges"), None
    size = now.count()
    while size:
        # A step never adds edges, so the size before both will do to tell what is hot.
        half = materialize(_star(now, True, size), "edges")
        now = materialize(_star(half, False, size), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if state == seen:
            break
        seen, size = state, state[0]
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component")).distinct()


def labelled(nodes: DataFrame, edges: DataFrame, key: str, rep: str) -> DataFrame:
    """nodes (unique by key) with `c`, the key of the least key reachable by edges (a, b), and `least`, the least rep there."""
    merged = connected_components(edges)
    known = nodes.join(merged, nodes[key] == merged["node"], "left").drop("node")
    known = materialize(known.withColumn("c", F.coalesce("component", key)).drop("component"), "labelled")
    of = known.groupBy("c").agg(F.min(rep).alias("least"), F.count("*").alias("rows"))
    return with_unique(known, materialize(of, "least"), "c", known.count())
