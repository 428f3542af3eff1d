"""Connected components of large graphs: alternating large-star and small-star steps on edge tables.

A round costs shuffles of the edges only, never a path's or a component's nodes in one task; the number of rounds grows
with the logarithm of the nodes. Every round is written to the shared folder.

Defined cases: an empty table has no components; links from a node to itself, repeated ones and the two directions of
one link change nothing; nodes without links do not appear; links with a null end are left out; ids may be of any
type that has an order, and the least id of a component is its root.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links u-v: each linked node but the roots, and the least node of its component (the root)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # hook roots onto smaller ones, then shorten
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable id -> ``node, root``: the least node of each linked node's component.

    Each round costs shuffles of the edges only; every round's edges are written to the shared folder, so a
    lost executor costs no more than that round. Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    edges = common.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: link every larger neighbour of u to the least node around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, common.materialize(small, "edges")
        common.discard(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
