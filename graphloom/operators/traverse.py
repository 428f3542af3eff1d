"""Impact and shortest paths: level-synchronous breadth-first search.

A level is a join of the frontier with the edges, an anti-join with what was visited, and a minimum per new
node in queue order (place of the parent in its level, then edge order); so the dependency reported for a
node is the one that a queue would have found first. Places number the frontier alone.

Edges are partitioned by the end that frontiers are joined to, once. A frontier that is counted to be small is
broadcast, so that its level moves no edges; a larger one is shuffled to the edges' partitions and numbered by ranges.
Every level is checkpointed, so plans stay short and a lost executor costs no more than a level; the numbers of a small one
are worked out again instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators.checkpoints import cut, kept, numbered, small
from graphloom.operators.graph import key


def call_links(edges: DataFrame, resolution: str) -> DataFrame:
    """``source, target`` node keys of call edges with their evidence; ambiguous ones by candidate."""
    e = edges.where((F.col("kind") == "calls") & (F.col("resolution") == resolution) & F.col("source_symbol").isNotNull())
    if resolution == "ambiguous":
        e = e.withColumn("target_symbol", F.explode(F.transform("candidates", lambda c: c.target_symbol)))
    place = F.struct(F.col("source_path").alias("a"), F.col("evidence.start_byte").alias("b"), F.col("target_text").alias("c"), F.col("evidence.end_byte").alias("d"))
    order = F.struct(F.col("source_symbol.path").alias("p"), F.col("source_symbol.start_byte").alias("s"), F.col("source_symbol.qualified_name").alias("q"), place.alias("e"))
    return e.select(key("source_symbol").alias("source"), key("target_symbol").alias("target"), order.alias("edge"), "source_symbol", "target_symbol", "resolution", "confidence", "provenance", "evidence", F.lit("calls").alias("relationship"), F.lit("symbol").alias("node_kind"))


def include_links(edges: DataFrame, resolution: str) -> DataFrame:
    e = edges.where((F.col("kind") == "includes") & (F.col("resolution") == resolution))
    if resolution == "ambiguous":
        e = e.withColumn("target_path", F.explode(F.transform("candidates", lambda c: c.target_path)))
    place = F.struct(F.col("source_path").alias("a"), F.col("evidence.start_byte").alias("b"), F.col("target_text").alias("c"), F.col("evidence.end_byte").alias("d"))
    order = F.struct(F.col("source_path").alias("p"), F.lit(0).alias("s"), F.lit("").alias("q"), place.alias("e"))
    none = F.lit(None).cast("struct<path:string,qualified_name:string,role:string,start_byte:int>")
    return e.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), order.alias("edge"), none.alias("source_symbol"), none.alias("target_symbol"), "resolution", "confidence", "provenance", "evidence", F.lit("includes").alias("relationship"), F.lit("file").alias("node_kind"))


PROOF = ["node_kind", "source_symbol", "target_symbol", "relationship", "confidence", "provenance", "evidence"]


def impact(resolved: DataFrame, ambiguous: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who depends on the seeds (``node, pos``): confirmed over resolved edges, possible over one ambiguous edge more.

    Both have ``node, dependency, depth`` and the edge that proves them. A node confirmed is never only possible,
    and possible nodes are not searched from.
    """
    resolved = cut(resolved.repartition("target"))
    visited = cut(seeds.select("node", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("depth")))
    n = reached = visited.count()
    levels, depth = [], 0
    frontier = visited
    while True:
        depth += 1
        into = resolved.join(small(frontier.select(F.col("node").alias("target"), F.col("pos").alias("parent")), n), "target").join(small(visited.select(F.col("node").alias("source")), reached), "source", "left_anti")
        best = into.withColumn("_rank", F.struct("parent", "edge")).groupBy("source").agg(F.min_by(F.struct("target", "parent", "edge", *PROOF), "_rank").alias("b"))
        new = cut(best.select(F.col("source").alias("node"), F.col("b.target").alias("dependency"), "b.*").withColumn("depth", F.lit(depth)))
        n = new.count()
        new = numbered(new, ["parent", "edge", "node"], n)
        if not n:
            break
        levels.append(new)
        frontier = kept(new.select("node", "pos", "depth"), n)
        visited, reached = visited.unionByName(frontier), reached + n
        if depth % 8 == 0:
            visited = cut(visited)
    shape = new  # empty, with the columns
    for level in levels:
        shape = shape.unionByName(level)
    confirmed = shape.select("node", "dependency", "depth", *PROOF)
    near = ambiguous.join(visited.select(F.col("node").alias("target"), "pos", "depth"), "target").join(visited.select(F.col("node").alias("source")), "source", "left_anti")
    best = near.withColumn("_rank", F.struct("depth", "pos", "edge")).groupBy("source").agg(F.min_by(F.struct("target", "depth", *PROOF), "_rank").alias("b"))
    possible = best.select(F.col("source").alias("node"), F.col("b.target").alias("dependency"), (F.col("b.depth") + 1).alias("depth"), *[F.col(f"b.{c}").alias(c) for c in PROOF])
    return confirmed, possible


def impact_order() -> list[Column]:
    name = F.coalesce("source_symbol.qualified_name", "node")
    return [F.col("depth"), s.ordinal(F.col("node_kind"), s.NODE_KINDS), name, F.coalesce("source_symbol.path", "node"), F.col("evidence.start_line"), F.col("evidence.start_column")]


def _adjacency() -> Column:
    """Order in which a node's outgoing edges are tried."""
    return F.struct(
        s.ordinal(F.col("resolution"), s.RESOLUTIONS).alias("a"), F.col("target_symbol.qualified_name").alias("b"), F.col("target_symbol.path").alias("c"), F.col("target_symbol.start_byte").alias("d"),
        F.col("evidence.start_line").alias("e"), F.col("evidence.start_column").alias("f"), s.ordinal(F.col("confidence"), s.CONFIDENCES).alias("g"), F.col("provenance").alias("h"),
    )


def _search(links: DataFrame, source: str, target: str) -> list[dict] | None:
    """Steps of the shortest path, None if there is none."""
    spark = links.sparkSession
    links = cut(links.withColumn("_order", _adjacency()).repartition("source"))
    visited = frontier = spark.createDataFrame([(source, 1)], "node string, pos long")
    n = reached = 1
    parents: list[DataFrame] = []
    while True:
        out = links.join(small(frontier.select(F.col("node").alias("source"), "pos"), n), "source").join(small(visited.select(F.col("node").alias("target")), reached), "target", "left_anti")
        best = out.withColumn("_rank", F.struct("pos", "_order")).groupBy("target").agg(F.min_by(F.struct("source", "_rank", "source_symbol", "target_symbol", "resolution", "confidence", "provenance", "evidence"), "_rank").alias("b"))
        new = cut(best.select(F.col("target").alias("node"), "b.*"))
        n, found = new.agg(F.count("*"), F.count_if(F.col("node") == target)).first()
        if not n:
            return None
        parents.append(new)
        if found:
            break
        frontier = kept(numbered(new, ["_rank", "node"], n).select("node", "pos"), n)
        visited, reached = visited.unionByName(frontier), reached + n
        if len(parents) % 8 == 0:
            visited = cut(visited)
    steps, at = [], target
    for level in reversed(parents):  # one row of each level
        row = level.where(F.col("node") == at).select("node", "source", "source_symbol", "target_symbol", "resolution", "confidence", "provenance", "evidence").first().asDict(True)
        steps.append(row)
        at = row["source"]
    return steps[::-1]


def shortest_path(edges: DataFrame, source: str, target: str) -> tuple[str, list[dict]]:
    """(status, steps): over resolved calls alone if possible, else with ambiguous ones too."""
    if source == target:
        return "confirmed", []
    resolved = call_links(edges, "resolved")
    steps = _search(resolved, source, target)
    if steps is not None:
        return "confirmed", steps
    steps = _search(resolved.unionByName(call_links(edges, "ambiguous")), source, target)
    return ("not_found", []) if steps is None else ("possible", steps)
