"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into SEGMENTS equal segments; each segment indexes the rows by its value. A query probes, round
by round, one more segment at one more radius: all values at exactly that distance from its own segment's
value. After segments 0..j are done at radius r and the others at r - 1, every code within SEGMENTS * r + j
bits has been a candidate, as a code further off in every segment would differ in more bits. A query ends
when its kth verified distance is at most that bound. Ties are broken by id, so the answer is unique.

Distinct codes are dealt over ranges; a task builds a range's index once and all queries stream past it, BLOCK answers
at a time; the k best of the ranges are then merged. Equal codes are one index entry with their k
least ids, found by a window that keeps k rows per task and code before the shuffle, and equal queries are
answered once. So neither hot codes nor many equal vectors multiply work, and a task's memory is bounded by a
range of codes and a block of answers.

Defined cases: null vectors and ids are neither rows nor queries; shorter vectors have zero bits at the end and
bits beyond BITS are not taken; with fewer than k rows all are returned; repeated rows count each; an empty table gives an
empty result; other columns are ignored, whatever their names. A query finds itself too, as it is one of the rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

BITS, SEGMENTS, K = 64, 4, 10
#: Ids divisible by this are queries.
EVERY = 50
#: Queries answered at once and distinct codes of a range; ranges are not split below LEAST codes.
BLOCK, RANGE, LEAST = 2048, 200_000, 5000


def codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``id, code``: bit i is set where component i is positive."""
    bits = F.expr(f"aggregate(transform(slice({vector}, 1, {BITS}), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), bits.alias("code"))


class Index:
    """Multi-index over sorted distinct codes."""

    def __init__(self, code: np.ndarray):
        self.code, self.width = code, BITS // SEGMENTS
        self.order, self.at = [], []
        for s in range(SEGMENTS):
            value = self.segment(code, s)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.at.append(np.searchsorted(value[order], np.arange((1 << self.width) + 1)))
        self.masks = [np.array([sum(1 << b for b in some) for some in combinations(range(self.width), r)], np.int64) for r in range(self.width + 1)]

    def segment(self, code: np.ndarray, s: int) -> np.ndarray:
        return (code >> np.uint64(s * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def probe(self, query: np.uint64, s: int, radius: int) -> np.ndarray:
        """Entries whose segment s is at exactly this distance from the query's."""
        value = int(self.segment(np.array([query], np.uint64), s)[0]) ^ self.masks[radius]
        a, b = self.at[s][value], self.at[s][value + 1]
        some = b > a
        a, n = a[some], (b - a)[some]
        ends = np.cumsum(n)
        return self.order[s][np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def search(self, query: np.uint64, k: int, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (distance, id); ``ids[offsets[i]:offsets[i + 1]]`` are the least ids of entry i."""
        seen = np.zeros(len(self.code), bool)
        entries, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        weight = np.diff(offsets)
        for radius in range(self.width + 1):
            for s in range(SEGMENTS):
                got = self.probe(query, s, radius)
                got = got[~seen[got]]
                if len(got):
                    seen[got] = True
                    entries.append(got)
                    distances.append(np.bitwise_count(self.code[got] ^ query).astype(np.int64))
                covered = SEGMENTS * radius + s
                near = np.concatenate(distances) <= covered
                if weight[np.concatenate(entries)[near]].sum() >= k:
                    return self.best(np.concatenate(entries)[near], np.concatenate(distances)[near], k, ids, offsets)
        return self.best(np.concatenate(entries), np.concatenate(distances), k, ids, offsets)

    @staticmethod
    def best(entries: np.ndarray, distances: np.ndarray, k: int, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = offsets[entries + 1] - offsets[entries]
        ends = np.cumsum(n)
        own = ids[np.repeat(offsets[entries] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        far = np.repeat(distances, n)
        order = np.lexsort((own, far))[:k]
        return far[order], own[order]


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, distance`` for queries and rows of ``id, code``."""
    spark = rows.sparkSession
    common.ship(spark)
    # the k least ids of each code; the row number's limit is applied in every task before the shuffle
    least = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("_n") <= k)
    entries = common.materialize(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = common.materialize(queries.select("code").distinct(), "asked")
    n_entries = entries.count()
    ranges = max(1, -(-n_entries // RANGE), min(common.parts(spark), n_entries // LEAST))
    own = entries.select(F.pmod(F.xxhash64("code"), F.lit(ranges)).cast("int").alias("range"), F.lit(0).alias("kind"), "code", "ids")
    to_all = asked.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), F.lit(1).alias("kind"), "code", F.lit(None).cast("array<bigint>").alias("ids"))

    @common.tidy
    def run(batches):
        at, parts, index, ids, offsets = None, [], None, None, None
        for b in batches:
            place, kind = (b.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(place * 2 + kind)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                if place[i] != at:
                    at, parts, index = place[i], [], None
                some = b.slice(i, j - i)
                if not kind[i]:
                    parts.append(some)
                    continue
                if index is None and parts:
                    lists = pa.concat_arrays([p.column(3) for p in parts])
                    offsets, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
                    index = Index(pa.concat_arrays([p.column(2) for p in parts]).to_numpy().view(np.uint64))
                    parts = []
                if index is None:
                    continue  # no codes in this range
                asks = some.column(2).to_numpy()
                for k0 in range(0, len(asks), BLOCK):
                    out = [(np.full(len(far), q), far, near) for q in asks[k0 : k0 + BLOCK] for far, near in (index.search(q.view(np.uint64), k, ids, offsets),)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["code", "distance", "vec_id"])

    # a range's codes come before the queries, which stream past its index
    both = own.unionByName(to_all).repartition(ranges, "range").sortWithinPartitions("range", "kind")
    found = both.mapInArrow(run, "code long, distance long, vec_id long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id")).cast("long")).where(F.col("rank") <= k)
    answers = found.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("_a"))
    return queries.select(F.col("id").alias("query_id"), "code").join(answers, "code").select("query_id", F.inline("_a"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.col("id") % EVERY == 0))


OP6_SQL = f"""
WITH bits AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL
), codes AS (
  SELECT vec_id, bit_or(CASE WHEN x > 0 AND i <= {BITS} THEN CAST(1 AS UBIGINT) << CAST(i - 1 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS code FROM bits GROUP BY vec_id
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(bit_count(xor(q.code, r.code)) AS BIGINT) AS distance FROM codes q CROSS JOIN codes r WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {K}
"""
