"""Near copies by five-word shingles: candidates from MinHash bands, confirmed by the exact Jaccard similarity.

Texts with equal sets of shingles are one node. A node has BANDS keys of ROWS minima each; a pair of similarity
0.8 shares one of them with probability 0.99997. In the bucket of a key the nodes stand in the order of their
further keys, and each is paired with the NEIGHBOURS after it and with the bucket's most popular node (that whose
keys most other nodes share), so that a bucket of any size gives pairs in proportion to it. A pair is a link if
the sets' similarity, counted over the whole sets, is at least 4 / 5.

Buckets of up to NEIGHBOURS + 1 nodes are then compared in full. Larger ones whose nodes these links do not all join are
compared in full as well: in order of what they are joined to so far, nodes stand in blocks of bounded size, and a
task compares two blocks by one product of their incidence matrices, but for blocks that are of one class already;
it returns a spanning forest of its links. So every pair that shares a key is a link or joined by others. Classes are
the components of all links.

Defined cases: a null text or one without words is no copy of anything; a text of fewer words than a shingle has
one shingle of all its words; repeated keys are one row; very long texts are whole sets, and blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.components import components, forest

SEED = 42
SHINGLE, BANDS, ROWS, NEIGHBOURS = 5, 20, 4, 8
CHUNK_BYTES = 4_000_000
#: Nodes and shingles of a block (or one larger set), and columns of a matrix at a time.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 256, 400_000, 8192
#: Copies of a popular node's set, so that its pairs are spread over tasks.
SALTS = 32
#: Candidates up to which their keys are broadcast to find the texts; beyond, texts are joined by shuffle.
BROADCAST_KEYS = 500_000

_RNG = np.random.default_rng(SEED)
PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
FLIPS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each whole text, ascending: ``hashes[starts[i]:starts[i + 1]]``."""
    flat, owner = common.split_words(pc.ascii_lower(texts))
    n = len(texts)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = np.array([xxhash.xxh64_intdigest(w.as_buffer(), SEED) for w in coded.dictionary], np.uint64)
    word = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    last = np.cumsum(np.bincount(owner, minlength=n))
    per = np.diff(last, prepend=0)
    count = np.where(per == 0, 0, np.maximum(per - SHINGLE + 1, 1))
    ends = np.cumsum(count)
    of = np.repeat(np.arange(n), count)
    at = np.repeat(last - per - (ends - count), count) + np.arange(len(of))
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(of), np.uint64)
    for j in range(SHINGLE):
        h = common.mix64(h + np.where(at + j < last[of], padded[at + j], np.uint64(0)) * PLACES[j])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys of each set; none may be empty."""
    out = np.empty((len(starts) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(out), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = common.mix64(key ^ np.minimum.reduceat((hashes ^ FLIPS[k]) * FACTORS[k], starts[:-1]))
        out[:, b] = key
    return out


def nodes_of(docs: DataFrame) -> DataFrame:
    """``key, text`` -> ``key, node, bands`` of the rows with words."""

    @common.tidy
    def run(batches):
        for keys, texts in common.chunks(batches, CHUNK_BYTES):
            h, starts = shingle_sets(texts)
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                begins = np.append(starts[some], len(h))
                node = common.mix64(np.add.reduceat(common.mix64(h), begins[:-1]) + np.diff(begins).astype(np.uint64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(band_keys(h, begins).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array(node.view(np.int64)), bands], names=["key", "node", "bands"])

    common.ship(docs.sparkSession)
    return docs.select("key", F.col("text").cast("string")).mapInArrow(run, "key long, node long, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """``node, text`` -> ``node, shingles`` (distinct hashes)."""

    @common.tidy
    def run(batches):
        for keys, texts in common.chunks(batches, CHUNK_BYTES):
            h, starts = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "shingles"])

    return docs.select("node", F.col("text").cast("string")).mapInArrow(run, "node long, shingles array<long>")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, bands`` of distinct nodes -> distinct pairs ``u, v, hub`` (v is a popular node if hub is set), and the
    nodes of shared buckets, ``bucket, node, n``, n being the bucket's size.
    """
    each = common.materialize(nodes.select("node", F.posexplode("bands").alias("band", "bucket"), "bands").select("node", "bucket", F.element_at("bands", (F.pmod(F.col("band") + 1, F.lit(BANDS)) + 1).cast("int")).alias("next"), F.element_at("bands", (F.pmod(F.col("band") + 2, F.lit(BANDS)) + 1).cast("int")).alias("then")), "bands")
    full = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    each = common.materialize(each.join(full, "bucket"), "buckets")
    fame = each.groupBy("node").agg(F.sum("n").alias("fame"))
    hubs = each.where(F.col("n") > NEIGHBOURS + 1).join(fame, "node").groupBy("bucket").agg(F.max(F.struct("fame", "node"))["node"].alias("hub"))
    to_hub = each.where(F.col("n") > NEIGHBOURS + 1).join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    after = F.collect_list("node").over(Window.partitionBy("bucket").orderBy("next", "then", "node").rowsBetween(1, NEIGHBOURS))
    near = each.select("node", after.alias("others")).select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    return near.distinct().withColumn("hub", F.lit(False)).unionByName(to_hub.distinct().withColumn("hub", F.lit(True))), each.select("bucket", "node", "n")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets' similarity is at least 4 / 5."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    other = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    few = other.join(pairs.where("hub").select("v").distinct(), "v", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = one.where("not hub").join(other, "v").select("u", "v", "a", "b").unionByName(one.where("hub").withColumn("salt", F.pmod(F.hash("u"), F.lit(SALTS))).join(few, ["v", "salt"]).select("u", "v", "a", "b"))
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def block_links(table: pa.Table) -> pa.Table:
    """Spanning forest of the links between two blocks of nodes (or inside one), of different classes so far."""
    node, root = (table[c].combine_chunks().to_numpy() for c in ("node", "root"))
    second = table["second"].combine_chunks().to_numpy(zero_copy_only=False)
    lists = table["shingles"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(node)), size)
    _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    often = np.bincount(token) > 1  # the others are in no intersection
    token, of = (np.cumsum(often) - 1)[token[often[token]]], of[often[token]]
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if second.any() else left
    row_of, column_of = np.full(len(node), -1), np.full(len(node), -1)
    row_of[left], column_of[right] = np.arange(len(left)), np.arange(len(right))
    common_shingles = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        i, j = np.searchsorted(token, [at, at + COLUMNS])
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        mine, other = row_of[of[i:j]] >= 0, column_of[of[i:j]] >= 0
        a[row_of[of[i:j][mine]], token[i:j][mine] - at] = 1
        b[column_of[of[i:j][other]], token[i:j][other] - at] = 1
        common_shingles += a @ b.T
    near = (9 * common_shingles.astype(np.int64) >= 4 * (size[left][:, None] + size[right][None, :])) & (root[left][:, None] != root[right][None, :])
    x, y = np.nonzero(near)
    u, v = forest(node[left[x]], node[right[y]])
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def rest_links(each: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside large buckets between nodes that ``roots`` does not join, from comparing their blocks in full."""
    own = each.where(F.col("n") > NEIGHBOURS + 1).join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    split = own.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("bucket")
    weight = F.greatest(F.size("shingles"), F.lit(BLOCK_SHINGLES // BLOCK_NODES)).cast("long")
    members = own.join(split, "bucket").join(sets.select("node", weight.alias("weight")), "node")
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("bucket").orderBy("root", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    members = common.materialize(members.select("bucket", "node", "root", F.floor(before / F.lit(BLOCK_SHINGLES)).alias("block")), "members")
    blocks = members.groupBy("bucket", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    one = blocks.select("bucket", F.col("block").alias("one"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    other = blocks.select("bucket", F.col("block").alias("other"), F.col("lo").alias("c"), F.col("hi").alias("d"))
    meet = one.join(other, "bucket").where("one <= other and not (a = b and c = d and a = c)").select("bucket", "one", "other")
    sent = meet.select("*", F.col("one").alias("block"), F.lit(False).alias("second")).unionByName(meet.where("one <> other").select("*", F.col("other").alias("block"), F.lit(True).alias("second")))
    sent = sent.join(members, ["bucket", "block"]).join(sets, "node").select("bucket", "one", "other", "second", "node", "root", "shingles")
    return sent.groupBy("bucket", "one", "other").applyInArrow(block_links, "u long, v long")


def copy_classes(docs: DataFrame, among: DataFrame) -> DataFrame:
    """``key, text`` and the ``key`` of the rows to compare -> ``key, root`` of those that have a near copy among them."""
    spark = docs.sparkSession
    rows = common.materialize(nodes_of(docs).join(among, "key", "left_semi"), "shingled")
    nodes = rows.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    pairs, each = candidates(nodes)
    pairs = common.materialize(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = common.materialize(rows.groupBy("node").agg(F.min("key").alias("key")).join(ends, "node"), "wanted")
    few = wanted.count() <= BROADCAST_KEYS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "key").select("node", "text")
    sets = common.materialize(sets_of(texts).dropDuplicates(["node"]), "sets")
    roots = components(links(pairs, sets))
    more = common.materialize(rest_links(each, roots, sets), "links")
    if not more.isEmpty():
        roots = components(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    # equal sets are one class even if no other is near
    named = rows.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return named.distinct()
