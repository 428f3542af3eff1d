"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has bit i set if over half of its word shingles have it in their XXH64. Equal
fingerprints are one node. To find all pairs of nodes within ``threshold`` bits, the anchors are the words of
a covering code: the product of two perfect binary Golay codes (23 bits, covering radius 3) over bits 0-22 and
23-45. A fingerprint is at home at the one anchor within the radius in both blocks, and is replicated to each
anchor within radius plus threshold (the threshold shared between the blocks). If x and y differ in at most
``threshold`` bits, y is replicated to x's home. Fingerprints are compared per anchor, over all 64 bits, only
home against all; a task returns a spanning forest of the links that it saw, never all pairs of a group, and
the forests' components are the near-duplicate classes. Replicas come to a task in the order of anchors, and it holds
some ROWS_AT_ONCE of them or one anchor's. In an anchor of FLIP_FROM fingerprints or more the same links are found by
looking up every fingerprint with up to ``threshold`` bits flipped among its members, which is linear in them.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text of fewer words than
a shingle has one shingle of all its words; repeated rows and ids come out as often as they come in; the class
id is the least id reachable, null only if every id of the class is null; other columns are ignored; very long texts
are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.components import components, forest

SEED = 42
#: Words of a shingle and differing bits of a link, as the op5 query has them.
SHINGLE, THRESHOLD = 3, 2
CHUNK_BYTES = 8_000_000
#: Pairs that a task compares at once, and members from which a bucket is searched by flipping bits instead.
PAIRS_AT_ONCE, FLIP_FROM = 2_000_000, 20_000
#: Words that are joined, and shingles that are cut out of them and hashed, at a time; bounds memory.
SHINGLES_AT_ONCE = 50_000
#: Replicas that a task gathers before it compares those of whole anchors, and nodes to a task (some 61 replicas each).
ROWS_AT_ONCE, NODES_A_TASK = 500_000, 200_000

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
LENGTH, RADIUS = 23, 3


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of each group ``hashes[starts[i]:starts[i + 1]]``: bits set in over half of it."""
    n = len(starts) - 1
    out = np.zeros(n, np.uint64)
    sizes = np.diff(starts)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    # bytes of a word count eight bits at once; at most 255 hashes are summed before they are unpacked
    pieces = -(-sizes[some] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(starts[some] - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    spread = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        counts = np.add.reduceat(spread[columns[:, j]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, first, axis=0)
        bits = (2 * counts > sizes[some][:, None]).astype(np.uint64)
        for i in range(8):
            out[some] |= bits[:, i] << np.uint64(8 * j + i)
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each whole text."""
    flat, owner = common.split_words(pc.ascii_lower(texts))
    n = len(texts)
    per = np.bincount(owner, minlength=n)
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    joined = b" ".join(b" ".join(flat[i : i + SHINGLES_AT_ONCE].cast(pa.large_binary()).to_pylist()) for i in range(0, len(flat), SHINGLES_AT_ONCE))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    last = np.cumsum(per)
    first = last - per
    # a shingle starts at every word that has enough words after it in its text; a short text has one
    count = np.where(per == 0, 0, np.maximum(per - shingle + 1, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first - starts[:-1], count) + np.arange(starts[-1])
    until = np.minimum(at + shingle - 1, np.repeat(last - 1, count))
    h, hashes = xxhash.xxh64_intdigest, np.empty(len(at), np.uint64)
    for i in range(0, len(at), SHINGLES_AT_ONCE):
        some = slice(i, i + SHINGLES_AT_ONCE)
        hashes[some] = [h(joined[a:b], SEED) for a, b in zip(begins[at[some]].tolist(), ends[until[some]].tolist(), strict=True)]
    return majority(hashes, starts)


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""
    common.ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    @common.tidy
    def run(batches):
        for keys, texts in common.chunks(batches, CHUNK_BYTES):
            out = pa.RecordBatch.from_arrays([keys, pa.array(fingerprints(texts, shingle).view(np.int64))], schema=schema)
            del keys, texts  # nothing of a chunk stays for the next one
            common.trim()
            yield out

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, fp long")


class Anchors:
    """Anchors near a fingerprint, by syndrome tables of the Golay code."""

    def __init__(self, threshold: int):
        unit = []
        for i in range(LENGTH):
            r = 1 << i
            for bit in range(LENGTH - 1, 10, -1):
                if r >> bit & 1:
                    r ^= GOLAY << (bit - 11)
            unit.append(r)
        self.low, self.high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(12):
            self.low ^= np.where(np.arange(1 << 12) >> i & 1, unit[i], 0)
        for i in range(11):
            self.high ^= np.where(np.arange(1 << 11) >> i & 1, unit[12 + i], 0)
        # error patterns of weight up to radius + threshold, by syndrome and by excess over the radius
        patterns, top = [np.zeros(1, np.int64)], [np.full(1, -1)]
        for _ in range(RADIUS + threshold):
            grown = [(p | 1 << i, np.full(len(p), i)) for i in range(LENGTH) for p in (patterns[-1][top[-1] < i],)]
            patterns.append(np.concatenate([g[0] for g in grown]))
            top.append(np.concatenate([g[1] for g in grown]))
        self.threshold, self.tables = threshold, []
        for excess in range(threshold + 1):
            p = np.concatenate(patterns[: RADIUS + 1]) if excess == 0 else patterns[RADIUS + excess]
            s = self.syndrome(p)
            order = np.argsort(s, kind="stable")
            self.tables.append((p[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))))

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        return self.low[block & 0xFFF] ^ self.high[block >> 12]

    def near(self, block: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors at radius + excess (within the radius for 0) of each block, and the block's index."""
        p, at = self.tables[excess]
        s = self.syndrome(block)
        n = at[s + 1] - at[s]
        row = np.repeat(np.arange(len(block)), n)
        ends = np.cumsum(n)
        return block[row] ^ p[np.repeat(at[s] - (ends - n), n) + np.arange(len(row))], row

    def replicate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (anchor, index of the fingerprint, is at home)."""
        one, two = (fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
        out = []
        for a in range(self.threshold + 1):
            c1, row = self.near(one, a)
            for b in range(self.threshold + 1 - a):
                c2, again = self.near(two[row], b)
                out.append((c1[again] << 23 | c2, row[again], np.full(len(again), a == b == 0)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among fingerprints that share an anchor, home against all."""
    order = np.lexsort((fp, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    length, begin = np.diff(cut)[run], cut[:-1][run]
    found_u, found_v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

    held = 0

    def keep(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal held
        if len(u):
            found_u.append(u)
            found_v.append(v)
            held += len(u)
        if held > PAIRS_AT_ONCE:
            a, b = forest(np.concatenate(found_u), np.concatenate(found_v))
            found_u[:], found_v[:], held = [a], [b], 0

    few = np.flatnonzero(home & (length > 1) & (length < FLIP_FROM))
    ends = np.cumsum(length[few])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        some = few[at:to]
        n = length[some]
        left = np.repeat(some, n)
        right = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (left != right)
        keep(fp[left[near]], fp[right[near]])
        at = to
    if (home & (length >= FLIP_FROM)).any():
        flips = [np.uint64(0)]
        for _ in range(threshold):
            flips = sorted({f ^ np.uint64(1 << i) for f in flips for i in range(64)} | set(flips))
        for r in np.unique(run[home & (length >= FLIP_FROM)]):
            members = fp[cut[r] : cut[r + 1]]  # sorted and distinct
            mine = members[home[cut[r] : cut[r + 1]]]
            for flip in flips[1:]:
                want = mine ^ flip
                where = np.minimum(np.searchsorted(members, want), len(members) - 1)
                hit = members[where] == want
                keep(mine[hit], want[hit])
    return forest(np.concatenate(found_u), np.concatenate(found_v))


def near_links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``u, v`` that connect all those within ``threshold`` bits."""

    def spread(batches):
        anchors = Anchors(threshold)
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                fp = b.column(0).slice(i, 4000).to_numpy().view(np.uint64)
                anchor, row, home = anchors.replicate(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor << 1 | home), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])

    @common.tidy
    def compare(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:  # in the order of anchors: whole anchors are compared as they come
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) < ROWS_AT_ONCE:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key >> 1, key[-1] >> 1))
            held = [(key[cut:], fp[cut:])]
            if cut:
                yield found(key[:cut], fp[:cut])
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = links(key >> 1, fp.view(np.uint64), (key & 1).astype(bool), threshold)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    spark = nodes.sparkSession
    common.ship(spark)
    rows = nodes.select("fp").mapInArrow(spread, "anchor long, fp long")
    tasks = max(common.parts(spark), -(-nodes.count() // NODES_A_TASK))
    return rows.repartition(tasks, F.expr("anchor div 2")).sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fp`` -> ``doc_id, fp, component_id``."""
    prints = common.materialize(prints, "fingerprints")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "nodes")
    roots = components(near_links(nodes, threshold))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "head")
    # an id for each class, from one row per node
    ids = common.materialize(linked.groupBy("root").agg(F.min("head").alias("component_id")), "classes")
    named = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "head").alias("component_id"))
    every = common.materialize(every, "named")
    return prints.join(every, "fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id``."""
    got = classes(fingerprint_table(docs, shingle), threshold)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
