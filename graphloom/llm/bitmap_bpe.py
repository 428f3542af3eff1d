"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte pieces. Every adjacent pair that the vocabulary knows waits in
the bucket of its merge rank; a three-level bitmap over ranks finds the lowest filled bucket by
find-first-set. A merge drops two pairs and adds at most two; entries that no longer describe the list are
skipped when they come up. A pre-token of n bytes costs O(n log n) at any length.

Texts are cut before each blank that follows a non-blank and precedes one, which is always a pre-token
border, so that the split pattern and the merges run once for each distinct piece of a chunk of texts. Short
pre-tokens of a chunk share one queue, whose pops then merge many lists at once; long ones have it to themselves.

Defined cases: a null or empty text has no ids (n_tokens 0, digests of the empty string); other columns are
ignored; rows repeat as they come in; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common

#: Bytes of text that a task encodes at once; bounds memory, never results.
CHUNK_BYTES = 6_000_000
#: Pre-tokens up to so many bytes are merged side by side under one queue, longer ones each on their own.
SHORT = 64
#: So many at a time; bounds memory.
SIDE_BY_SIDE = 200_000
#: Positions whose pairs are looked up, and pieces whose ids are written out, at a time; bounds memory.
PAIRS_AT_ONCE, PIECES_AT_ONCE = 100_000, 20_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Priority queue over small integers: buckets of positions under a bitmap of 64-way words."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            if level[at] & bit:
                break
            level[at] |= bit
            rank = at

    def lowest(self) -> int | None:
        """Find-first-set from the top word down."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank

    def pop(self) -> tuple[int, int] | None:
        """Lowest rank and its leftmost position."""
        rank = self.lowest()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.clear(rank)
        return rank, position

    def clear(self, rank: int) -> None:
        del self.buckets[rank]
        for level in self.levels:
            rank, bit = rank >> 6, 1 << (rank & 63)
            level[rank] &= ~bit
            if level[rank]:
                break

    def add(self, rank: int, positions) -> None:
        """Put many positions into one bucket, in any order, for take()."""
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.extend(positions)
        else:
            self.push(rank, positions[0])
            self.buckets[rank].extend(positions[1:])

    def take(self) -> tuple[int, list[int]] | None:
        """Lowest rank and its whole bucket."""
        rank = self.lowest()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        self.clear(rank)
        return rank, bucket


class Encoder:
    """Encodes and decodes with one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.decimal = list(map(str, range(max(ranks.values(), default=-1) + 1)))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        node: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wait = [-1] * n  # rank of the pair that starts here
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                wait[i] = r
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            if wait[i] != rank:
                continue  # stale
            j = after[i]
            node[i] += node[j]
            node[j] = None
            wait[j] = -1
            k = after[j]
            after[i] = k
            wait[i] = -1
            if k < n:
                before[k] = i
                r = ranks.get(node[i] + node[k])
                if r is not None:
                    wait[i] = r
                    queue.push(r, i)
            h = before[i]
            if h >= 0:
                r = ranks.get(node[h] + node[i])
                wait[h] = -1 if r is None else r
                if r is not None:
                    queue.push(r, h)
        return [ranks[x] for x in node if x is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        return [i for t in self.find(text) for i in self.merge(t.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Pairs:
    """Ranks of all pairs of vocabulary pieces that make a vocabulary piece, as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        # an open-addressing table, a quarter full at most
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, ranks_left = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            own = self.keys[slot] == left
            self.values[slot[own]] = ranks_left[own]
            left, ranks_left, slot = left[~own], ranks_left[~own], (slot[~own] + 1) & ((1 << self.bits) - 1)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        bound = max(ranks.values()) + 1
        self.length = np.zeros(bound, np.int64)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.text = np.zeros(int(self.length.sum()), np.uint8)
        for piece, rank in ranks.items():
            self.text[self.start[rank] : self.start[rank] + len(piece)] = np.frombuffer(piece, np.uint8)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it makes no piece."""
        want = a.astype(np.int64) << 32 | b
        slot = self.slot(want)
        found = self.keys[slot]
        out = np.where(found == want, self.values[slot], np.int32(-1))
        again = np.flatnonzero((found != want) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[again]]
            hit = found == want[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, end to end."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.text[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def merge_many(encoder: Encoder, pairs: Pairs, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many short pre-tokens at once, end to end, and where each one's begin.

    One queue serves all lists: a pop takes the lowest rank's bucket and merges, in each pre-token, its
    leftmost live position; further ones of that pre-token wait in the bucket, as a lower rank may come first.
    Most positions wait from the start: in a bucket, -1 - k stands for the k-th run of them.
    """
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ids = pairs.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    n, ends = len(ids), np.cumsum(lens)
    owner = np.repeat(np.arange(len(tokens), dtype=np.int32), lens)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends[lens > 0] - 1] = -1
    before[(ends - lens)[lens > 0]] = -1
    wait, alive, queue = np.full(n, -1, np.int32), np.ones(n, bool), encoder.queue

    def put(at: np.ndarray) -> None:
        ranks = wait[at]
        if len(at) < 24:
            for r, p in zip(ranks.tolist(), at.tolist(), strict=True):
                if r >= 0:
                    queue.add(r, (p,))
            return
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (), np.split(at, cuts), strict=False):
            queue.add(r, p.tolist())

    for i in range(0, n, PAIRS_AT_ONCE):
        left = np.flatnonzero(after[i : i + PAIRS_AT_ONCE] >= 0) + i
        wait[left] = pairs.rank(ids[left], ids[left + 1])
    begun = np.flatnonzero(wait >= 0).astype(np.int32)
    begun = begun[np.argsort(wait[begun], kind="stable")]
    cuts = np.flatnonzero(np.diff(wait[begun], prepend=-1, append=-1)).tolist()
    for k, r in enumerate(wait[begun[cuts[:-1]]].tolist()):
        queue.add(r, (-1 - k,))
    while (top := queue.take()) is not None:
        rank, at = top
        at = np.array(at, np.int64)
        if (run := int(at.min())) < 0:  # one run has a rank
            at = np.concatenate([at[at >= 0], begun[cuts[-1 - run] : cuts[-run]]])
        at = at[wait[at] == rank]  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            own = owner[at]
            if (at[1:] == at[:-1]).any():  # put twice, by its left and its right neighbour
                at = np.unique(at)
                own = owner[at]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            if not first.all():
                queue.add(rank, at[~first].tolist())
                at = at[first]
        gone = after[at]
        beyond = after[gone]
        ids[at] = rank
        alive[gone] = False
        wait[gone] = -1
        wait[at] = -1
        after[at] = beyond
        some = beyond >= 0
        if some.any():
            i, k = at[some], beyond[some]
            before[k] = i
            wait[i] = pairs.rank(ids[i], ids[k])
            put(i)
        back = before[at]
        some = back >= 0
        if some.any():
            h, i = back[some], at[some]
            wait[h] = pairs.rank(ids[h], ids[i])
            put(h)
    count = np.bincount(owner[alive], minlength=len(tokens))
    return ids[alive], np.concatenate([[0], np.cumsum(count)])


_WIDE = re.compile(r" \s|\s ")
_BORDER = regex.compile(r"(?<=\S)\s")


def encode_texts(encoder: Encoder, pairs: Pairs, texts: pa.Array) -> list[tuple[int, bytes, bytes]]:
    """Of each whole text: the number of ids, the ids in decimal joined by blanks, the bytes that they decode to."""
    lists = pc.split_pattern(texts, " ")
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    names = [" " + x for x in coded.dictionary.to_pylist()]
    known: dict[str, int] = {}

    def add(piece: str) -> int:
        at = known.get(piece)
        if at is None:
            at = known[piece] = len(names)
            names.append(piece)
        return at

    words: list[np.ndarray] = []
    for i in range(len(texts)):
        a, b = off[i], off[i + 1]
        text = texts[i].as_py()
        if _WIDE.search(text):  # runs of white space: pieces must hold the whole run
            cut = [0, *(m.start() for m in _BORDER.finditer(text)), len(text)]
            words.append(np.array([add(text[x:y]) for x, y in zip(cut, cut[1:], strict=False) if x < y], np.int64))
        else:
            first, _, _ = text.partition(" ")
            words.append(np.concatenate([np.array([add(first)] if first else [], np.int64), index[a + 1 : b]]))
    del lists, flat, coded, index
    tokens: dict[str, int] = {}
    flat_tokens, starts = array("i"), array("i", [0])
    for piece in names:
        if piece.isascii() and (piece[0] == " " or piece[0].isalpha()) and piece[1:].isalpha():  # one pre-token
            flat_tokens.append(tokens.setdefault(piece, len(tokens)))
        else:
            for t in encoder.find(piece):
                flat_tokens.append(tokens.setdefault(t, len(tokens)))
        starts.append(len(flat_tokens))
    n_pieces = len(names)
    del names, known
    order = [t.encode("utf-8") for t in tokens]
    del tokens
    get = encoder.ranks.get
    pool = np.fromiter((get(t, -1) for t in order), np.int32, len(order))
    start, count = np.arange(len(order)), np.ones(len(order), np.int64)
    split = np.flatnonzero(pool < 0)
    is_short = np.fromiter((len(order[i]) <= SHORT for i in split), bool, len(split))
    short, long = split[is_short], split[~is_short]
    pools, held = [pool], len(pool)
    for some in (short[i : i + SIDE_BY_SIDE] for i in range(0, len(short), SIDE_BY_SIDE)):
        ids, at = merge_many(encoder, pairs, [order[i] for i in some])
        start[some], count[some] = held + at[:-1], np.diff(at)
        pools.append(ids)
        held += len(ids)
    for i in long:
        pools.append(np.array(encoder.merge(order[i]), np.int32))
        start[i], count[i] = held, len(pools[-1])
        held += len(pools[-1])
    del order
    pool, flat_tokens, starts = np.concatenate(pools), np.frombuffer(flat_tokens, np.int32), np.frombuffer(starts, np.int32)
    del pools
    sizes = [np.zeros(0, np.int64)]
    said: list[bytes] = []
    back: list[bytes] = []
    for i in range(0, n_pieces, PIECES_AT_ONCE):  # ids of each piece, end to end
        at = starts[i : i + PIECES_AT_ONCE + 1]
        flat_ids, piece_at = gather(pool, start, count, flat_tokens[at[0] : at[-1]], at - at[0])
        decimal = list(map(encoder.decimal.__getitem__, flat_ids.tolist()))
        said += [" ".join(decimal[a:b]).encode() for a, b in zip(piece_at[:-1].tolist(), piece_at[1:].tolist(), strict=True)]
        ends = np.concatenate([[0], np.cumsum(pairs.length[flat_ids])])[piece_at].tolist()
        plain = pairs.decode(flat_ids).tobytes()
        back += [plain[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes.append(np.diff(piece_at))
    sizes = np.concatenate(sizes)
    return [(int(sizes[x].sum()), b" ".join([said[w] for w in y]), b"".join([back[w] for w in y])) for x in words for y in (x.tolist(),)]


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray, rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated slices ``values[start[r] : start[r] + count[r]]`` for r in rows, and where each group of rows begins."""
    n = count[rows]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(start[rows] - ends[:-1], n) + np.arange(ends[-1])], ends[groups]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``key, n_tokens, ids_sha256, decoded_sha256`` of the whole text.

    The rank table (of fixed size, whatever the input) goes to executors as one broadcast variable.
    """
    spark = docs.sparkSession
    common.ship(spark)
    table = spark.sparkContext.broadcast((ranks, Pairs(ranks)))
    kind = "bigint" if docs.schema[key].dataType.simpleString() == "bigint" else "string"
    schema = pa.schema([(key, pa.int64() if kind == "bigint" else pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @common.tidy
    def run(batches):
        encoder, pairs = Encoder(table.value[0], pattern), table.value[1]
        for keys, texts in common.chunks(batches, CHUNK_BYTES):
            n, said, plain = zip(*encode_texts(encoder, pairs, texts), strict=True)
            out = pa.RecordBatch.from_arrays(
                [
                    keys.cast(schema.field(0).type),
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in said], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
                ],
                schema=schema,
            )
            del keys, texts, n, said, plain  # nothing of a chunk stays for the next one
            common.trim()
            yield out

    return docs.select(docs[key].cast(kind).alias(key), docs[text].cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def production_ranks() -> tuple[dict[bytes, int], str]:
    import public_tokenizers as public

    return load_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, *production_ranks())
