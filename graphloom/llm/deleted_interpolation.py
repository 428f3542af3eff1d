"""Language-model scores by deleted interpolation.

p(w | context) = sum_k lambda_k(b) p_k(w | last k - 1 words), where p_0 is uniform over the vocabulary and one
unknown word, p_k are maximum-likelihood n-gram estimates, and the weights depend on the bucket b of the
contexts' training frequencies (powers of two). Weights are learned by expectation-maximisation on the counts
of a held-out part of the training documents (HELD_FOLD), with estimates from the rest of them, until a step raises
the held-out logarithmic likelihood by less than TOLERANCE a token (EM_STEPS bounds the steps); scores then use the
counts of all training documents.

Texts are tokenised once into batches of some BATCH_TOKENS tokens with local word numbers. For every order a
batch sends each distinct n-gram once, as part of one sorted, packed block per key range, with its counts; the
range's task adds the counts up and sends them back in the same order. So an n-gram costs a few bytes per
batch that has it however often it occurs there, no key is hot, and a task holds one key range (about
RANGE_KEYS keys). What is counted grows with the corpus; nothing of it goes to the driver but totals and
EM's sums for the buckets.

Defined cases: a null or empty text is one end token; null ids count as the empty string for the folds; without
training documents every word is unknown; repeated rows count each; an empty table gives an empty table.
N-grams are told apart by 64-bit hashes of their words. Very long texts are batches of their own size; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

ORDER = 3
#: Documents with crc32 of their id in fold SCORED of FOLDS never train; those in HELD_FOLD train the weights.
FOLDS, SCORED, HELD_FOLD = 7, 2, 3
BATCH_TOKENS, RANGE_KEYS, CHUNK_BYTES = 1_000_000, 2_000_000, 6_000_000
EM_STEPS, TOLERANCE, FLOOR = 60, 1e-5, 1e-4
#: Classes of context frequencies: 0, 1, 2-3, 4-7, ... for the context of 1, 2, ... words.
CLASSES = (16, 10, 8, 8)
#: Hashes of what precedes and ends a text; white space is in no word.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\t", b"\n"))


def pack(a: np.ndarray) -> bytes:
    """Compressed, the lowest bytes of all numbers first, then the next: high bytes are mostly zero."""
    a = np.ascontiguousarray(a).ravel()
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 3)


def unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: the first, then differences, their low five bytes as they are and the rest compressed."""
    steps = np.diff(keys).view(np.uint8).reshape(-1, 8)
    return keys[:1].tobytes() + len(steps).to_bytes(8, "little") + np.ascontiguousarray(steps[:, :5]).tobytes() + zstandard.compress(np.ascontiguousarray(steps[:, 5:].T).tobytes(), 3)


def unpack_keys(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[8:16], "little")
    steps = np.empty((n, 8), np.uint8)
    steps[:, :5] = np.frombuffer(b, np.uint8, 5 * n, 16).reshape(n, 5)
    steps[:, 5:] = np.frombuffer(zstandard.decompress(b[16 + 5 * n :]), np.uint8).reshape(3, n).T
    return np.cumsum(np.concatenate([np.frombuffer(b[:8], np.uint64), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def grams(tokens: np.ndarray, words: np.ndarray, lens: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of the 1-, 2-, ... gram that ends at each token; and whether a token is its text's first."""
    h = words[tokens]
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lens) - lens] = True
    out, start = [h], START
    for _ in range(order - 1):
        before = np.empty_like(h)
        before[1:] = out[-1][:-1]
        before[first] = start
        out.append(common.mix64(before * np.uint64(0x9E3779B97F4A7C15) + h))
        start = common.mix64(np.array([start], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + START)[0]
    return out, first


_BATCH = "batch long, held boolean, ids array<bigint>, train binary, lens binary, tokens binary, words binary, n long, texts long"


def batches_of(docs: DataFrame) -> DataFrame:
    """Tokenised batches; documents of HELD_FOLD are in batches of their own."""
    common.ship(docs.sparkSession)
    schema = pa.schema([("batch", pa.int64()), ("held", pa.bool_()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("train", "lens", "tokens", "words")], ("n", pa.int64()), ("texts", pa.int64())])

    @common.tidy
    def run(batches):
        made = 0
        stock: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            nonlocal made
            ids, texts, fold = (pa.concat_arrays([p[0] for p in stock[held]]), pa.concat_arrays([p[1] for p in stock[held]]), np.concatenate([p[2] for p in stock[held]]))
            stock[held], size[held] = [], 0
            flat, owner = common.split_words(pc.ascii_lower(texts))
            coded = flat.dictionary_encode()
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
            per = np.bincount(owner, minlength=len(texts))
            lens = (per + 1).astype(np.int32)
            tokens = np.full(len(flat) + len(texts), len(words), np.int32)
            tokens[np.arange(len(flat)) + owner] = coded.indices.to_numpy()
            words = np.append(words, END)
            made += 1
            number = TaskContext.get().partitionId() << 32 | made
            row = [number, held, ids, (fold != SCORED).astype(np.uint8).tobytes(), lens.tobytes(), pack(tokens), pack(words), len(tokens), int((fold != SCORED).sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) if f.name != "ids" else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) for x, f in zip(row, schema, strict=True)], schema=schema)

        for ids, texts in common.chunks(batches, CHUNK_BYTES // 4):
            fold = np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids.to_pylist()), np.int64, len(ids))
            for held in (False, True):
                mine = pa.array((fold == HELD_FOLD) == held)
                part = texts.filter(mine)
                if len(part):
                    stock[held].append((ids.filter(mine), part, fold[mine.to_numpy(zero_copy_only=False)]))
                    size[held] += pc.sum(pc.binary_length(part)).as_py()
                if size[held] >= CHUNK_BYTES:
                    yield flush(held)
        for held in (False, True):
            if stock[held]:
                yield flush(held)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, _BATCH)


def open_batch(row: dict, order: int):
    lens = np.frombuffer(row["lens"], np.int32)
    keys, first = grams(unpack(row["tokens"], np.int32), unpack(row["words"], np.uint64), lens, order)
    train = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), lens)
    return lens, keys, first, train


def bounds(keys: np.ndarray, ranges: int) -> tuple[list[int], np.ndarray]:
    """The key ranges that sorted keys fall into (key k is in (k >> 32) * ranges >> 32), and where each one's begin.

    Work and result grow with the keys, not with the number of ranges.
    """
    some, begin = np.unique((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
    return some.tolist(), np.append(begin, len(keys))


def count(batches: DataFrame, ranges: int, k: int) -> DataFrame:
    """``batch, k, part, counts``: of each batch's distinct k-grams in key order, training and held counts; and
    one row per range with batch -1, ``n`` its training tokens (or n-grams) and ``v`` its distinct ones."""

    def send(it):
        for b in it:
            for row in b.to_pylist():
                _, keys, _, train = open_batch(row, k)
                held = train if row["held"] else np.zeros(len(train), bool)
                distinct, at = np.unique(keys[-1], return_inverse=True)
                n_train = np.bincount(at, weights=train, minlength=len(distinct)).astype(np.uint32)
                n_held = np.bincount(at, weights=held, minlength=len(distinct)).astype(np.uint32)
                some, cut = bounds(distinct, ranges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([row["batch"]] * len(some), pa.int64()),
                        pa.array([pack_keys(distinct[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                        pa.array([pack(np.stack([n_train[i:j], n_held[i:j]])) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                    ],
                    names=["range", "batch", "keys", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        own = [unpack_keys(b) for b in table["keys"].to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        distinct, where = np.unique(np.concatenate(own), return_inverse=True)
        sent = [unpack(b, np.uint32).reshape(2, -1) for b in table["counts"].to_pylist()]
        total = np.stack([np.bincount(where, weights=np.concatenate([s[i] for s in sent]), minlength=len(distinct)) for i in (0, 1)]).astype(np.uint64)
        part = table["range"][0].as_py()
        batch = table["batch"].to_pylist()
        back = [pack(total[:, where[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        n = len(batch) + 1
        return pa.table(
            {
                "batch": pa.array([*batch, -1], pa.int64()), "k": pa.array([k] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "counts": pa.array([*back, None], pa.binary()),
                "n": pa.array([0] * (n - 1) + [int(total[0].sum())], pa.int64()), "n_held": pa.array([0] * (n - 1) + [int(total[1].sum())], pa.int64()), "v": pa.array([0] * (n - 1) + [int((total[0] > 0).sum())], pa.int64()),
            }
        )

    sent = batches.mapInArrow(send, "range long, batch long, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "batch long, k int, part int, counts binary, n long, n_held long, v long")


def event_counts(row: dict, back: pa.Table, order: int):
    """Of each token: counts (training, held) of the 1-, 2-, ... gram that ends there; and the text's lengths and firsts."""
    lens, keys, first, _ = open_batch(row, order)
    out = []
    for k, key in enumerate(keys, 1):
        mine = back.filter(pc.equal(back["k"], k)).sort_by("part")
        counts = np.concatenate([unpack(b, np.uint64).reshape(2, -1) for b in mine["counts"].to_pylist()], axis=1)
        _, at = np.unique(key, return_inverse=True)
        out.append(counts[:, at].astype(np.float64))
    return lens, first, out


def mixture_inputs(counts: list[np.ndarray], first: np.ndarray, texts: float, total: float, words: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates p_0 ... p_order of every token and the bucket of its contexts."""
    n = len(first)
    p = [np.full(n, 1.0 / (words + 1)), counts[0] / max(total, 1)]
    bucket = np.zeros(n, np.int64)
    for k in range(1, len(counts)):
        context = np.empty(n)
        context[1:] = counts[k - 1][:-1]
        context[first] = texts
        with np.errstate(divide="ignore", invalid="ignore"):
            p.append(np.where(context > 0, counts[k] / context, 0.0))
        bucket = bucket * CLASSES[k - 1] + np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), CLASSES[k - 1] - 1)
    return np.stack(p, axis=1), bucket


def learn_weights(held: DataFrame, n_buckets: int, order: int) -> np.ndarray:
    """EM over held-out tokens: ``bucket`` (32-bit) and ``p`` (32-bit floats, order + 1 a token), one row per batch.

    Each step adds up responsibilities by bucket on the executors; the driver gets one sum per bucket and order.
    Buckets without held-out tokens take the weights of all tokens together.
    """
    weights, before = np.full((n_buckets, order + 1), 1.0 / (order + 1)), -np.inf
    names = [f"w{k}" for k in range(order + 1)]
    for _ in range(EM_STEPS):

        def expect(batches, weights=weights):
            total, gain = np.zeros((n_buckets, order + 1)), np.zeros(n_buckets)
            for b in batches:
                for packed, likely in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    bucket = unpack(packed, np.int32)
                    joint = unpack(likely, np.float32).reshape(-1, order + 1) * weights[bucket]
                    every = joint.sum(1)
                    joint /= every[:, None]
                    for k in range(order + 1):
                        total[:, k] += np.bincount(bucket, weights=joint[:, k], minlength=n_buckets)
                    gain += np.bincount(bucket, weights=np.log(every), minlength=n_buckets)
            some = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(gain[some]), *[pa.array(total[some, k]) for k in range(order + 1)]], names=["bucket", "gain", *names])

        got = held.mapInArrow(expect, "bucket long, gain double, " + ", ".join(f"{w} double" for w in names)).groupBy("bucket").agg(*[F.sum(c) for c in ("gain", *names)]).collect()
        sums = np.zeros((n_buckets, order + 1))
        for r in got:
            sums[r[0]] = r[2:]
        tokens, likelihood = sums.sum(), sum(r[1] for r in got)
        pooled = sums.sum(0) if sums.any() else np.ones(order + 1)
        sums[sums.sum(1) == 0] = pooled
        weights = sums / sums.sum(1, keepdims=True)
        if likelihood - before <= TOLERANCE * tokens:
            break
        before = likelihood
    weights = np.maximum(weights, np.where(np.arange(order + 1) == 0, FLOOR, 0))
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    batches = common.materialize(batches_of(docs), "batches")
    tokens, texts, held_texts = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n"), F.col("texts"), F.when(F.col("held"), F.col("texts")))]).first()
    ranges = max(1, -(-tokens // RANGE_KEYS))
    tables = []
    for k in range(1, order + 1):  # one order after the other, so that one order's shuffle is on disk at a time
        tables.append(common.materialize(count(batches, ranges, k), "counts"))
    back = reduce(DataFrame.unionByName, tables)
    n, n_held, v = tables[0].where("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_held", "v")]).first()
    back = back.where("batch >= 0").select("batch", "k", "part", "counts")
    n_buckets = int(np.prod(CLASSES[: order - 1]))
    texts, rest_texts = float(texts), float(texts - held_texts)

    def likelihoods(left: pa.Table, right: pa.Table) -> pa.Table:
        _, first, counts = event_counts(right.to_pylist()[0], left, order)
        p, bucket = mixture_inputs([c[0] - c[1] for c in counts], first, rest_texts, float(n - n_held), float(v))
        return pa.table([pa.array([pack(bucket.astype(np.int32))], pa.binary()), pa.array([pack(p.astype(np.float32))], pa.binary())], names=["bucket", "p"])

    held = batches.where("held")
    vectors = back.join(held.select("batch"), "batch", "left_semi").groupBy("batch").cogroup(held.groupBy("batch")).applyInArrow(likelihoods, "bucket binary, p binary")
    vectors = common.materialize(vectors, "heldout")
    weights = learn_weights(vectors, n_buckets, order)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        lens, first, counts = event_counts(row, left, order)
        full = [c[0] for c in counts]
        p, bucket = mixture_inputs(full, first, texts, float(n), float(v))
        model = np.log10((p * weights[bucket]).sum(1))
        base = np.log10((full[0] + 1) / (n + v + 1))
        at = np.cumsum(lens) - lens
        held_out = ~np.frombuffer(row["train"], np.uint8).astype(bool)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(held_out), "n_tokens": pa.array(lens.astype(np.int64)), "n_known": pa.array(np.add.reduceat((full[0] > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(lens), n, np.int64)), "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(model, at)),
            }
        )

    return back.groupBy("batch").cogroup(batches.groupBy("batch")).applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
