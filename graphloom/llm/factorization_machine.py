"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so that all pairwise
interactions cost time linear in a text's distinct features. Words are hashed case-folded with weight
sqrt(count), scaled to unit length; each structure statistic and each metadata value (size classes, share of
non-ASCII bytes) falls into one of BINS classes cut at quantiles of the training rows.

The model is fitted on at most ``max_rows`` labelled rows of each class (those whose ids hash lowest) and, of these, on so
many as have MAX_FEATURE_BYTES of word features together, so its cost does not grow with the corpus; it is of fixed size
and goes to executors as one broadcast variable.
Labels, lang, source and doc_id are never features. With labels of one class only, or none, scores are that
class's share (0.5 for none).

Defined cases: null and empty texts are scored like any other, very long ones whole; several labels of one id count as
their rounded mean, an even split as 1; of rows that repeat a labelled id the one with the least digest of its text
trains; null labels and ids do not train; other columns are ignored, whatever their names; repeated rows score alike;
an empty table gives an empty table, and without rows to train on all scores are 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Word features, classes of each statistic, rank of the interactions.
WORDS, BINS, RANK = 1 << 16, 8, 8
#: Labelled rows of either class that are fitted at most, and bytes of their word features (eight to a distinct word of a text).
MAX_ROWS, MAX_FEATURE_BYTES = 4000, 256_000_000
#: Rows of FOLD_OF whose crc32 is 0 modulo FOLDS never train.
FOLDS = 5
#: A document counts as good from this score on.
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.05, 1e-4
CHUNK_BYTES = 8_000_000

STATS = ["words", "bytes", "lines", "word_len", "upper", "digit", "punct", "symbol", "non_ascii", "line_len", "dup_lines", "distinct", "top_word", "shouted", "ended", "space"]

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # upper
_CLASS[48:58] = 2  # digits
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\/^~=+_@"]] = 4
_CLASS[128:] = 5
_CLASS[[32, *range(9, 14)]] = 6


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) pairs as owner, code, count; and the largest count of each owner."""
    key, count = np.unique(owner.astype(np.int64) << 32 | codes.astype(np.int64), return_counts=True)
    own = (key >> 32).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, own, count)
    return own, key & 0xFFFFFFFF, count, top


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: word features as (row, feature, weight) sorted by row, and a row of STATS."""
    n = len(texts)
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    raw, off = common.string_parts(texts)
    base = off[0]
    kinds = _CLASS[raw[base : off[-1]]]
    off = off - base
    size = np.maximum(np.diff(off), 1)
    by_kind = [_sums(kinds == k, off) for k in range(1, 7)]
    words, owner = common.split_words(texts)
    n_words = np.bincount(owner, minlength=n)
    letters = size - by_kind[5]
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    own, code, count, top = _repeats(codes, owner, n)
    shouted = pc.match_substring_regex(names, "[A-Z]{2}").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    flat, line_owner = flat.filter(pa.array(full)), line_owner[full]
    n_lines = np.bincount(line_owner, minlength=n)
    l_own, _, l_count, _ = _repeats(flat.dictionary_encode().indices.to_numpy(), line_owner, n)
    ended = pc.match_substring_regex(flat, "[.!?]$").to_numpy(zero_copy_only=False)
    w, li = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    stats = np.stack(
        [
            np.log1p(n_words), np.log1p(np.diff(off)), np.log1p(n_lines), letters / w, by_kind[0] / size, by_kind[1] / size, by_kind[2] / size, by_kind[3] / size, by_kind[4] / size,
            np.log1p(size / li), np.bincount(l_own, weights=l_count - 1, minlength=n) / li, np.bincount(own, minlength=n) / w, top / w,
            np.bincount(owner, weights=shouted[codes], minlength=n) / w, np.bincount(line_owner, weights=ended, minlength=n) / li, by_kind[5] / size,
        ],
        axis=1,
    )
    hashed = np.fromiter((zlib.crc32(x) for x in pc.ascii_lower(names).cast(pa.large_binary()).to_pylist()), np.int64, len(names)) % WORDS
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(own, weights=value * value, minlength=n))
    return own, hashed[code], (value / np.maximum(norm, 1e-9)[own]).astype(np.float32), stats.astype(np.float32)


@dataclass
class Model:
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(STATS), BINS - 1), np.float32))

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature of each statistic's class."""
        return np.stack([WORDS + k * BINS + np.searchsorted(self.edges[k], stats[:, k], side="left") for k in range(len(STATS))], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if not len(self.weights):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        row, feature, value, stats = features(texts)
        z, own, sums = np.full(n, self.bias), self.bins(stats), np.zeros((n, RANK), np.float64)
        z += self.weights[own].sum(1)
        sums += self.factors[own].sum(1)
        squares = (self.factors[own] ** 2).sum((1, 2))
        starts = np.searchsorted(row, np.arange(n + 1))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            at = starts[some]
            z[some] += np.add.reduceat(self.weights[feature] * value, at)
            part = self.factors[feature] * value[:, None]
            sums[some] += np.add.reduceat(part, at, axis=0)
            squares[some] += np.add.reduceat(np.einsum("ij,ij->i", part, part), at)
        z += 0.5 * ((sums**2).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(model: Model, idx: np.ndarray, val: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of texts with features (doc, idx, val), labels y of -1 and 1, and weights: the
    derivative by the bias, the features used, and the derivatives by their weights and factors (with DECAY).
    """
    n = len(y)
    v = model.factors[idx]
    vx = v * val[:, None]
    sums = np.stack([np.bincount(doc, weights=vx[:, f], minlength=n) for f in range(RANK)], axis=1)
    z = model.bias + np.bincount(doc, weights=model.weights[idx] * val, minlength=n) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, weights=(vx * vx).sum(1), minlength=n))
    d = -y / (1 + np.exp(np.clip(y * z, -30, 30))) * weight / n
    used, back = np.unique(idx, return_inverse=True)
    dw = np.bincount(back, weights=d[doc] * val) + DECAY * model.weights[used]
    each = (d[doc] * val)[:, None] * (sums[doc] - vx)
    dv = np.stack([np.bincount(back, weights=each[:, f]) for f in range(RANK)], axis=1) + DECAY * model.factors[used]
    return float(d.sum()), used, dw, dv


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on the logistic loss over features(); both classes weigh alike."""
    model = Model()
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        model.bias = float(np.log(share / (1 - share)))
        return model
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    n, rng = len(labels), np.random.default_rng(seed)
    size = WORDS + len(STATS) * BINS
    model.weights = np.zeros(size, np.float32)
    model.factors = (rng.standard_normal((size, RANK)) * 0.02).astype(np.float32)
    own, starts = model.bins(stats), np.searchsorted(row, np.arange(n + 1))
    y, weight = labels * 2.0 - 1, np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    g_w, g_v, g_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            lens = starts[some + 1] - starts[some]
            ends = np.cumsum(lens)
            at = np.repeat(starts[some] - (ends - lens), lens) + np.arange(ends[-1])
            idx = np.concatenate([feature[at], own[some].ravel()])
            val = np.concatenate([value[at], np.ones(own[some].size, np.float32)])
            doc = np.concatenate([np.repeat(np.arange(len(some)), lens), np.repeat(np.arange(len(some)), own.shape[1])])
            db, used, dw, dv = gradient(model, idx, val, doc, y[some], weight[some])
            g_w[used] += (dw * dw).astype(np.float32)
            g_v[used] += (dv * dv).astype(np.float32)
            g_b += db**2
            model.weights[used] -= (RATE * dw / np.sqrt(g_w[used])).astype(np.float32)
            model.factors[used] -= (RATE * dv / np.sqrt(g_v[used])).astype(np.float32)
            model.bias -= RATE * db / g_b**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside fold 0, at most ``max_rows`` of either class, those whose ids hash lowest."""
    spark = docs.sparkSession
    rows = labels.where("quality in (0, 1) and doc_id is not null").where(common.crc_mod("doc_id", FOLDS) != 0)
    rows = rows.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = [r for q in (0, 1) for r in rows.where(F.col("quality") == q).orderBy(order, "doc_id").limit(max_rows).collect()]
    if not picked:
        return Model()
    sample = spark.createDataFrame([(r.doc_id, r.quality) for r in picked], "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    common.ship(spark)

    @common.tidy
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                row, feature, value, stats = features(common.large_string(part.column(1)))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                feature, value = feature.astype(np.int32), value.astype(np.float32)
                own = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for x in (feature, value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own[0], pa.binary()), pa.array(own[1], pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary())], names=["doc_id", "quality", "feature", "value", "stats"])

    made = common.materialize(texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, feature binary, value binary, stats binary"), "features")
    size, room = {r.doc_id: r.n for r in made.select("doc_id", (2 * F.octet_length("feature")).alias("n")).collect()}, MAX_FEATURE_BYTES
    ids = []
    for r in (x for pair in zip_longest(*[[r for r in picked if r.quality == q] for q in (0, 1)]) for x in pair if x is not None):  # both classes in turn
        room -= size.get(r.doc_id, 0)
        if room >= 0 and r.doc_id in size:
            ids.append((r.doc_id,))
    if not ids:
        return Model()
    got = made.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    each = [np.frombuffer(x, np.int32) for x in got["feature"].to_pylist()]
    value = np.frombuffer(b"".join(got["value"].to_pylist()), np.float32)
    stats = np.frombuffer(b"".join(got["stats"].to_pylist()), np.float32).reshape(-1, len(STATS))
    model = fit(np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each), value, stats, got["quality"].to_numpy().astype(float))
    del got, each, value, stats
    common.give_back()  # the driver has further stages to run
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``; ``held_out`` documents never train."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    @common.tidy
    def run(batches):
        for keys, texts in common.chunks(batches, CHUNK_BYTES):
            z = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(z), pa.array((z >= THRESHOLD).astype(np.int32))], schema=schema)

    got = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return got.select("doc_id", (common.crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @common.tidy
    def run(batches):
        for b in common.by_bytes(batches, at, CHUNK_BYTES):
            yield b.filter(pa.array(held.value.score(common.large_string(b.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
