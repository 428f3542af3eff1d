import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import factorization_machine as f


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = f.Model(0.1, rng.normal(size=f.WORDS + len(f.STATS) * f.BINS).astype("f4") * 0.1, rng.normal(size=(f.WORDS + len(f.STATS) * f.BINS, f.RANK)).astype("f4") * 0.1, np.sort(rng.normal(size=(len(f.STATS), f.BINS - 1)), axis=1).astype("f4"))
    texts = pa.array(["a b b c", "", "X!! y\nX!! y\n", "z " * 50], pa.large_string())
    row, feature, value, stats = f.features(texts)
    for i, got in enumerate(m.score(texts)):
        x = [(j, v) for r, j, v in zip(row, feature, value) if r == i] + [(j, 1.0) for j in m.bins(stats)[i]]
        z = m.bias + sum(m.weights[j] * v for j, v in x)
        z += sum(float(m.factors[a] @ m.factors[b]) * u * v for p, (a, u) in enumerate(x) for b, v in x[p + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_batches_do_not_matter():
    texts = ["one two two", "", "THREE!! four", None, "a\n\na\nb"]
    rng = np.random.default_rng(2)
    size = f.WORDS + len(f.STATS) * f.BINS
    m = f.Model(0.0, rng.normal(size=size).astype("f4"), rng.normal(size=(size, f.RANK)).astype("f4"), np.zeros((len(f.STATS), f.BINS - 1), "f4"))
    whole = m.score(pa.array([t or "" for t in texts], pa.large_string()))
    assert np.allclose(whole, [m.score(pa.array([t or ""], pa.large_string()))[0] for t in texts])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables not there")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = f.op4(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "y"), (None, "", "z")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in f.score(docs, f.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], none.schema)
    assert min(r.score for r in f.score(docs, f.train(docs, one)).collect()) > 0.9
    both = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)], none.schema)
    assert f.score(docs, f.train(docs, both)).count() == 4
    assert f.score(docs.limit(0), f.train(docs, both)).count() == 0
    assert f.keep_good(docs, f.Model()).columns == docs.columns


def test_gradient_is_the_loss_derivative():
    """Against differences of the loss, computed pair by pair."""
    rng = np.random.default_rng(1)
    size, n = 30, 5
    model = f.Model(0.3, rng.standard_normal(size), rng.standard_normal((size, f.RANK)) * 0.5)
    doc = np.repeat(np.arange(n), 6)
    idx = np.concatenate([rng.choice(size, 6, replace=False) for _ in range(n)])
    val, y, weight = rng.random(n * 6), rng.choice([-1.0, 1.0], n), rng.random(n) + 0.5

    def loss():
        total = 0.0
        for i in range(n):
            own = np.flatnonzero(doc == i)
            z = model.bias + sum(model.weights[idx[a]] * val[a] for a in own)
            z += sum(model.factors[idx[a]] @ model.factors[idx[b]] * val[a] * val[b] for a in own for b in own if a < b)
            total += weight[i] * np.log1p(np.exp(-y[i] * z)) / n
        used = np.unique(idx)
        return total + f.DECAY / 2 * ((model.weights[used] ** 2).sum() + (model.factors[used] ** 2).sum())

    db, used, dw, dv = f.gradient(model, idx, val, doc, y, weight)

    def slope(array, at, step=1e-6):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    assert np.allclose([slope(model.weights, u) for u in used], dw, atol=1e-6)
    assert np.allclose([[slope(model.factors, (u, k)) for k in range(f.RANK)] for u in used], dv, atol=1e-6)
    bias, model.bias = model.bias, model.bias + 1e-6
    up = loss()
    model.bias = bias - 1e-6
    assert abs((up - loss()) / 2e-6 - db) < 1e-6


def test_training_is_bounded_and_the_same_in_any_order(spark, monkeypatch):
    text = lambda i, w: " ".join(f"{w}{(i * 7 + j) % 50}" for j in range(60))
    rows = [(i, text(i, "good" if i % 2 else "bad"), "x") for i in range(300)] + [(i, text(i, "other"), "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    one, two = f.train(docs, labels), f.train(docs.repartition(5), labels)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()
    monkeypatch.setattr(f, "MAX_FEATURE_BYTES", 8 * 50 * 100)
    assert len(f.train(docs, labels).weights)
    monkeypatch.setattr(f, "MAX_FEATURE_BYTES", 1)
    assert not len(f.train(docs, labels).weights)
