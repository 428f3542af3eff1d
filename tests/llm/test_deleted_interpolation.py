import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import deleted_interpolation as d

SCHEMA = "doc_id bigint, text string, score string"


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


def plain(rows, order):
    """The same model with dictionaries."""
    pad = ["\t"] * (order - 1)
    tables = {}
    for name, some in (("all", [t for i, t in rows if fold(i) != 2]), ("rest", [t for i, t in rows if fold(i) not in (2, 3)])):
        c, ctx = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for t in some:
            w = pad + words(t)
            for j in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    c[k][tuple(w[j - k + 1 : j + 1])] += 1
                    ctx[k][tuple(w[j - k + 1 : j])] += 1
        tables[name] = c, ctx
    vocabulary = len(tables["all"][0][1])

    def events(t, name):
        c, ctx = tables[name]
        total, w = sum(c[1].values()), pad + words(t)
        for j in range(order - 1, len(w)):
            p, b = [1 / (vocabulary + 1), c[1][(w[j],)] / max(1, total)], 0
            for k in range(2, order + 1):
                n = ctx[k][tuple(w[j - k + 1 : j])]
                p.append(c[k][tuple(w[j - k + 1 : j + 1])] / n if n else 0)
                b = b * d.CLASSES[k - 2] + min(math.ceil(math.log2(n + 1)), d.CLASSES[k - 2] - 1)
            yield p, b

    held = Counter()
    for i, t in rows:
        if fold(i) == 3:
            for p, b in events(t, "rest"):
                held[b, tuple(p)] += 1
    n_buckets = int(np.prod(d.CLASSES[: order - 1]))
    lam = np.full((n_buckets, order + 1), 1 / (order + 1))
    likely = -math.inf
    for _ in range(d.EM_STEPS):
        s, now = np.zeros_like(lam), 0.0
        for (b, p), n in held.items():
            joint = np.array(p) * lam[b]
            s[b] += n * joint / joint.sum()
            now += n * math.log(joint.sum())
        assert now >= likely - 1e-9
        s[s.sum(1) == 0] = s.sum(0) if s.any() else 1
        lam = s / s.sum(1, keepdims=True)
        if now - likely <= d.TOLERANCE * sum(held.values()):
            break
        likely = now
    lam[:, 0] = np.maximum(lam[:, 0], d.FLOOR)
    lam /= lam.sum(1, keepdims=True)
    c1 = tables["all"][0][1]
    n = sum(c1.values())
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, fold(i) == 2, len(w), sum((x,) in c1 for x in w), n, sum(math.log10((c1[(x,)] + 1) / (n + vocabulary + 1)) for x in w), sum(math.log10(np.dot(p, lam[b])) for p, b in events(t, "all"))))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_against_dictionaries(spark, order):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "B", "cc", "d\td", "é", f"w{i % 9}"], weights=[9, 5, 3, 2, 1, 1], k=rng.randint(0, 60)))) for i in range(90)] + [(None, None), (7, "a a"), (7, "a a"), (1000, "never seen words here")]
    got = sorted(map(tuple, d.score(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), order).collect()), key=str)
    want = sorted(plain(rows, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_beats_the_base_model_held_out(spark):
    got = d.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_empty(spark):
    assert d.score(spark.createDataFrame([], SCHEMA)).collect() == []
    one = d.score(spark.createDataFrame([(1, "x", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].n_tokens == 2 and math.isfinite(one[0].score)


def test_very_long_text(spark):
    text = "a b c " * 200_000
    got = d.score(spark.createDataFrame([(1, text, ""), (2, "a b", "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 600_001), (2, 3)] and all(math.isfinite(r.score) for r in got)


def test_packing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (d.unpack_keys(d.pack_keys(keys)) == keys).all()
        for ranges in (1, 3, 16):
            some, cut = d.bounds(keys, ranges)
            assert cut[0] == 0 and cut[-1] == len(keys) and len(cut) == len(some) + 1
            assert all(((int(k) >> 32) * ranges >> 32) == r for r, i, j in zip(some, cut, cut[1:]) for k in keys[i:j])
