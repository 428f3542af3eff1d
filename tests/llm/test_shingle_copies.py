import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as p
from graphloom.llm import shingle_copies as c

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets():
    rng = random.Random(2)
    texts = ["", " ", "a", "A", "a b", "b a", "a b c d e", "a b c d e f a b c d e f a b c d e"] + [" ".join(rng.choices("abC", k=rng.randint(1, 300))) for _ in range(40)]
    h, starts = c.shingle_sets(pa.array(texts, pa.large_string()))
    got = [set(h[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
    want = [plain(t) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_planted_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, near = [], set()
    for i in range(120):
        text = rng.choices(words, k=200)
        rows.append((i, " ".join(text), "en", "s", 1))
        for k in range(3):
            edited = list(text)
            for _ in range((1, 3, 12)[k]):  # similarity about 0.95, 0.86 and 0.54
                edited[rng.randrange(200)] = rng.choice(words)
            rows.append((1000 * (k + 1) + i, " ".join(edited), "en", "s", 1))
            a, b = plain(rows[-1][1]), plain(" ".join(text))
            if len(a & b) >= 0.8 * len(a | b):
                near.add(rows[-1][0])
    rows += [(None, "", "en", "s", 0)]
    assert dict(p.STAGES)["near duplicates"] is p.near_copies
    got = [r.doc_id for r in p.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert len(near) >= 200 and sorted(x for x in got if x is not None) == sorted({r[0] for r in rows if r[0] is not None} - near)
    assert got.count(None) == 1
    # operator 5 alone leaves most of them
    assert len(near & {r.doc_id for r in p.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}) > 100


@pytest.mark.parametrize("neighbours", [1, 8])
def test_large_buckets_are_compared_in_full(spark, monkeypatch, neighbours):
    """Groups of texts around the limit, of which few pairs are candidates: the classes are those of all pairs."""
    rng = random.Random(neighbours)
    texts = []
    for g in range(3):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(w))
    monkeypatch.setattr(c, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(c, "BLOCK_NODES", 7)
    monkeypatch.setattr(c, "BLOCK_SHINGLES", 700)
    docs = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    got = {}
    for r in c.copy_classes(docs, docs.select("key")).collect():
        got.setdefault(r.root, set()).add(r.key)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(i)
    assert {frozenset(x) for x in got.values() if len(x) > 1} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_components(spark):
    from graphloom.llm.components import components

    edges = [(1, 2), (2, 1), (2, 3), (3, 3), (9, 8), (5, None), (None, 5), *[(i, i + 1) for i in range(100, 160)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **dict.fromkeys(range(100, 161), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
