import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline as p
from graphloom.llm import bitmap_bpe, factorization_machine, robust_outliers
from tests.llm.test_anchor_simhash import plain_classes, plain_fingerprint
from tests.llm.test_robust_outliers import plain as base_columns
from tests.llm.test_robust_outliers import vector, verdicts
from tests.llm.test_source_mix import water_fill

D = "/root/testdata/sf0.001"


def plain_kept(rows):
    """Ids that the quality rules keep, by plain functions: groups, small ones pooled by language, then all together."""
    ok = [r for r in rows if not base_columns(r.text)[-1]]
    groups = {}
    for r in ok:
        groups.setdefault((r.lang, r.source), []).append(r)
    least = robust_outliers.MIN_GROUP
    small = {}
    for (lang, _), some in groups.items():
        if len(some) < least:
            small.setdefault(lang, []).extend(some)
    pooled = [some for some in groups.values() if len(some) >= least] + [some for some in small.values() if len(some) >= least]
    pooled.append([r for some in small.values() if len(some) < least for r in some])
    kept = set()
    for some in pooled:
        far = verdicts(np.array([vector(r.text) for r in some]) / robust_outliers.GRID) if len(some) >= least else [0] * len(some)
        kept |= {r.doc_id for r, d in zip(some, far) if d <= robust_outliers.CUTOFF}
    return kept


def plain_mix(rows):
    """Words taken of each id: whole epochs of its source, then a prefix of the source's shuffled stream."""
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(map(words, some)) for s, some in by.items()}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water_fill(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    taken = {}
    for s, some in by.items():
        epochs, rest = divmod(round(target[s]), sizes[s])
        at = 0
        for r in sorted(some, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
            taken[r.doc_id] = epochs * words(r) + min(words(r), max(0, rest - at))
            at += words(r)
    return {k: v for k, v in taken.items() if v}


@pytest.mark.skipif(not os.path.isdir(D), reason="test tables not there")
def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = factorization_machine.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    score = dict(zip(rows, model.score(pa.array([r.text or "" for r in rows.values()], pa.large_string()))))
    first = p.quality_classifier(spark, docs, D)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {i for i, s in score.items() if s >= factorization_machine.THRESHOLD}
    second = p.quality_rules(spark, first, D)
    kept = [r for r in second.collect()]
    assert second.columns == docs.columns and {r.doc_id for r in kept} == plain_kept(first.collect())
    third = p.near_duplicates(spark, second, D)
    classes = plain_classes([plain_fingerprint(r.text) for r in kept], [r.doc_id for r in kept])
    one = sorted(r.doc_id for r in third.collect())
    assert third.columns == docs.columns and one == sorted(set(classes))
    fourth = p.mixing(spark, third, D)
    assert fourth.columns == docs.columns
    words = {}
    for r in fourth.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.text == rows[r.doc_id].text or len(r.text) < len(rows[r.doc_id].text)
    assert words == plain_mix(third.collect())
    ranks, pattern = bitmap_bpe.production_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in fourth.collect() for ids in (library.encode_ordinary(r.text),))
    assert sorted(map(tuple, p.tokens(spark, fourth, D).collect())) == want


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    good = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"long{i}" for i in range(150_000))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good, None, None, None), (None, good + " x", "en", "b", 2), (3, None, "en", "a", 0), (4, long, "en", "b", 3)]
    # the good text once, under its least id, without its near copy, and the long one; the empty text fails the base rules
    for some, want in (([], set()), (rows, {1, 4})):
        docs = spark.createDataFrame(some, schema)
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        found = {r.doc_id for r in docs.collect()}
        assert found == want
        assert p.tokens(spark, docs, "").columns[0] == "doc_id" and p.tokens(spark, docs, "").count() == docs.count()


def test_rows_without_or_with_equal_ids_are_told_apart(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = lambda w: " ".join(f"{w}{i}" for i in range(80))
    rows = [(None, text("a"), "en", "s", 1), (None, text("b"), "en", "s", 1), (7, text("c"), "en", "s", 1), (7, text("d"), "en", "s", 1), (8, text("d"), "en", "s", 1), (None, text("c"), "en", "s", 1), (9, text("e"), "en", "s", 1), (9, text("e"), "en", "s", 1)]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "a"), (0, "b"), (7, "c"), (7, "d"), (9, "e")]
