import numpy as np

from graphloom.llm import incremental_mih as m

SCHEMA = "vec_id bigint, embedding array<float>, code string"


def plain(rows, k):
    code = {}
    have = [(i, sum(1 << b for b, x in enumerate(v[:64]) if x > 0)) for i, v in rows if i is not None and v is not None]
    out = []
    for q, c in have:
        if q % 50 == 0:
            out += [(q, r, i, d) for r, (d, i) in enumerate(sorted((bin(c ^ x).count("1"), i) for i, x in have)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10):
    codes = m.codes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    return sorted(map(tuple, m.search(codes, codes.where("id % 50 = 0"), k).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * 0.4).tolist()) for i in range(700)]
    rows += [(1000 + i, base[0].tolist()) for i in range(60)] + [(50, base[0].tolist()), (50, base[0].tolist()), (None, base[0].tolist()), (3, None), (2000, []), (2050, [1.0])]
    assert run(spark, rows) == plain(rows, 10)


def test_few_rows(spark):
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64)]
    assert run(spark, rows) == plain(rows, 10)
    assert run(spark, []) == []


def test_radius_grows_only_as_far_as_needed():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    index, ids, off = m.Index(code), np.arange(len(code)), np.arange(len(code) + 1)
    probed = []
    probe = index.probe
    index.probe = lambda q, s, r: (probed.append((r, s)), probe(q, s, r))[1]
    far, _ = index.search(code[5], 1, ids, off)
    assert far.tolist() == [0] and probed == [(0, 0)]
    q = np.uint64(12345678901234567890)
    far, near = index.search(q, 7, ids, off)
    d = np.bitwise_count(code ^ q)
    order = np.lexsort((ids, d))[:7]
    assert far.tolist() == d[order].tolist() and near.tolist() == order.tolist()
