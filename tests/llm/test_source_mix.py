import pytest

from graphloom.llm import source_mix as m

SCHEMA = "doc_id bigint, text string, source string, target string"


def rows(spark):
    out = [(i, "w " * (i % 7 + 1), f"s{i % 4}", "x") for i in range(120)]
    return [*out, (500, None, "s0", "x"), (501, "", None, "x"), (502, "a\x0bb c", None, "x"), (502, "a\x0bb c", None, "x")]


def water_fill(sizes, weights):
    total, left, target = sum(sizes.values()), dict(weights), {}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            del left[s]


def test_targets_and_taken(spark):
    data = rows(spark)
    got = m.taken(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, _ in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    source = {i: s for i, _, s, _ in data}
    words = dict.fromkeys(names, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        words[s] += r.taken
    for s in names:
        assert words[s] == round(want[s])
    assert sorted(got) == sorted(m.taken(spark.createDataFrame(data, SCHEMA).repartition(3)).collect())


def test_mixed_documents(spark):
    docs = spark.createDataFrame(rows(spark), SCHEMA)
    take = {r.doc_id: r.taken for r in m.taken(docs, 16).groupBy("doc_id").sum("taken").toDF("doc_id", "taken").collect()}
    mixed = m.mixed_documents(docs, 16)
    assert mixed.columns == docs.columns
    slots = [r.slot for r in m.mixed_documents(docs, 16, slot="slot").collect()]
    assert len(slots) == mixed.count() and min(slots) == 0
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in take.items() if v}


def test_empty(spark):
    assert m.taken(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.taken for r in m.taken(spark.createDataFrame([(1, None, None, "")], SCHEMA)).collect()] == [0]
    assert m.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000, 10**6])
def test_targets_at_any_block_and_source_size(spark, block):
    """Sources of 1, 9, 40 words next to one of 30,000, blocks longer than a source and single words."""
    data = [(i, "w " * 300, "big", "") for i in range(100)] + [(200, "one", "a", ""), (201, "w " * 9, "b", ""), (202, "w " * 20, "c", ""), (203, "w " * 20, "c", "")]
    got = m.taken(spark.createDataFrame(data, SCHEMA), block).collect()
    source = {i: s for i, _, s, _ in data}
    words, target = {}, {}
    for r in got:
        words[source[r.doc_id]] = words.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"]
    assert words == {s: round(t) for s, t in target.items()}


def test_schedule_is_low_discrepancy(spark):
    """Every source gets its blocks once each, and every stretch of the points holds it in proportion."""
    data = [(i, "w " * n, s, "") for i, (s, n) in enumerate([("a", 4000), ("b", 2500), ("c", 700), ("d", 30), ("e", 1)])]
    sizes = spark.createDataFrame(data, SCHEMA).select("doc_id", m.source_key(m.F.col("source")).alias("skey"), m.n_words(m.F.col("text")).alias("size"))
    sources, n, slots = m.source_targets(sizes, 10)
    rows = {r.sid: r.slots for r in sources.collect()}
    assert (n, slots) == (5, sum(rows.values()))
    plan = sorted(m.schedule(spark, sources, n, slots).collect())
    for sid, want in rows.items():
        assert [r.rank for r in plan if r.sid == sid] == list(range(want))
        for at in range(0, slots, 37):
            assert abs(sum(r.sid == sid and r.slot < at for r in plan) - at * want / slots) <= 4
    assert len({r.slot for r in plan}) == slots
    golden = (5**0.5 - 1) / 2
    ends, total = {}, 0
    for sid in sorted(rows):
        total += rows[sid]
        ends[sid] = total / slots
    for r in plan:
        if r.slot < slots:
            assert r.sid == next(s for s in sorted(ends) if r.slot * golden % 1 < ends[s])


def test_equal_rows_with_other_columns(spark):
    """Repeated rows and rows that differ in other columns only: all are taken as often as their texts, in any order of rows."""
    data = [(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (1, "a b c", "s", "x"), (None, "a b c", "s", "x"), (None, "d", "s", "x"), (2, "a b c", None, "z")]
    one = sorted(map(tuple, m.mixed_documents(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    two = sorted(map(tuple, m.mixed_documents(spark.createDataFrame(data[::-1], SCHEMA).repartition(3)).collect()), key=str)
    assert one == two
    assert sum(len(r[1].split()) for r in one) == sum(r.taken for r in m.taken(spark.createDataFrame(data, SCHEMA)).collect())


def test_running_sums(spark):
    from graphloom.llm import common

    df = spark.range(50).select((m.F.col("id") * 7 % 50).alias("k"))
    got = {r.k: (r.place, r.before) for r in common.running(df, ["k"], {"place": m.F.lit(1), "before": m.F.col("k")}).collect()}
    assert got == {k: (k, k * (k - 1) // 2) for k in range(50)}
    assert common.running(df.limit(0), ["k"], {"place": m.F.lit(1)}).count() == 0
