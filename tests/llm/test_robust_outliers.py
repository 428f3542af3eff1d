import random
import re

import numpy as np

from graphloom.llm import robust_outliers as r

SCHEMA = "doc_id bigint, text string, lang string, source string, kept string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(repeated), failed


def corpus():
    rng = random.Random(2)
    words = ["the", "of", "and", "water", "éclair", "house", "small", "river", "stone", "under", "a", "long"]
    out = [" ".join(rng.choices(words, k=rng.randint(60, 140))) for _ in range(400)]
    odd = [" ".join(w + "%%%" for w in t.split()) for t in out[:15]]
    edge = ["", None, " \n\t", "a b", "x " * 30, "one two three four five six seven eight " * 2 + "nine " * 3, "l1 a\nl1 a\n\n \nl2", "A\x0bB\x1cC é z", " ".join(rng.choices(words, k=200)) * 2]
    return out, odd, edge


def test_base_columns(spark):
    out, odd, edge = corpus()
    texts = out[:30] + odd[:3] + edge
    got = {x.doc_id: x for x in r.outliers(spark.createDataFrame([(i, t, None if i % 2 else "en", "s", "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(t), t
        assert not (x.kept and x.base_failed)


def test_outliers_go_and_clean_rows_stay(spark):
    out, odd, _ = corpus()
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 90}", "") for i, t in enumerate(out)] + [(1000 + i, t, "en", "hot", "") for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(r.outliers(df).select("doc_id", "kept", "distance").collect())
    kept = {x.doc_id: x.kept for x in first}
    assert all(kept[i] for i in range(len(out)))
    assert not any(kept[1000 + i] for i in range(len(odd)))
    assert first == sorted(r.outliers(df.repartition(7)).select("doc_id", "kept", "distance").collect())
    stay = r.keep_usual(df)
    assert stay.columns == df.columns and {x.doc_id for x in stay.collect()} == {k for k, v in kept.items() if v}


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 300, size=(80, 6))
    df = spark.createDataFrame([(1, *map(int, v)) for v in x], "gid int, " + ", ".join(f"_x_{n} bigint" for n in r.NAMES))
    sums = df.groupBy("gid").agg(*r._sums([r.F.col(f"_x_{n}") for n in r.NAMES])).withColumn("start", r.F.lit(0))
    got = r._distance(df.join(r._factor(sums), "gid")).orderBy(*[f"_x_{n}" for n in r.NAMES]).collect()
    z = x[np.lexsort(x.T[::-1])] / r.GRID
    cov = np.cov(z.T, bias=True) + np.diag([f**2 for f in r.FLOORS.values()])
    d = z - z.mean(0)
    assert np.allclose([g.d2 for g in got], np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))


FLOOR2 = np.diag([f**2 for f in r.FLOORS.values()])


def vector(text):
    """The six statistics on the grid, by plain string functions."""
    n_words, chars, symbols, dup, repeat, _ = plain(text)
    solid = "".join(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    rest = re.sub(r"[#*$%&|<>]", "", solid)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    upper, marks = len(re.findall("[A-Z]", rest)), len(re.findall(r"[0-9!?@^_~=+\\/\[\]{}]", rest))
    v = [np.log(max(chars, 1) / max(n_words, 1)), *np.sqrt([symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n_words, 1), upper / max(chars, 1), marks / max(chars, 1)])]
    return [int(np.floor(x * r.GRID + 0.5)) for x in v]


def bins(x, mean, cov):
    d = x - mean
    return np.floor(np.log(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + 1e-6) * 64)


def moments(x, w):
    mean = w @ x / w.sum()
    return mean, (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean) + FLOOR2


def concentrate(x, mean, cov):
    """The nearest H_SHARE by bins of the distance; the last bin counts in part."""
    b, h, w = bins(x, mean, cov), int(np.ceil(r.H_SHARE * len(x))), np.zeros(len(x))
    for one in np.unique(b):
        mine = b == one
        w[mine] = min(1.0, max(0.0, h - w.sum()) / mine.sum())
    return moments(x, w)


def lowest(x):
    """The estimate of least determinant by plain loops over the three starts."""
    med = np.median(x, axis=0)
    spread = np.sqrt((np.floor(np.median(np.abs(x - med) * r.GRID // 1, axis=0) * 2) / 2 / r.GRID * 1.4826) ** 2 + np.diag(FLOOR2))
    score = np.floor(np.tanh((x - med) / spread) * r.SCORES + 0.5) / r.SCORES
    bounded = np.cov(score.T, bias=True) + np.eye(6) / r.SCORES**2
    found = [(med, np.diag(spread**2)), (med, bounded * np.outer(spread, spread)), moments(x, np.ones(len(x)))]
    for _ in range(r.FIRST):
        found = [concentrate(x, *e) for e in found]
    mean, cov = min(found, key=lambda e: np.linalg.slogdet(e[1])[1])
    while True:
        new = concentrate(x, mean, cov)
        if np.linalg.slogdet(new[1])[1] >= np.linalg.slogdet(cov)[1] - 1e-9:
            return mean, cov
        mean, cov = new


def verdicts(x):
    mean, cov = lowest(x)
    b = bins(x, mean, cov)
    scale = lambda b: np.exp((np.sort(b)[(len(b) + 1) // 2 - 1] + 0.5) / 64) / r.CHI_MEDIAN
    mean, cov = moments(x, (b <= np.floor(np.log(scale(b) * r.CHI_INNER + 1e-6) * 64)).astype(float))
    c = max(1.0, scale(bins(x, mean, cov)))
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) / c


def mixed_corpus():
    rng = random.Random(8)
    words = ["the", "of", "and", "water", "éclair", "House", "small", "river", "stone", "2024", "a", "long!"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(rng.randint(2, 9))) for _ in range(150)]
    texts += [" ".join(w.upper() + "#" for w in t.split()) for t in texts[:20]]
    texts += [" ".join(rng.choices(["a", "b", "cd"], k=90)) for _ in range(9)]
    return [(i, t) for i, t in enumerate(texts)]


def test_verdict_against_numpy(spark):
    rows = mixed_corpus()
    got = {x.doc_id: x for x in r.outliers(spark.createDataFrame([(i, t, "en", "s" if i % 3 else f"s{i}", "") for i, t in rows], SCHEMA)).collect()}
    ok = [(i, t) for i, t in rows if not plain(t)[-1]]
    groups = [[i for i, _ in ok if i % 3], [i for i, _ in ok if not i % 3]]  # small sources are pooled by language
    texts = dict(ok)
    for ids in groups:
        assert len(ids) if len(ids) >= r.MIN_GROUP else True
        if len(ids) < r.MIN_GROUP:
            continue
        distance = verdicts(np.array([vector(texts[i]) for i in ids]) / r.GRID)
        assert np.allclose([got[i].distance for i in ids], distance, rtol=1e-6)
        assert [got[i].kept for i in ids] == list(distance <= r.CUTOFF)
    assert 0 < sum(not got[i].kept for i, _ in ok) < len(ok) / 2


def test_determinant_is_that_of_random_starts_or_less():
    x = np.array([vector(t) for _, t in mixed_corpus()]) / r.GRID
    own = np.linalg.slogdet(lowest(x)[1])[1]
    rng, least = np.random.default_rng(5), np.inf
    for _ in range(300):
        some = x[rng.choice(len(x), 12, replace=False)]
        mean, cov = moments(some, np.ones(12))
        for _ in range(30):
            mean, cov = concentrate(x, mean, cov)
        least = min(least, np.linalg.slogdet(cov)[1])
    assert own <= least + 1e-3


def test_one_extreme_statistic_is_enough(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "water", "house", "small", "river", "stone", "under", "long"]
    clean = [(i, "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(8)), "en", "s", "") for i in range(200)]
    short = [" ".join(rng.choices(words, k=3)) for _ in range(8)]
    lines = short * 5
    rng.shuffle(lines)
    got = {x.doc_id: x for x in r.outliers(spark.createDataFrame([*clean, (999, "\n".join(lines), "en", "s", "")], SCHEMA)).collect()}
    assert got[999].n_dup_lines == 32 and (got[999].base_failed or not got[999].kept)
    assert all(got[i].kept for i in range(200))


def test_very_long_text_and_clashing_names(spark):
    text = "word another third " * 200_000
    df = spark.createDataFrame([(1, text, "en", "s", "k", 3, 4)], SCHEMA + ", distance int, n_words int")
    assert [(x.n_words, x.base_failed) for x in r.outliers(df).collect()] == [(600_000, True)]
    assert r.keep_usual(df).columns == df.columns


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert r.outliers(empty).collect() == [] and r.keep_usual(empty).collect() == []
