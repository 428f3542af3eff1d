"""Quality rules by robust multivariate outlyingness: minimum covariance determinant per language and source.

Each text's statistics are transformed to a vector (logarithm of the mean word length, square roots of shares)
on a fixed grid of 1/GRID. Groups are (lang, source); sources with fewer than MIN_GROUP rows are pooled by
language, and languages as small in one rest group. In each group the estimate starts at three places: coordinate medians
with median deviations, the same centre with the covariance of the bounded (tanh) scores, and mean and
covariance of all rows. A concentration step takes the mean and covariance of the H_SHARE of rows with the smallest
Mahalanobis distances; after FIRST steps of each start the one of least determinant goes on, until a step lowers the
determinant no more (MAX_STEPS bounds the steps). One reweighting step follows. FLOORS add to the variances, as many
statistics are zero in most texts; determinants are those of the sums. Rows whose robust squared distance exceeds
CUTOFF are rejected, apart from those that already fail the base rules.

Everything is DataFrame expressions. A step is one pass over the rows, which adds up integer moments by group and
bin of the distance (1/64 of an e-fold); the last bin that the H_SHARE takes counts with the weight that makes the share
exact, so ties do not change its size. Order statistics are taken of integer bins and sums of integers, so memory is
bounded by the grid, hot groups combine before the shuffle, and reruns agree to the bit. Estimates
(one row per group) are broadcast only when they are counted to be at most BROADCAST_GROUPS.

Defined cases: a null text is an empty one; a text without words fails the base rules; null lang or source are
groups of their own; groups too small for any estimate keep what the base rules keep; rows at equal distances share one
verdict; repeated rows count and come out each; very long texts are one row like any other; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

WINDOW = 8
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Statistics of the vector, and the standard deviation that is added to each one's spread.
FLOORS = {"word_len": 0.08, "symbols": 0.06, "dup_lines": 0.12, "repeats": 0.18, "upper": 0.06, "marks": 0.1}
GRID = 256
H_SHARE, FIRST, MAX_STEPS, MIN_GROUP = 0.75, 2, 50, 60
#: Steps of the bounded scores in the second start.
SCORES = 64
#: Chi-square quantiles of six degrees of freedom: median, 0.975, and 0.9999 as the rejection limit.
CHI_MEDIAN, CHI_INNER, CUTOFF = 5.348, 14.449, 27.856
BROADCAST_GROUPS = 50_000
NAMES = list(FLOORS)
UPPER, SYMBOLS, MARKS = r"[A-Z]+", r"[#*$%&|<>]+", r"[0-9!?@^_~=+\\/\[\]{}]+"


def statistics(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and the grid vector ``_x_*``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_t", text)
    d = d.withColumn("_w", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""))
    d = d.withColumn("_solid", F.array_join("_w", ""))
    d = d.withColumn("_plain", F.regexp_replace("_solid", SYMBOLS, ""))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({"n_words": F.size("_w").cast("long"), "word_chars": F.char_length("_solid").cast("long"), "n_symbols": (F.char_length("_solid") - F.char_length("_plain")).cast("long")})
    d = d.withColumn("_upper", F.char_length("_plain") - F.char_length(F.regexp_replace("_plain", UPPER, "")))
    d = d.withColumn("_marks", F.char_length("_plain") - F.char_length(F.regexp_replace("_plain", MARKS, "")))
    d = d.withColumns({"_n_lines": F.size("_lines"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    # hashes of all windows; texts that repeat none are done
    d = d.withColumn("_h", F.expr(f"if(size(_w) >= {WINDOW}, transform(sequence(1, greatest(1, size(_w) - {WINDOW - 1})), i -> xxhash64(slice(_w, i, {WINDOW}))), array())"))
    d = d.withColumn("_again", F.expr("size(array_distinct(_h)) < size(_h)"))
    d = d.withColumn("_s", F.expr("if(_again, array_sort(transform(_h, (h, i) -> struct(h, i))), null)"))
    d = d.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> coalesce(x.h = get(_s, i - 1).h, false) or coalesce(x.h = get(_s, i + 1).h, false)), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform(_p, (p, k) -> least({WINDOW}, get(_p, k + 1) - p)), 0, (a, b) -> a + b), 0)").cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    vector = {
        "word_len": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("_upper") / chars),
        "marks": F.sqrt(F.col("_marks") / chars),
    }
    # the row number is a fence: filters on the statistics that also name it are not pushed below, where every
    # higher-order function would be written out inside the next one's lambda and run once per element
    d = d.withColumns({f"_x_{k}": F.round(v * GRID).cast("long") for k, v in vector.items()} | {"_fence": F.monotonically_increasing_id()})
    return d.drop("_t", "_w", "_solid", "_plain", "_lines", "_upper", "_marks", "_n_lines", "_h", "_again", "_s", "_p")


def by_group(df: DataFrame, groups: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    """Join one row per group; broadcast only if they are counted to be few (``few``, if they have been)."""
    few = groups.count() <= BROADCAST_GROUPS if few is None else few
    return df.join(F.broadcast(groups) if few else groups, keys, "left")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _factor(moments: DataFrame, grid: int = GRID, floors: list[float] | None = None) -> DataFrame:
    """Means ``m_*``, the inverse ``k_*_*`` of the Cholesky factor of covariance plus floors, and the logarithmic determinant
    of that sum, from sums ``n, s_*, q_*_*``. Give it a table without a plan behind it: every column is a step of the plan.
    """
    p, floors = len(NAMES), floors or list(FLOORS.values())
    mean = [F.col(f"m_{i}") for i in range(p)]
    g = moments.where("n > 0").select("gid", "start", *[(F.col(f"s_{i}") / F.col("n") / grid).alias(f"m_{i}") for i in range(p)], "n", *[f"q_{i}_{j}" for i in range(p) for j in range(i + 1)])
    low = lambda i, j: F.col(f"l_{i}_{j}")
    for j in range(p):  # column by column
        rest = {}
        for i in range(j, p):
            c = F.col(f"q_{i}_{j}") / F.col("n") / (grid * grid) - mean[i] * mean[j]
            for k in range(j):
                c = c - low(i, k) * low(j, k)
            rest[i] = c
        least = F.lit(floors[j] ** 2)
        g = g.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest.pop(j) + least, least)))
        if rest:
            g = g.withColumns({f"l_{i}_{j}": c / low(j, j) for i, c in rest.items()})
    logdet = sum((2 * F.log(low(i, i)) for i in range(1, p)), 2 * F.log(low(0, 0)))
    for i in range(p):  # row by row
        own = {f"k_{i}_{i}": 1 / low(i, i)}
        for j in range(i):
            own[f"k_{i}_{j}"] = -sum((low(i, k) * F.col(f"k_{k}_{j}") for k in range(j + 1, i)), low(i, j) * F.col(f"k_{j}_{j}")) / low(i, i)
        g = g.withColumns(own)
    return g.select("gid", "start", *mean, *INVERSE, logdet.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2``: the squared length of L^-1 (x - m)."""
    away = [F.col(f"_x_{name}") / GRID - F.col(f"m_{i}") for i, name in enumerate(NAMES)]
    parts = [F.pow(sum((F.col(f"k_{i}_{j}") * away[j] for j in range(1, i + 1)), F.col(f"k_{i}_0") * away[0]), F.lit(2.0)) for i in range(len(NAMES))]
    return df.withColumn("d2", sum(parts[1:], parts[0]))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + F.lit(1e-6)) * 64).cast("long")


def _sums(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{i}") for i, a in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in range(len(x)) for j in range(i + 1)]]


INVERSE = [f"k_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)]
MOMENTS = [*[f"s_{i}" for i in range(len(NAMES))], *[f"q_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)]]


def _binned(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """Integer moments of each group, start and bin of the distance, with the rows ``before`` it and in ``total``."""
    d = _distance(by_group(rows, est, ["gid"], few)).withColumn("bin", _bin(F.col("d2")))
    b = d.groupBy("gid", "start", "bin").agg(*_sums([F.col(f"_x_{n}") for n in NAMES]))
    own = Window.partitionBy("gid", "start")
    return b.withColumns({"before": F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(own)})


def _concentrate(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """One step: estimates from the H_SHARE of each group's rows that are nearest."""
    b = _binned(rows, est, few).withColumn("h", F.ceil(F.col("total") * F.lit(H_SHARE)))
    whole = F.col("before") + F.col("n") <= F.col("h")
    edge = ~whole & (F.col("before") < F.col("h"))  # one bin at most
    share = (F.col("h") - F.col("before")) / F.col("n")
    taken = [(F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(edge, F.col(c) * share)), F.lit(0.0))).alias(c) for c in MOMENTS]
    return _factor(common.materialize(b.groupBy("gid", "start").agg(F.max("h").alias("n"), *taken), "moments"))


def _scale(median: Column) -> Column:
    return F.exp((median + F.lit(0.5)) / 64) / F.lit(CHI_MEDIAN)


def _median() -> Column:
    return F.min(F.when(2 * (F.col("before") + F.col("n")) >= F.col("total"), F.col("bin")))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """The three first estimates of each group."""
    p = range(len(NAMES))
    med = common.materialize(rows.groupBy("gid").agg(*[F.percentile(f"_x_{n}", 0.5).alias(f"a_{i}") for i, n in enumerate(NAMES)]), "medians")
    off = by_group(rows, med, ["gid"], few)
    mad = off.groupBy("gid").agg(*[F.first(f"a_{i}").alias(f"a_{i}") for i in p], *[F.percentile(F.abs(F.col(f"_x_{n}") - F.col(f"a_{i}")).cast("long"), 0.5).alias(f"b_{i}") for i, n in enumerate(NAMES)])
    # medians and spreads in units of the statistics
    mad = common.materialize(mad.select("gid", *[(F.col(f"a_{i}") / GRID).alias(f"a_{i}") for i in p], *[F.sqrt((F.col(f"b_{i}") * 1.4826 / GRID) ** 2 + F.lit(FLOORS[n] ** 2)).alias(f"b_{i}") for i, n in enumerate(NAMES)]), "spreads")
    centre = [F.col(f"a_{i}").alias(f"m_{i}") for i in p]
    diagonal = mad.select("gid", F.lit(0).alias("start"), *centre, *[(1 / F.col(f"b_{i}") if i == j else F.lit(0.0)).alias(f"k_{i}_{j}") for i in p for j in range(i + 1)])
    score = [F.round(F.tanh((F.col(f"_x_{n}") / GRID - F.col(f"a_{i}")) / F.col(f"b_{i}")) * SCORES).cast("long") for i, n in enumerate(NAMES)]
    sums = common.materialize(by_group(rows, mad, ["gid"], few).groupBy("gid").agg(*_sums(score)).withColumn("start", F.lit(1)), "moments")
    bounded = _factor(sums, SCORES, [1 / SCORES] * len(NAMES)).select("gid", "start", *INVERSE)
    bounded = bounded.join(mad, "gid").select("gid", "start", *centre, *[(F.col(f"k_{i}_{j}") / F.col(f"b_{j}")).alias(f"k_{i}_{j}") for i in p for j in range(i + 1)])
    sums = common.materialize(rows.groupBy("gid").agg(*_sums([F.col(f"_x_{n}") for n in NAMES])).withColumn("start", F.lit(2)), "moments")
    every = _factor(sums).drop("logdet")
    return common.materialize(diagonal.unionByName(bounded).unionByName(every), "estimates")


def group_ids(vectors: DataFrame) -> DataFrame:
    """``_lang, _source -> gid``: the group itself, or what it is pooled into."""
    counts = vectors.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    langs = counts.where(small).groupBy("_lang").agg((F.sum("n") >= MIN_GROUP).alias("enough"))
    return counts.join(langs, "_lang", "left").select("_lang", "_source", F.when(~small, F.struct(F.col("_lang"), F.col("_source"))).when(F.col("enough"), F.struct(F.col("_lang"), F.lit("*").alias("_source"))).otherwise(F.struct(F.lit("*").alias("_lang"), F.lit("*").alias("_source"))).alias("gid"))


def fit(stats: DataFrame) -> DataFrame:
    """Estimates by (lang, source): ``_lang, _source, gid``, means ``m_*``, inverse factors ``k_*_*``, scale ``c``."""
    v = stats.where(~F.col("base_failed") & (F.col("_fence") >= 0)).select(_key("lang").alias("_lang"), _key("source").alias("_source"), *[f"_x_{n}" for n in NAMES])
    v = common.materialize(v, "vectors")
    ids = common.materialize(group_ids(v), "groups")
    few = 3 * ids.count() <= BROADCAST_GROUPS  # three starts each
    rows = by_group(v, ids, ["_lang", "_source"], few).drop("_lang", "_source")
    est = _starts(rows, few)
    for _ in range(FIRST):
        est = common.materialize(_concentrate(rows, est, few), "estimates")
    first = F.row_number().over(Window.partitionBy("gid").orderBy("logdet", "start"))
    est = common.materialize(est.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("done", F.lit(False)), "estimates")
    for _ in range(MAX_STEPS):
        if est.where("not done").isEmpty():
            break
        going = est.where("not done").drop("done")
        new = _concentrate(rows.join(F.broadcast(going.select("gid")) if few else going.select("gid"), "gid", "left_semi"), going, few)
        new = new.select("gid", F.struct(*[c for c in new.columns if c != "gid"]).alias("_new"))
        both = est.select("gid", "done", F.struct(*[c for c in est.columns if c not in ("gid", "done")]).alias("_old")).join(new, "gid", "left")
        better = ~F.col("done") & F.coalesce(F.col("_new.logdet") < F.col("_old.logdet") - F.lit(1e-9), F.lit(False))
        est = common.materialize(both.select("gid", F.when(better, F.col("_new")).otherwise(F.col("_old")).alias("_e"), (~better).alias("done")).select("gid", "_e.*", "done"), "estimates")
    # reweighting: all rows within the inner quantile of the scaled distances
    b = _binned(rows, est.drop("done"), few)
    limit = b.groupBy("gid").agg(_bin(_scale(_median()) * F.lit(CHI_INNER)).alias("limit"))
    inner = common.materialize(b.join(limit, "gid").where("bin <= limit").groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in ["n", *MOMENTS]]), "moments")
    est = common.materialize(_factor(inner).drop("logdet"), "estimates")
    scale = _binned(rows, est, few).groupBy("gid").agg(F.max("total").alias("n"), F.greatest(F.lit(1.0), _scale(_median())).alias("c"))
    est = est.drop("start").join(scale.where(F.col("n") >= MIN_GROUP), "gid")
    return common.materialize(ids.join(est, "gid"), "fitted")


def judge(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``distance`` (robust squared distance, null without an estimate) and ``kept``."""
    d = by_group(stats.withColumns({"_lang": _key("lang"), "_source": _key("source")}), fitted, ["_lang", "_source"])
    d = _distance(d).withColumn("distance", F.col("d2") / F.col("c"))
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(CUTOFF), F.lit(True)))


def outliers(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``."""
    stats = common.materialize(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return judge(stats, fit(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_usual(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    one = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "lang", "source")
    stats = common.materialize(statistics(one).drop("text"), "statistics")  # once, as they cost more than a copy of the texts
    return judge(stats, fit(stats.drop("_doc"))).where("kept").select("_doc.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
