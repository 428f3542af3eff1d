"""URL filter by a temporal list join.

List entries are dated changes: from ``listed_at`` on, ``pattern`` (a host, its subdomains included) has an
action, ``block`` or ``clear``. Per pattern the entries in order of time become validity intervals
[listed_at, next listed_at). A capture is judged by the entries active at its fetch time: its host and every
parent domain are looked up, an as-of join finds each one's interval, and the capture is blocked if the most
specific pattern with an active entry says so.

The join is an equi-join on the host suffixes of *distinct* (host, fetch time) pairs, so a host that holds a third of
all captures is joined once a time (once a day, if times are days); as-of is the interval predicate of that join. Up to
BROADCAST_ENTRIES intervals, counted, are broadcast, so that suffixes do not move at all. Beyond, suffixes and intervals
are shuffled, and patterns with more than HOT pairs, such as a listed top-level domain, are dealt over SALTS keys. Blocked
pairs are joined back to the captures.

Defined cases: an unparsable or null url has no host and is never blocked; an entry without pattern or date is
ignored; of several entries of a pattern at one time ``block`` wins; a capture without fetch time is never
blocked; repeated captures are judged each; empty tables on either side work; urls of any length have all their
suffixes looked up. Input columns keep their values; one that is called like a result (``host``, ``blocked``,
``decided_by``, in any case) comes out with ``input_`` before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

#: Days over which the demonstration tables of op2 spread captures and list changes.
SPAN, CHANGES = 360, 4
#: Intervals that are broadcast at most; pairs from which a pattern is dealt over SALTS keys when they are not.
BROADCAST_ENTRIES, HOT, SALTS = 200_000, 100_000, 64
RESULTS = ("host", "blocked", "decided_by")


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; null if there is none."""
    got = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(got, r"\.+$", ""), F.lit(""))


def suffixes(name: Column) -> Column:
    """The host and its parent domains, the most specific first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, since, until`` from ``pattern, action, listed_at``; until is null for the last."""
    at = entries.where("pattern is not null and listed_at is not null").groupBy(F.lower("pattern").alias("pattern"), F.col("listed_at").alias("since")).agg(F.min("action").alias("action"))
    return at.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since")))


def as_of(looked: DataFrame, spans: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, hot: int = HOT) -> DataFrame:
    """``_h, _f, _depth, pattern`` with the ``action`` of the pattern's interval that holds at ``_f``."""
    inside = (F.col("_f") >= F.col("since")) & (F.col("until").isNull() | (F.col("_f") < F.col("until")))
    if spans.count() <= broadcast_entries:
        return looked.join(F.broadcast(spans), "pattern").where(inside)
    many = looked.join(spans.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = F.broadcast(common.materialize(many.select("pattern", F.lit(SALTS).alias("_salts")), "hot"))  # at most pairs / hot rows
    salts = F.coalesce("_salts", F.lit(1))
    left = looked.join(many, "pattern", "left").withColumn("_salt", F.pmod(F.xxhash64("_h", "_f"), salts).cast("int"))
    right = spans.join(many, "pattern", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right.drop("_salts"), ["pattern", "_salt"]).where(inside)


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures with ``host, blocked, decided_by`` (the deciding pattern, null if none is active)."""
    names = list(RESULTS)
    for c in captures.columns:
        while c.lower() in names:
            c = f"input_{c}"
        names.append(c.lower())
    c = captures.select(F.struct(*[captures[x].alias(f"c{i}") for i, x in enumerate(captures.columns)]).alias("_row"), host(captures[url]).alias("_h"), captures[fetched].alias("_f"))
    pairs = c.where(F.col("_h").isNotNull() & F.col("_f").isNotNull()).select("_h", "_f").distinct()
    looked = pairs.select("_h", "_f", F.posexplode(suffixes(F.col("_h"))).alias("_depth", "pattern"))
    active = as_of(looked, common.materialize(intervals(entries), "intervals"))
    verdict = active.groupBy("_h", "_f").agg(F.min(F.struct("_depth", "pattern", "action")).alias("_best"))
    out = c.join(verdict, ["_h", "_f"], "left")
    shown = [F.col(f"_row.c{i}").alias(x if x.lower() == n else n[: len(n) - len(x)] + x) for i, (x, n) in enumerate(zip(captures.columns, names[len(RESULTS) :], strict=True))]
    return out.select(*shown, F.col("_h").alias("host"), F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"), F.col("_best.pattern").alias("decided_by"))


def demonstration(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries that a pages table implies.

    A page is fetched on day page_id * 7919 mod SPAN. Every host whose MD5 begins with a number divisible by 3
    and every second-level domain has CHANGES entries, at days that follow from its MD5, alternately blocking
    and clearing.
    """
    number = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 8), 16, 10).cast("long")
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(SPAN)).alias("fetched_at"))
    hosts = captures.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    listed = hosts.where(number("h") % 3 == 0).select(F.col("h").alias("pattern")).union(hosts.select(F.substring_index("h", ".", -2))).distinct()
    turns = listed.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(CHANGES - 1)))).withColumn("crc", number("pattern"))
    return captures, turns.select("pattern", F.when((F.col("crc") + F.col("n")) % 2 == 0, "block").otherwise("clear").alias("action"), F.pmod(F.col("crc") * (F.col("n") + 1) + F.col("n") * 97, F.lit(SPAN)).alias("listed_at"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = demonstration(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return judge(captures, entries).select("page_id", "host", "fetched_at", "blocked", "decided_by")


OP2_SQL = rf"""
WITH c AS (
  SELECT page_id, (page_id * 7919) % {SPAN} AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host FROM pages
), h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
listed AS (
  SELECT host AS pattern FROM h WHERE CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 3 = 0 UNION SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM h
), turns AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS x, n FROM listed, range(0, {CHANGES}) r(n)
), entries AS (
  SELECT pattern, (x * (n + 1) + n * 97) % {SPAN} AS since, min(CASE WHEN (x + n) % 2 = 0 THEN 'block' ELSE 'clear' END) AS action FROM turns GROUP BY 1, 2
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM entries
), looked AS (
  SELECT DISTINCT host, fetched_at, d AS depth, array_to_string(string_split(host, '.')[d:], '.') AS pattern FROM (SELECT host, fetched_at, unnest(range(1, len(string_split(host, '.')) + 1)) AS d FROM c WHERE host IS NOT NULL)
), verdict AS (
  SELECT host, fetched_at, arg_min(l.pattern, depth) AS decided_by, arg_min(action = 'block', depth) AS blocked
  FROM looked l JOIN spans s ON l.pattern = s.pattern AND fetched_at >= since AND (until IS NULL OR fetched_at < until) GROUP BY 1, 2
)
SELECT page_id, host, c.fetched_at, coalesce(blocked, false) AS blocked, decided_by FROM c LEFT JOIN verdict USING (host, fetched_at)
"""
