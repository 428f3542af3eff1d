"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source, shuffled by a digest of their ids, form one stream of words cut into equal blocks. A
source whose target is t takes its whole stream (t div size) times and then the stream's first (t mod size)
words, so it needs that many blocks. Slots 0, 1, 2, ... carry the golden-ratio points frac(i * phi), as integers of
POINT_BITS bits; a point falls into one source's span of the cumulative numbers of blocks, so every stretch of the
schedule holds each source in proportion. The slots of a source are ranked; rank r takes block r mod n in epoch r
div n. A source gets as many slots as it has blocks to give: points beyond them are left out, and the few blocks
that the points of its span did not reach come after the last point. So the words taken are the target rounded,
whatever the size of a source, a block or the corpus. Nothing is drawn at random, so reruns agree.

A block has ``block`` words, in a source of fewer than LEAST_BLOCKS of them a LEAST_BLOCKS-th of the source. Running sums
over documents are taken in hash-range buckets and then over buckets, and those over sources by range partitions, so that
no task holds a whole source or all sources.

Defined cases: a null text has size 0; a document without words is never taken; null sources form one source
that comes last; repeated rows count each; documents of equal digest come in the order of id, size and text;
very long texts lie in many blocks; an empty table gives an empty table; other columns are ignored, of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

#: Words of a block, and blocks that a source is cut into at least (if it has as many words).
BLOCK_WORDS, LEAST_BLOCKS = 1024, 64
#: Sources weigh these in turn.
CYCLE = (1, 2, 3)
#: A source's words are repeated so often at most.
MAX_EPOCHS = 3
#: Documents in a bucket of the running sums, slots in a chunk of the ranking.
BUCKET_DOCS, CHUNK_SLOTS = 4096, 4096
#: A table of sources with more rows than this is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000
#: Points are multiples of the inverse golden ratio modulo 1, in units of 2 ** -POINT_BITS.
POINT_BITS, HALF_BITS = 42, 20
STEP = 2718142227965  # 2 ** 42 / 1.6180339887..., which is odd


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, int, int]:
    """One row per source: ``skey, sid, weight, source_size, n_docs, target, whole, length, n_blocks, slots, lo, hi``; and
    the numbers of sources and of slots.

    Targets share the total by weight; one above MAX_EPOCHS times its source's size stops there and the
    excess is reshared by weight, until none is above. ``whole`` is the target in whole words, ``slots`` the blocks that
    it takes, [lo, hi) the source's span of the points.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = common.running(per, [F.col("skey").startswith("n").cast("int"), F.col("skey")], {"place": F.lit(1)})
    ranked = ranked.select("skey", (F.col("place") + 1).alias("sid"), F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.col("place") % len(CYCLE) + 1).cast("int")).cast("long").alias("weight"), "source_size", "n_docs")
    ranked = common.materialize(ranked, "sources")
    n_sources, total, weights = ranked.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    held, size = 0, F.col("source_size").cast("decimal(18,0)")
    while True:  # more stop at every turn, as the others' shares grow
        stopped = F.lit(MAX_EPOCHS) * size * F.lit(weights).cast("decimal(18,0)") < F.col("weight").cast("decimal(2,0)") * F.lit(total - MAX_EPOCHS * held).cast("decimal(20,0)")
        now = ranked.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        if (held, weights) == tuple(now):
            break
        held, weights = now
    target = F.when(stopped, (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(F.col("weight").cast("double") * F.lit(float(total - MAX_EPOCHS * held)) / F.lit(float(max(weights, 1))))
    cut = ranked.withColumn("target", target).withColumn("whole", F.round("target").cast("long"))
    cut = cut.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / F.lit(LEAST_BLOCKS)))).cast("long"))
    cut = cut.withColumn("n_blocks", F.expr("(source_size + length - 1) div length"))
    cut = cut.withColumn("slots", F.expr("if(source_size = 0, 0, (whole div source_size) * n_blocks + (whole % source_size + length - 1) div length)").cast("long"))
    cut = common.materialize(common.running(cut, ["sid"], {"ahead": F.col("slots")}), "sources")
    n_slots = cut.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    point = lambda c: F.expr(f"cast({c} as decimal(18,0)) * cast({1 << POINT_BITS} as decimal(14,0)) div cast({max(n_slots, 1)} as decimal(18,0))")
    return cut.select(*[c for c in cut.columns if c != "ahead"], point("ahead").alias("lo"), point("ahead + slots").alias("hi")), n_sources, n_slots


def join_sources(df: DataFrame, sources: DataFrame, n_sources: int, on: str) -> DataFrame:
    """Join on the source: broadcast up to BROADCAST_SOURCES rows, else by shuffle (where AQE splits hot keys)."""
    return df.join(F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources, on)


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """The schedule: ``slot, sid, rank``, of each source every rank below its ``slots`` once, in the order of slots."""
    whole, half = 1 << POINT_BITS, 1 << HALF_BITS
    width = max(1, whole // (4 * n_sources))
    spans = sources.where("slots > 0").select("sid", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin"))
    # slot * STEP modulo 2 ** POINT_BITS, in two parts that fit a long
    point = F.expr(f"(((id % {half}) * {STEP}) % {whole} + ((id div {half}) * {STEP * half % whole}) % {whole}) % {whole}")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("p")).withColumn("bin", F.expr(f"p div {width}"))
    hit = points.join(F.broadcast(spans) if n_sources <= BROADCAST_SOURCES else spans, "bin").where("p >= lo and p < hi")
    hit = common.materialize(hit.select("slot", "sid", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk")), "slots")
    chunks = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("sid", "chunk", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    ranked = hit.join(chunks, ["sid", "chunk"]).select("slot", "sid", (inside - 1 + F.col("earlier")).cast("long").alias("rank"))
    ranked = join_sources(ranked, sources.select("sid", "slots"), n_sources, "sid").where("rank < slots").select("slot", "sid", "rank")
    got = hit.groupBy("sid").agg(F.count("*").alias("got"))
    short = sources.select("sid", "slots").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    short = common.running(short, ["sid"], {"ahead": F.col("slots") - F.col("got")})
    late = short.select("sid", "ahead", F.posexplode(F.expr("sequence(got, slots - 1)")).alias("at", "rank")).select((F.lit(n_slots) + F.col("ahead") + F.col("at")).alias("slot"), "sid", "rank")
    return ranked.unionByName(late)


def streams(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Each document's place in its source's shuffled stream of words: adds ``start``."""
    d = join_sources(sizes, sources.select("skey", "sid", "source_size", "target", "n_docs", "length"), n_sources, "skey")
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.ceil(F.col("n_docs") / F.lit(BUCKET_DOCS))).cast("long"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(in_order), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("sid", "bucket").orderBy("shuffle", "doc_id", "size", "thash").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(sums, ["sid", "bucket"]).withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("earlier")).drop("earlier", "bucket")


def mix(docs: DataFrame, block: int = BLOCK_WORDS, text: str = "text", source: str = "source", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Plan a mix: documents with their place, and the blocks taken.

    Documents: ``doc_id, thash, skey, sid, size, source_size, target, length, start``. Blocks: ``sid, block, begin, takes``, an
    array of at most MAX_EPOCHS ``epoch, until, slot``: the words [begin, until) of the source's stream come at that slot.
    """
    spark = docs.sparkSession
    sizes = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[text]).alias("thash"), source_key(docs[source]).alias("skey"), n_words(docs[text]).alias("size"), F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")).alias("shuffle"))
    sizes = common.materialize(sizes, "sizes")
    sources, n_sources, n_slots = source_targets(sizes, block)
    sources = common.materialize(sources, "sources")
    placed = common.materialize(streams(sizes, sources, max(1, n_sources)), "placed")
    if n_slots == 0:
        return placed, spark.createDataFrame([], "sid long, block long, begin long, takes array<struct<epoch long, until long, slot long>>")
    at = join_sources(schedule(spark, sources, n_sources, n_slots), sources.select("sid", "source_size", "whole", "length", "n_blocks"), n_sources, "sid")
    at = at.select("sid", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("epoch"), "slot", "source_size", "whole", "length").withColumn("begin", F.col("block") * F.col("length"))
    end = F.when(F.col("epoch") == F.expr("whole div source_size"), F.expr("whole % source_size")).otherwise(F.col("source_size"))
    at = at.withColumn("until", F.least(F.col("begin") + F.col("length"), end))
    return placed, at.groupBy("sid", "block").agg(F.first("begin").alias("begin"), F.array_sort(F.collect_list(F.struct("epoch", "until", "slot"))).alias("takes"))


def overlaps(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``sid, start, size, epoch, words, slot``: the words of a document in each block taken that it meets."""
    met = placed.where("size > 0").select("sid", "start", "size", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    each = met.join(blocks, ["sid", "block"]).select("sid", "start", "size", "begin", F.explode("takes").alias("t"))
    words = F.least(F.col("start") + F.col("size"), F.col("t.until")) - F.greatest("start", "begin")
    return each.select("sid", "start", "size", F.col("t.epoch").alias("epoch"), words.cast("long").alias("words"), F.col("t.slot").alias("slot")).where("words > 0")


def taken(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    placed, blocks = mix(docs, block)
    got = overlaps(placed, blocks).groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    # places are unique among documents with words; one without words shares its place with the next and takes none
    some = placed.where("size > 0").join(got, ["sid", "start"], "left")
    both = some.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return both.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, slot: str | None = None) -> DataFrame:
    """The mix as documents: one row for each epoch that takes a document, with the columns of ``docs``.

    A document taken whole keeps its text; of one that the end of its source's target cuts, the words taken remain, joined
    by blanks. ``slot`` names a further column (none of ``docs``): the schedule's slot at which the copy begins, to
    order the training data by.
    """
    placed, blocks = mix(docs, block)
    spans = overlaps(placed, blocks).groupBy("sid", "start", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    spans = spans.groupBy("sid", "start").agg(F.array_sort(F.collect_list(F.struct("epoch", "words", "slot"))).alias("_spans"))  # at most MAX_EPOCHS
    copy = F.row_number().over(Window.partitionBy("doc_id", "thash", "skey").orderBy("start"))
    named = placed.where("size > 0").withColumn("_copy", copy)
    spans = named.join(spans, ["sid", "start"]).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("thash").alias("_hash"), F.col("skey").alias("_key"), "_copy", F.col("size").alias("_size"), "_spans")
    same = ["_id", "_hash", "_key", "_copy"]
    whole = docs.select("*", F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("_id"), F.xxhash64(docs["text"]).alias("_hash"), source_key(docs["source"]).alias("_key"))
    # rows of one id, source and text come in the order of their other columns' digest
    whole = whole.withColumn("_row", F.xxhash64(*[docs[c] for c in docs.columns]))
    numbers = whole.select("_id", "_hash", "_key", "_row").withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_hash", "_key").orderBy("_row")))
    spans = numbers.join(spans, same).groupBy("_id", "_hash", "_key", "_row").agg(F.max("_size").alias("_size"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.count("*").alias("_of"))
    first = whole.dropDuplicates(["_id", "_hash", "_key", "_row"])
    got = first.join(spans, ["_id", "_hash", "_key", "_row"]).withColumn("_span", F.explode("_spans"))
    part = F.concat_ws(" ", F.slice(F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), ""), 1, F.col("_span.words").cast("int")))
    got = got.withColumn("text", F.when(F.col("_span.words") == F.col("_size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns, *([F.col("_span.slot").alias(slot)] if slot else []))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle, coalesce('s' || source, 'n') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY (skey LIKE 'n%')::INT, skey) AS sid FROM d GROUP BY skey
), weighed AS (
  SELECT *, 1 + (sid - 1) % 3 AS weight FROM per
), run AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size * 6 / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
    sum(weight) OVER (ORDER BY source_size * 6 / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), stop AS (
  SELECT *, 3 * source_size * rest < weight * (total - 3 * earlier) AS stopped FROM run
), target AS (
  SELECT skey, sid, source_size, total, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE)
    * CAST(total - 3 * sum(CASE WHEN stopped THEN source_size ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM stop
), cut AS (
  SELECT *, CAST(round(target) AS BIGINT) AS whole,
    CAST(greatest(1, least({BLOCK_WORDS}, ceil(source_size / {LEAST_BLOCKS}.0))) AS BIGINT) AS length FROM target
), slots AS (
  SELECT *, (source_size + length - 1) // length AS n_blocks,
    CASE WHEN source_size = 0 THEN 0 ELSE (whole // source_size) * ((source_size + length - 1) // length) + (whole % source_size + length - 1) // length END AS n_slots
  FROM cut
), given AS (
  SELECT *, rank % n_blocks AS block, rank // n_blocks AS epoch FROM (SELECT *, unnest(range(0, n_slots)) AS rank FROM slots)
), block AS (
  SELECT sid, block, block * length AS begin, least(block * length + length, CASE WHEN epoch = whole // source_size THEN whole % source_size ELSE source_size END) AS until FROM given
), placed AS (
  SELECT d.*, s.sid, s.source_size, s.target, s.length, CAST(coalesce(sum(size) OVER (PARTITION BY s.sid ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN slots s USING (skey)
), met AS (
  SELECT sid, start, size, unnest(range(start // length, (start + size - 1) // length + 1)) AS block FROM placed WHERE size > 0
), got AS (
  SELECT sid, start, sum(greatest(0, least(start + size, until) - greatest(start, begin))) AS taken FROM met JOIN block USING (sid, block) GROUP BY 1, 2
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS BIGINT) AS taken
FROM placed LEFT JOIN got USING (sid, start)
"""
