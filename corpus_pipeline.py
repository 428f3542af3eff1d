"""Corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, tokenisation.

Every stage works on all rows that the one before it kept; all but the last return the columns of documents.
A model or estimate is fitted on the rows that the stage gets.

Defined cases, for all stages: an empty table gives an empty table; a null text is an empty one; very long texts are
read whole; further columns, whatever their names, are carried along as they are; ids need be neither present nor
unique, as rows are told apart by a digest of all their columns. Each stage's own cases stand at its function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import anchor_simhash, bitmap_bpe, common, factorization_machine, robust_outliers, shingle_copies, source_mix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the factorisation machine rejects go.

    Repeated rows share one verdict; a score of exactly the threshold stays; without labels to learn from all scores
    are 0.5, so all rows stay. An empty text is scored by its statistics alone.
    """
    return factorization_machine.keep_good(docs, factorization_machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that fail the base rules or are outliers of their language and source go.

    Repeated rows count each and share one verdict, as do rows of equal distance; texts of fewer than 20 words, empty
    ones among them, go; null languages and sources are groups of their own.
    """
    return robust_outliers.keep_usual(docs)


def row_key(docs: DataFrame) -> Column:
    """A digest of the whole row, nulls apart: equal for repeated rows only."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def class_heads(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class (``key, root``) the key of the row with the least id; null ids come last."""
    ids = keyed.select(F.col("_key").alias("key"), "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    return common.materialize(classes.join(ids, "key").groupBy("root").agg(least.alias("head")).select("head.key"), "heads")


def fingerprint_heads(keyed: DataFrame) -> DataFrame:
    """Keys of the rows that stay of the classes of operator 5."""
    classes = anchor_simhash.simhash_components(keyed.select(F.col("_key").alias("doc_id"), "text"))
    return class_heads(keyed, classes.select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")).distinct())


def rows_of(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of the keys, one of repeated ones."""
    return keyed.join(heads.withColumnRenamed("key", "_key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of near copies the row with the least id stays, rows without ids each by its digest.

    Only keys and ids move until the rows that stay are known; the texts are joined to them by key. Of repeated rows one
    stays; of equal ids with different texts each is a row of its own; rows without ids come after all others, in
    the order of their digests.
    """
    keyed = docs.withColumn("_key", row_key(docs))
    return rows_of(keyed, fingerprint_heads(keyed))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: of the rows that operator 5 leaves, those also go that have a near copy by five-word shingles
    (similarity 0.8 or more); of each such class the row with the least id stays, rows without ids last.

    Texts without words are near copies of each other alone (operator 5 gives all of them one fingerprint).
    """
    keyed = docs.withColumn("_key", row_key(docs))
    heads = fingerprint_heads(keyed)
    classes = shingle_copies.copy_classes(keyed.select(F.col("_key").alias("key"), "text"), heads)
    least = class_heads(keyed, classes)
    alone = heads.join(classes, "key", "left_anti")  # texts without words
    return rows_of(keyed, least.unionByName(alone))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents, as often and as far as the schedule takes them.

    A document appears once for every epoch that takes some of it, at most three times; the last one of a source may be
    cut, and is then its first words joined by blanks; documents without words are never taken; rows that differ in
    other columns only are taken in the order of their digests; null sources form one source.
    """
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of the mix.

    Repeated rows come out each; an empty text has no ids and the digests of the empty string.
    """
    return bitmap_bpe.encode_documents(docs, *bitmap_bpe.production_ranks())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_copies),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The classifier and the encoder have no SQL form; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir).select(*docs.columns), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
