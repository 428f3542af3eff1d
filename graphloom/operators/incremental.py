"""Incremental maintenance: what changed between two snapshots, and what can be kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change``: unchanged only if fingerprint and language are equal; else modified, added or deleted."""
    a = before.select("path", F.col("content_fingerprint").alias("_f"), F.col("language").alias("_l"), F.lit(True).alias("_old"))
    b = now.select("path", "content_fingerprint", "language", F.lit(True).alias("_new"))
    same = (F.col("_f") == F.col("content_fingerprint")) & (F.col("_l") == F.col("language"))
    return a.join(b, "path", "full_outer").select("path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(same, "unchanged").otherwise("modified").alias("change"))


def reuse(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts of unchanged files, failed analyses included."""
    return facts.join(changed.where("change = 'unchanged'").select("path"), "path", "left_semi")


def parse_status(status: str, diagnostics: str):
    """Stored status of a file from its analysis and whether it has diagnostics."""
    return F.when(F.col(status) == "failed", "failed").when(F.size(diagnostics) > 0, "parsed_with_errors").otherwise("parsed")
