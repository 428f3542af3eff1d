"""Lookups and one-step graph queries over the active snapshot's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as s


def key(symbol: str | Column) -> Column:
    """One string for a symbol reference struct, different for different ones: bars and backslashes in its parts are escaped."""
    x = F.col(symbol) if isinstance(symbol, str) else symbol
    escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", escaped(x.getField("path")), escaped(x.getField("qualified_name")), x.getField("start_byte").cast("string"))


def select_symbol(symbols: DataFrame, name: str, signature: str | None = None, file: str | None = None) -> DataFrame:
    """Definitions that a name selects, in candidate order: qualified names first, short names only if none.

    Filters apply after the choice of tier and never reopen the second.
    """
    d = symbols.where(F.col("role") == "definition").withColumn("_tier", F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name, 1)).where("_tier is not null")
    best = d.agg(F.min("_tier").alias("_best"))
    d = d.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")  # one row
    if signature is not None:
        d = d.where(F.col("signature") == signature)
    if file is not None:
        d = d.where(F.col("path") == file)
    return d.orderBy("qualified_name", "path", "range.start_byte", "signature")


def callees(edges: DataFrame, symbol_key: str) -> DataFrame:
    """Call edges out of a symbol, of any resolution."""
    return edges.where((F.col("kind") == "calls") & (key("source_symbol") == symbol_key))


def _is(x: Column, symbol_key: str) -> Column:
    return key(x) == symbol_key


def callers(edges: DataFrame, symbol_key: str) -> DataFrame:
    """Call edges into a symbol, or with it among their candidates; each edge once."""
    hit = F.coalesce(key("target_symbol") == symbol_key, F.lit(False)) | F.coalesce(F.exists("candidates", lambda c: _is(c.target_symbol, symbol_key)), F.lit(False))
    return edges.where((F.col("kind") == "calls") & hit)


def call_order() -> list[Column]:
    return [F.col("source_path"), F.col("evidence.start_byte"), F.col("target_text"), F.col("evidence.end_byte")]


def symbol_counts(edges: DataFrame, symbol_key: str) -> DataFrame:
    """One row: callees by resolution, and resolved and ambiguous callers; callers are never unresolved."""
    call = F.col("kind") == "calls"
    out = call & (key("source_symbol") == symbol_key)
    into = call & F.coalesce(key("target_symbol") == symbol_key, F.lit(False))
    maybe = call & (F.col("resolution") == "ambiguous") & F.coalesce(F.exists("candidates", lambda c: _is(c.target_symbol, symbol_key)), F.lit(False))
    return edges.agg(
        *[F.count_if(out & (F.col("resolution") == r)).alias(f"callees_{r}") for r in s.RESOLUTIONS],
        F.count_if(into).alias("callers_resolved"), F.count_if(maybe).alias("callers_ambiguous"), F.lit(0).cast("long").alias("callers_unresolved"),
    )


def file_definitions(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where((F.col("role") == "definition") & (F.col("path") == path)).orderBy("qualified_name", "path", "range.start_byte", "signature")


def file_outgoing(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("kind") == "includes") & (F.col("source_path") == path))


def file_incoming(edges: DataFrame, path: str) -> DataFrame:
    """Includes of a file, resolved or possible; its include of itself is outgoing only."""
    hit = F.coalesce(F.col("target_path") == path, F.lit(False)) | F.coalesce(F.exists("candidates", lambda c: c.target_path == path), F.lit(False))
    return edges.where((F.col("kind") == "includes") & hit & (F.col("source_path") != path))


def include_order() -> list[Column]:
    return [F.col("source_path"), F.coalesce("target_path", F.lit("")), F.col("target_text"), F.col("evidence.start_line"), F.col("evidence.start_column"), s.ordinal(F.col("resolution"), s.RESOLUTIONS), s.ordinal(F.col("confidence"), s.CONFIDENCES), F.col("provenance")]
