"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> (module, function).
QUERIES = {
    "op1_robust_outliers": ("robust_outliers", "op1"),
    "op2_url_timeline": ("url_timeline", "op2"),
    "op3_deleted_interpolation": ("deleted_interpolation", "op3"),
    "op4_factorization_machine": ("factorization_machine", "op4"),
    "op5_anchor_simhash": ("anchor_simhash", "op5"),
    "op6_incremental_mih": ("incremental_mih", "op6"),
    "op7_warc_segments": ("warc_segments", "op7"),
    "op8_line_blocks": ("line_blocks", "op8"),
    "op9_bitmap_bpe": ("bitmap_bpe", "op9"),
    "op10_source_mix": ("source_mix", "op10"),
}

#: Query name -> (module, constant with DuckDB SQL).
SQL: dict[str, tuple[str, str]] = {
    "op2_url_timeline": ("url_timeline", "OP2_SQL"),
    "op6_incremental_mih": ("incremental_mih", "OP6_SQL"),
    "op7_warc_segments": ("warc_segments", "OP7_SQL"),
    "op10_source_mix": ("source_mix", "OP10_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"graphloom.llm.{module}"), function) for name, (module, function) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"graphloom.llm.{module}"), constant) for name, (module, constant) in SQL.items()}
