"""Fact extraction: one source in, its symbols, includes, calls and diagnostics out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from graphloom.functions.scalars import SYMBOL_KINDS, SYMBOL_ROLES
from graphloom.operators.resolve import RANGE
from graphloom.operators.shipping import ship
from graphloom.sources import c_facts, python_facts

FACTS = {
    "symbols": f"struct<kind:string,role:string,name:string,qualified_name:string,signature:string,range:{RANGE}>",
    "includes": f"struct<target:string,is_system:boolean,range:{RANGE}>",
    "calls": f"struct<caller_qualified_name:string,caller_start_byte:int,callee_text:string,callee_name:string,form:string,argument_count:int,range:{RANGE}>",
    "diagnostics": f"struct<severity:string,code:string,message:string,range:{RANGE}>",
}
NOWHERE = {"start_line": 0, "start_column": 0, "end_line": 0, "end_column": 0, "start_byte": 0, "end_byte": 0}


def _ordered(rows: list[dict], key) -> list[dict]:
    found = {}
    for r in sorted(rows, key=key):
        found.setdefault(key(r), r)
    return list(found.values())


def analyze(path: str, language: str, content: bytes) -> dict:
    """Facts of one source, each kind in order and without repeats; a failure becomes a diagnostic."""
    try:
        text = content.decode("utf-8", "replace")
        if language in ("c", "cpp"):
            out = c_facts.extract(text, path)
        elif language == "python":
            out = python_facts.extract(text, path)
        else:
            raise ValueError("unsupported language")
    except Exception as e:  # any failure of analysis is a fact about the file
        return {"status": "failed", "symbols": [], "includes": [], "calls": [], "diagnostics": [{"severity": "error", "code": "analysis-failed", "message": str(e), "range": NOWHERE}]}
    return {
        "status": "parsed",
        "symbols": _ordered(out["symbols"], lambda r: (r["range"]["start_byte"], SYMBOL_KINDS.index(r["kind"]), SYMBOL_ROLES.index(r["role"]), r["qualified_name"])),
        "includes": _ordered(out["includes"], lambda r: (r["range"]["start_byte"], r["target"])),
        "calls": _ordered(out["calls"], lambda r: (r["range"]["start_byte"], r["callee_text"], r["range"]["end_byte"])),
        "diagnostics": _ordered(out["diagnostics"], lambda r: (r["range"]["start_byte"], r["code"])),
    }


def analyses(files: DataFrame) -> DataFrame:
    """One row per file: ``path, language, content_fingerprint, size_bytes, status`` and an array of each kind of fact."""
    ship(files.sparkSession)
    schema = files.select("path", "language", "content_fingerprint", "size_bytes").schema
    schema = schema.add("status", "string")
    for name, kind in FACTS.items():
        schema = schema.add(name, DataType.fromDDL(f"array<{kind}>"))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 32):
                rows = [{**{k: r[k] for k in ("path", "language", "content_fingerprint", "size_bytes")}, **analyze(r["path"], r["language"], r["content"] or b"")} for r in b.slice(i, 32).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "language", "content_fingerprint", "size_bytes", "content").mapInArrow(run, schema)


def fact_table(analysed: DataFrame, name: str) -> DataFrame:
    """``symbols``, ``includes``, ``calls`` or ``diagnostics`` as a table with the file's path."""
    return analysed.select("path", F.inline(name))
