"""Indexing a source tree: scan, reuse, extract, resolve, publish."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.api.errors import InvalidArgument, RepositoryUnavailable
from graphloom.operators import incremental, resolve
from graphloom.operators.checkpoints import cut
from graphloom.sources import scan as scanning
from graphloom.sources.extract import analyses, fact_table
from graphloom.sources.store import TABLES, Store


@dataclass
class IndexResult:
    counts: dict[str, int]
    timings_ms: dict[str, int]
    warnings: list[str] = field(default_factory=list)


def validate(repository: str) -> None:
    if not repository:
        raise InvalidArgument("repository path must not be empty")
    if not os.path.exists(repository):
        raise RepositoryUnavailable(f"repository does not exist: {repository}")
    if not os.path.isdir(repository):
        raise RepositoryUnavailable(f"repository is not a directory: {repository}")


def facts_to_tables(files: DataFrame, facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a run; edges are always resolved anew over the complete facts."""
    edges = resolve.relationships(files, facts["symbols"], facts["calls"], facts["includes"]).where("kind <> 'calls' or source_symbol is not null")
    return {"files": files, **facts, "relationships": edges.orderBy(*resolve.edge_order())}


def index(spark: SparkSession, repository: str, store_root: str | None = None) -> IndexResult:
    """Index a tree, reusing the facts of files whose bytes and language did not change."""
    validate(repository)
    took: dict[str, int] = {}
    clock = [time.perf_counter()]

    def lap(name: str) -> None:
        now = time.perf_counter()
        took[f"{name}_ms"] = round((now - clock[0]) * 1000)
        clock[0] = now

    begun = clock[0]
    found = scanning.scan(repository)
    files = cut(scanning.read_files(spark, found).drop("content"))  # the bytes are read again only where they changed
    lap("scan")
    store = Store(spark, repository, store_root)
    old = store.cached_facts()
    lap("cache")
    if old is None:
        changed = files.select("path", F.lit("added").alias("change"))
    else:
        changed = incremental.changes(old["files"], files)
    changed = cut(changed)
    by = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
    parsed = 0
    if old is not None and not set(by) - {"unchanged"}:  # the active run has these facts, and their edges
        lap("parse")
        tables = old
        lap("relationships")
        store.renew()
    else:
        parsed = by.get("added", 0) + by.get("modified", 0)
        wanted = files.join(changed.where("change in ('added', 'modified')").select("path"), "path", "left_semi")
        fresh = cut(analyses(scanning.read_contents(wanted, found.root, parsed)))
        status = fresh.select("path", "language", "content_fingerprint", "size_bytes", incremental.parse_status("status", "diagnostics").alias("parse_status"))
        facts = {name: fact_table(fresh, name) for name in ("symbols", "includes", "calls", "diagnostics")}
        if old is not None:
            status = status.unionByName(incremental.reuse(old["files"], changed))
            facts = {name: df.unionByName(incremental.reuse(old[name], changed)) for name, df in facts.items()}
        facts = {name: cut(df) for name, df in facts.items()}
        lap("parse")
        tables = facts_to_tables(cut(status.orderBy("path")), facts)
        tables["relationships"] = cut(tables["relationships"])
        lap("relationships")
        store.replace(tables)
    lap("persistence")
    took["total_ms"] = round((time.perf_counter() - begun) * 1000)
    counts = {"files": len(found.files), "parsed": parsed, "reused": by.get("unchanged", 0), **{k: by.get(k, 0) for k in ("added", "modified", "unchanged", "deleted")}}
    counts |= {t: tables[t].count() for t in TABLES if t not in ("files",)}
    counts |= resolve.resolution_counts(tables["relationships"]).first().asDict()
    return IndexResult(counts, took, found.warnings)
