"""Snapshot store: every index run is a folder of Parquet tables; one pointer file names the active run.

A run is written whole, checked, and only then made active by an atomic replace, so a failure leaves the old
snapshot in place. The run before the active one is kept, as readers may still hold it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import fnv1a

SCHEMA_VERSION, CACHE_VERSION = 4, 2
#: Versions whose snapshots are taken for outdated instead of refused.
OLDER_VERSIONS = (1, 2, 3)
TABLES = ("files", "symbols", "includes", "calls", "diagnostics", "relationships")


class SnapshotError(RuntimeError):
    pass


def default_store() -> str:
    """Cache folder: $GRAPHLOOM_CACHE, else $XDG_CACHE_HOME or ~/.cache, else the temporary folder."""
    if os.environ.get("GRAPHLOOM_CACHE"):
        return os.environ["GRAPHLOOM_CACHE"]
    base = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.environ["HOME"], ".cache") if os.environ.get("HOME") else tempfile.gettempdir())
    return os.path.join(base, "graphloom")


def violations(files: DataFrame, symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    """``rule, rows`` of every integrity rule that is broken; empty for a sound snapshot."""
    r = relationships
    known = symbols.select("path", "qualified_name", "role", F.col("range.start_byte").alias("start_byte")).distinct()
    target = r.where("target_symbol is not null").select("target_symbol.*").distinct()
    broken = {
        "file paths are unique": files.groupBy("path").count().where("count > 1"),
        "symbols are unique": symbols.groupBy("path", "kind", "role", "qualified_name", "range.start_byte").count().where("count > 1"),
        "a resolved edge has a target": r.where("resolution = 'resolved' and target_path is null"),
        "a call has a caller": r.where("kind = 'calls' and source_symbol is null"),
        "a definition edge has a symbol": r.where("kind = 'defines' and target_symbol is null"),
        "candidates are ranked from one": r.where("exists(candidates, c -> c.rank < 1) or candidate_count < 0"),
        "a candidate has a target": r.where("exists(candidates, c -> c.target_path is null and c.target_symbol is null)"),
        "targets are known symbols": target.join(known, ["path", "qualified_name", "role", "start_byte"], "left_anti"),
        "sources are known files": r.select(F.col("source_path").alias("path")).distinct().join(files, "path", "left_anti"),
    }
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows") for rule, df in broken.items()]
    return reduce(DataFrame.unionByName, counts).where("rows > 0")


class Store:
    """The snapshots of one repository.

    ``root`` is a folder, or a URL of any file system that Spark knows; on a cluster it must be one that driver
    and executors share, so only local mode has a default.
    """

    def __init__(self, spark: SparkSession, repository: str, root: str | None = None):
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise SnapshotError("name a snapshot store that driver and executors share")
        self.spark, self.repository = spark, os.path.realpath(repository)
        root = root or default_store()
        root = root.rstrip("/") if "://" in root else f"file://{os.path.abspath(root)}"
        self.folder = f"{root}/repos/{fnv1a(self.repository.encode())}"
        self.pointer = f"{self.folder}/ACTIVE.json"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _file(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def manifest(self) -> dict | None:
        """Manifest of the active run, None before the first; never creates anything."""
        fs, p = self._file(self.pointer)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        version = found.get("schema_version")
        if version in OLDER_VERSIONS:  # its facts are not read: the next run analyses everything anew and replaces it
            return found | {"schema_version": SCHEMA_VERSION, "analysis_cache_version": None, "status": "outdated"}
        if version != SCHEMA_VERSION:
            raise SnapshotError(f"unsupported database schema version: {version}")
        return found

    def completed(self) -> bool:
        m = self.manifest()
        return m is not None and m.get("status") == "completed"

    def tables(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        """Tables of one run, pinned by its manifest."""
        m = manifest or self.manifest()
        if m is None or m.get("status") == "outdated":
            raise SnapshotError("no completed index")
        return {t: self.spark.read.parquet(f"{self.folder}/runs/{m['run_id']}/{t}") for t in TABLES}

    def cached_facts(self) -> dict[str, DataFrame] | None:
        """Facts that a new run may reuse: none if another version of the analysis wrote them."""
        m = self.manifest()
        return self.tables(m) if m and m.get("analysis_cache_version") == CACHE_VERSION else None

    def replace(self, tables: dict[str, DataFrame]) -> dict:
        """Write a run, check it, make it active."""
        run, started = uuid.uuid4().hex, time.time()
        path = f"{self.folder}/runs/{run}"
        try:
            for name in TABLES:
                tables[name].write.parquet(f"{path}/{name}")
            written = self.tables({"run_id": run})
            bad = violations(written["files"], written["symbols"], written["relationships"]).collect()
            if bad:
                raise SnapshotError("; ".join(f"{r['rule']}: {r['rows']}" for r in bad))
            manifest = {"schema_version": SCHEMA_VERSION, "analysis_cache_version": CACHE_VERSION, "repository": self.repository, "run_id": run, "previous": (self.manifest() or {}).get("run_id"), "started_at": started, "completed_at": time.time(), "status": "completed"}
            self._point(manifest)
        except BaseException:
            fs, p = self._file(path)
            fs.delete(p, True)
            raise
        fs, runs = self._file(f"{self.folder}/runs")
        for old in fs.listStatus(runs):
            if old.getPath().getName() not in (run, manifest["previous"]):
                fs.delete(old.getPath(), True)
        return manifest

    def renew(self) -> dict:
        """Mark the active run as completed now, its tables being what another run would write."""
        manifest = self.manifest() | {"started_at": time.time(), "completed_at": time.time()}
        self._point(manifest)
        return manifest

    def _point(self, manifest: dict) -> None:
        """Replace the pointer in one step."""
        fs, temporary = self._file(f"{self.pointer}.{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target = self._jvm.org.apache.hadoop.fs.Path(self.pointer)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temporary, target, options)
