"""Client: index a repository and ask its graph. Results are plain dictionaries in the JSON shapes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import __version__
from graphloom.api import errors, render
from graphloom.functions.scalars import posix_normal
from graphloom.operators import export, graph, resolve, traverse
from graphloom.operators.checkpoints import cut
from graphloom.plans import indexing
from graphloom.sources.store import SnapshotError, Store

API_VERSION = 1


class Plugin(Protocol):
    """Observer of operations: ``before(operation, request)`` and ``after(operation, request, result)``."""

    id: str
    api_version: int


class Client:
    def __init__(self, spark: SparkSession, store_root: str | None = None, plugins: list[Any] | None = None):
        self.spark, self.store_root, self.plugins = spark, store_root, []
        for p in plugins or []:
            if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", p.id):
                raise errors.InvalidArgument(f"invalid plugin id: {p.id}")
            if p.api_version != API_VERSION:
                raise errors.InvalidArgument(f"unsupported plugin api version: {p.api_version}")
            if p.id in [q.id for q in self.plugins]:
                raise errors.InvalidArgument(f"duplicate plugin id: {p.id}")
            self.plugins.append(p)

    def _run(self, operation: str, request: dict, work: Callable[[], Any]) -> Any:
        """Hooks before, the operation, hooks after, in order of registration; the first failure ends it."""

        def hook(name: str, done: bool, *args) -> None:
            for p in self.plugins:
                try:
                    if hasattr(p, name):
                        getattr(p, name)(operation, *args)
                except Exception as e:
                    raise errors.PluginFailure(f"plugin {p.id} failed: {e}", done) from e

        hook("before", False, request)
        result = work()
        hook("after", True, request, result)
        return result

    # --- access ---

    def _tables(self, repository: str) -> dict[str, DataFrame]:
        indexing.validate(repository)
        store = Store(self.spark, repository, self.store_root)
        try:
            if not store.completed():
                raise errors.IndexUnavailable("no completed index; run index first")
            return store.tables()
        except SnapshotError as e:
            raise errors.IndexUnavailable(str(e)) from e

    def _path(self, repository: str, path: str) -> str:
        if os.path.isabs(path):
            return posix_normal(os.path.relpath(os.path.realpath(path), os.path.realpath(repository)))
        return posix_normal(path)

    def _select(self, repository: str, tables: dict, name: str, signature: str | None, file: str | None, what: str = "symbol") -> dict:
        if not name:
            raise errors.InvalidArgument("symbol must not be empty")
        rows = [r.asDict(True) for r in graph.select_symbol(tables["symbols"], name, signature, self._path(repository, file) if file else None).collect()]
        if not rows:
            raise errors.NotFound(f"{what} not found: {name}")
        if len(rows) > 1:
            raise errors.AmbiguousSymbol(f"{what} is ambiguous: {name}; add an exact signature or file filter to select one definition", [render.symbol_json(r) for r in rows])
        return rows[0]

    @staticmethod
    def _key(symbol: dict) -> str:
        """The key that graph.key() gives a symbol."""
        path, name = (symbol[c].replace("\\", "\\\\").replace("|", "\\|") for c in ("path", "qualified_name"))
        return f"{path}|{name}|{symbol['range']['start_byte']}"

    def _symbols(self, tables: dict, refs: list[dict | None]) -> dict[tuple, dict]:
        """Full records of a result's symbol references."""
        wanted = {(r["path"], r["qualified_name"], r["start_byte"]) for r in refs if r}
        if not wanted:
            return {}
        keys = self.spark.createDataFrame(sorted(wanted), "path string, qualified_name string, _b int")
        found = resolve.definitions(tables["symbols"]).withColumn("_b", F.col("range.start_byte")).join(keys, ["path", "qualified_name", "_b"], "left_semi")
        return {(r["path"], r["qualified_name"], r["range"]["start_byte"]): r for r in (x.asDict(True) for x in found.collect())}

    @staticmethod
    def _shown(records: dict, ref: dict | None) -> dict | None:
        got = ref and records.get((ref["path"], ref["qualified_name"], ref["start_byte"]))
        return render.symbol_json(got) if got else None

    # --- operations ---

    def index(self, repository: str) -> indexing.IndexResult:
        return self._run("index", {"repository": repository}, lambda: indexing.index(self.spark, repository, self.store_root))

    def symbol(self, repository: str, name: str, signature: str | None = None, file: str | None = None) -> dict:
        def work():
            t = self._tables(repository)
            s = self._select(repository, t, name, signature, file)
            n = graph.symbol_counts(t["relationships"], self._key(s)).first().asDict()
            count = lambda side: {r: n[f"{side}_{r}"] for r in ("resolved", "ambiguous", "unresolved")}
            return render.result_json("symbol", {"symbol": render.symbol_json(s), "callers": count("callers"), "callees": count("callees")})

        return self._run("symbol", {"repository": repository, "symbol": name}, work)

    def _calls(self, query: str, repository: str, name: str, signature: str | None, file: str | None) -> dict:
        def work():
            t = self._tables(repository)
            s = self._select(repository, t, name, signature, file)
            edges = getattr(graph, query)(t["relationships"], self._key(s)).orderBy(*graph.call_order())
            rows = [r.asDict(True) for r in edges.collect()]
            records = self._symbols(t, [x for r in rows for x in (r["source_symbol"], r["target_symbol"], *[c["target_symbol"] for c in r["candidates"] or []])])
            calls = [
                {"caller": self._shown(records, r["source_symbol"]), "callee": self._shown(records, r["target_symbol"]), "target_text": r["target_text"], "resolution": r["resolution"], "confidence": r["confidence"], "provenance": r["provenance"],
                 "evidence": render.range_json(r["evidence"]), "candidates": [{"symbol": self._shown(records, c["target_symbol"]), "reason": c["reason"], "rank": c["rank"]} for c in r["candidates"] or []]}
                for r in rows
            ]
            return render.result_json(query, {"symbol": render.symbol_json(s), "calls": calls})

        return self._run(query, {"repository": repository, "symbol": name}, work)

    def callers(self, repository: str, name: str, signature: str | None = None, file: str | None = None) -> dict:
        return self._calls("callers", repository, name, signature, file)

    def callees(self, repository: str, name: str, signature: str | None = None, file: str | None = None) -> dict:
        return self._calls("callees", repository, name, signature, file)

    def file(self, repository: str, path: str) -> dict:
        def work():
            t, at = self._tables(repository), self._path(repository, path)
            if t["files"].where(F.col("path") == at).isEmpty():
                raise errors.NotFound(f"file not found: {path}")
            show = lambda r: {"source": r["source_path"], "target": r["target_path"], "target_text": r["target_text"], "resolution": r["resolution"], "confidence": r["confidence"], "provenance": r["provenance"], "evidence": render.range_json(r["evidence"]), "candidates": [{"path": c["target_path"], "reason": c["reason"], "rank": c["rank"]} for c in r["candidates"] or []]}
            listed = lambda df: [show(r.asDict(True)) for r in df.orderBy(*graph.include_order()).collect()]
            return render.result_json("file", {"path": at, "definitions": [render.symbol_json(r.asDict(True)) for r in graph.file_definitions(t["symbols"], at).collect()], "incoming_includes": listed(graph.file_incoming(t["relationships"], at)), "outgoing_includes": listed(graph.file_outgoing(t["relationships"], at))})

        return self._run("file", {"repository": repository, "path": path}, work)

    def impact(self, repository: str, target: str, signature: str | None = None, file: str | None = None) -> dict:
        def work():
            t = self._tables(repository)
            edges = cut(t["relationships"])
            calls = traverse.call_links(edges, "resolved"), traverse.call_links(edges, "ambiguous")
            path = self._path(repository, target) if target else ""
            found: list[tuple[DataFrame, DataFrame]] = []
            if not target:
                raise errors.InvalidArgument("impact target must not be empty")
            if not t["files"].where(F.col("path") == path).isEmpty():
                node = {"kind": "file", "file": path, "symbol": None}
                seed = self.spark.createDataFrame([(path, 1)], "node string, pos int")
                found.append(traverse.impact(traverse.include_links(edges, "resolved"), traverse.include_links(edges, "ambiguous"), seed))
                own = graph.file_definitions(t["symbols"], path).select(graph.key(F.struct("path", "qualified_name", F.col("range.start_byte").alias("start_byte"))).alias("node"), F.row_number().over(Window.orderBy("qualified_name", "path", "range.start_byte")).alias("pos"))
                found.append(traverse.impact(*calls, own))
            else:
                try:
                    s = self._select(repository, t, target, signature, file)
                except errors.NotFound as e:
                    raise errors.NotFound(f"file or symbol not found: {target}") from e
                node = {"kind": "symbol", "file": s["path"], "symbol": render.symbol_json(s)}
                found.append(traverse.impact(*calls, self.spark.createDataFrame([(self._key(s), 1)], "node string, pos int")))
            rows = []
            for k in (0, 1):
                df = found[0][k]
                for more in found[1:]:
                    df = df.unionByName(more[k])
                rows.append([r.asDict(True) for r in df.orderBy(*traverse.impact_order()).collect()])
            records = self._symbols(t, [x for part in rows for r in part for x in (r["source_symbol"], r["target_symbol"])])

            def side(r: dict, key: str, which: str) -> dict:
                ref = r[which]
                return {"kind": r["node_kind"], "file": ref["path"] if ref else r[key], "symbol": self._shown(records, ref)}

            show = lambda r: {"node": side(r, "node", "source_symbol"), "dependency": side(r, "dependency", "target_symbol"), "relationship": r["relationship"], "confidence": r["confidence"], "provenance": r["provenance"], "evidence": render.range_json(r["evidence"]), "depth": r["depth"]}
            return render.result_json("impact", {"target": node, "confirmed": [show(r) for r in rows[0]], "possible": [show(r) for r in rows[1]]})

        return self._run("impact", {"repository": repository, "target": target}, work)

    def path(self, repository: str, source: str, target: str, source_signature: str | None = None, source_file: str | None = None, target_signature: str | None = None, target_file: str | None = None) -> dict:
        def work():
            t = self._tables(repository)
            a = self._select(repository, t, source, source_signature, source_file, "source symbol")
            b = self._select(repository, t, target, target_signature, target_file, "target symbol")
            status, steps = traverse.shortest_path(cut(t["relationships"]), self._key(a), self._key(b))
            records = self._symbols(t, [x for r in steps for x in (r["source_symbol"], r["target_symbol"])])
            shown = [{"source": self._shown(records, r["source_symbol"]), "target": self._shown(records, r["target_symbol"]), "resolution": r["resolution"], "confidence": r["confidence"], "provenance": r["provenance"], "evidence": render.range_json(r["evidence"])} for r in steps]
            return render.result_json("path", {"source": render.symbol_json(a), "target": render.symbol_json(b), "status": status, "steps": shown})

        return self._run("path", {"repository": repository, "source": source, "target": target}, work)

    def graph(self, repository: str) -> dict:
        """The whole graph as one document (rendered on the driver, as its form is one document)."""

        def work():
            t = self._tables(repository)
            nodes, edges = export.nodes(t["files"], t["symbols"]), export.edges(t["symbols"], t["relationships"])
            for df in (nodes, edges):
                twice = export.duplicates(df).first()
                if twice:
                    raise errors.GraphError(f"duplicate id in export: {twice['id']}")
            n = [r.asDict(True) for r in nodes.orderBy("id").toLocalIterator()]
            e = [r.asDict(True) for r in edges.orderBy("id").toLocalIterator()]
            shown = [{"id": x["id"], "type": x["type"], "file": x["file"], **({"role": x["role"], "symbol": render.symbol_json({**x["symbol"], "path": x["file"]})} if x["symbol"] else {})} for x in n]
            lines = [{"id": x["id"], "type": x["type"], "source": x["source"], "target": x["target"], "target_text": x["target_text"], "resolution": x["resolution"], "confidence": x["confidence"], "provenance": x["provenance"], "evidence": render.range_json(x["evidence"]), "candidates": [{"node": c["node"], "reason": c["reason"], "rank": c["rank"]} for c in x["candidates"] or []]} for x in e]
            return {"schema_version": 1, "generator": {"name": "graphloom", "version": __version__}, "repository": {"root": "."}, "counts": {"nodes": len(shown), "edges": len(lines)}, "nodes": shown, "edges": lines}

        return self._run("graph", {"repository": repository}, work)

    def export(self, repository: str, output: str, force: bool = False) -> None:
        """Write the graph document: whole or not at all, over an existing file only by ``force``."""
        if os.path.lexists(output) and not os.path.isfile(output):
            raise errors.ExportFailure(f"output is not a regular file: {output}")
        if os.path.exists(output) and not force:
            raise errors.ExportFailure(f"output already exists: {output}")
        document = render.dumps(self.graph(repository))
        temporary = f"{output}.{uuid.uuid4().hex}.tmp"
        try:
            with open(temporary, "x", encoding="utf-8") as f:
                f.write(document)
            os.replace(temporary, output)
        except OSError as e:
            if os.path.exists(temporary):
                os.unlink(temporary)
            raise errors.ExportFailure(f"cannot write {output}: {e}") from e
