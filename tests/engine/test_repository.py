import io
import json
import os
import threading

import pytest

from graphloom.__main__ import main
from graphloom.api import errors
from graphloom.api.client import Client
from graphloom.api.server import read_message, serve, write_message
from graphloom.sources.scan import scan

TREE = {
    "include/base.hpp": "int leaf();\n",
    "include/wrap.hpp": '#include "base.hpp"\n',
    "src/a.cpp": '#include "wrap.hpp"\n#include <vector>\nint leaf() { return 1; }\nint middle() { return leaf(); }\nint top() { return middle(); }\n',
    "src/b.cpp": '#include "include/wrap.hpp"\nnamespace one { int same() { return 1; } }\nnamespace two { int same() { return 2; } }\nint maybe() { return same(); }\nint ring_a();\nint ring_b() { return ring_a(); }\nint ring_a() { return ring_b(); }\nint missing_call() { return nowhere(top()); }\n',
    "pkg/__init__.py": "",
    "pkg/tool.py": "from . import other\n\ndef work():\n    return helper()\n\ndef helper():\n    return 1\n",
    "pkg/other.pyi": "def stub() -> int: ...\n",
    "build/skipped.cpp": "int no() { return 0; }\n",
    "notes.txt": "x",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        os.makedirs(os.path.dirname(top / path), exist_ok=True)
        (top / path).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def client(spark, repo, tmp_path_factory):
    c = Client(spark, str(tmp_path_factory.mktemp("store")))
    c.first = c.index(repo)
    return c


def test_scan(repo):
    assert [f[:2] for f in scan(repo).files] == [("include/base.hpp", "cpp"), ("include/wrap.hpp", "cpp"), ("pkg/__init__.py", "python"), ("pkg/other.pyi", "python"), ("pkg/tool.py", "python"), ("src/a.cpp", "cpp"), ("src/b.cpp", "cpp")]


def test_index_counts(client):
    n = client.first.counts
    assert (n["files"], n["parsed"], n["added"], n["includes"], n["diagnostics"]) == (7, 7, 7, 5, 0)
    assert (n["resolved"] + n["ambiguous"] + n["unresolved"]) == n["relationships"] and n["ambiguous"] == 1 and n["unresolved"] == 2


def test_queries(client, repo):
    s = client.symbol(repo, "leaf")
    assert (s["symbol"]["file"], s["callers"]["resolved"], s["callees"]["resolved"]) == ("src/a.cpp", 1, 0)
    assert [c["caller"]["name"] for c in client.callers(repo, "one::same")["calls"]] == ["maybe"]
    c = client.callees(repo, "maybe")["calls"][0]
    assert (c["resolution"], c["confidence"], [x["symbol"]["qualified_name"] for x in c["candidates"]]) == ("ambiguous", "medium", ["one::same", "two::same"])
    f = client.file(repo, "include/wrap.hpp")
    assert [i["source"] for i in f["incoming_includes"]] == ["src/a.cpp", "src/b.cpp"] and [i["target"] for i in f["outgoing_includes"]] == ["include/base.hpp"]
    assert [i["confidence"] for i in f["incoming_includes"]] == ["medium", "high"]
    assert client.callees(repo, "pkg.tool::work")["calls"][0]["callee"]["qualified_name"] == "pkg.tool::helper"


def test_impact_and_paths(client, repo):
    i = client.impact(repo, "leaf")
    assert [(r["node"]["symbol"]["name"], r["depth"], r["dependency"]["symbol"]["name"]) for r in i["confirmed"]] == [("middle", 1, "leaf"), ("top", 2, "middle"), ("missing_call", 3, "top")]
    assert [(r["node"]["file"], r["depth"]) for r in client.impact(repo, os.path.join(repo, "include/base.hpp"))["confirmed"]] == [("include/wrap.hpp", 1), ("src/a.cpp", 2), ("src/b.cpp", 2)]
    assert [r["node"]["symbol"]["name"] for r in client.impact(repo, "two::same")["possible"]] == ["maybe"]
    assert [(r["node"]["symbol"]["name"], r["depth"]) for r in client.impact(repo, "ring_a")["confirmed"]] == [("ring_b", 1)]
    p = client.path(repo, "top", "leaf")
    assert (p["status"], [s["target"]["name"] for s in p["steps"]]) == ("confirmed", ["middle", "leaf"])
    assert client.path(repo, "maybe", "one::same")["status"] == "possible"
    assert client.path(repo, "leaf", "top")["status"] == "not_found" and client.path(repo, "leaf", "leaf")["steps"] == []


def test_errors(client, repo, spark, tmp_path):
    for call, kind, text in [
        (lambda: client.symbol(repo, "gone"), errors.NotFound, "symbol not found: gone"),
        (lambda: client.symbol(repo, "same"), errors.AmbiguousSymbol, "symbol is ambiguous: same; add an exact signature or file filter to select one definition"),
        (lambda: client.file(repo, "x.cpp"), errors.NotFound, "file not found: x.cpp"),
        (lambda: client.impact(repo, "gone"), errors.NotFound, "file or symbol not found: gone"),
        (lambda: client.path(repo, "gone", "leaf"), errors.NotFound, "source symbol not found: gone"),
        (lambda: client.symbol(str(tmp_path / "none"), "x"), errors.RepositoryUnavailable, None),
        (lambda: client.symbol(str(tmp_path), "x"), errors.IndexUnavailable, None),
        (lambda: client.symbol(repo, ""), errors.InvalidArgument, None),
    ]:
        with pytest.raises(kind) as e:
            call()
        assert text is None or e.value.message == text


def test_command_line(client, repo, spark, tmp_path):
    def run(*argv):
        out, err = io.StringIO(), io.StringIO()
        status = main([*argv, "--database", client.store_root], spark, out, err)
        return status, out.getvalue(), err.getvalue()

    status, out, _ = run("query", "symbol", "leaf", "--repo", repo, "--format", "json")
    assert status == 0 and list(json.loads(out)) == ["schema_version", "ok", "query", "symbol", "callers", "callees"] and out.endswith("}\n")
    status, out, _ = run("query", "symbol", "same", "--repo", repo, "--format", "json")
    assert status == 6 and len(json.loads(out)["error"]["candidates"]) == 2
    assert run("path", "top", "leaf", "--repo", repo)[1].startswith("Path: confirmed (2 steps)")
    assert run("query", "nothing")[0] == 2
    target = str(tmp_path / "g.json")
    assert run("export", target, "--repo", repo)[0] == 0
    first = open(target).read()
    assert run("export", target, "--repo", repo)[0] == 7 and run("export", target, "--repo", repo, "--force")[0] == 0
    assert open(target).read() == first
    g = json.loads(first)
    assert g["counts"] == {"nodes": len(g["nodes"]), "edges": len(g["edges"])} and "file:15:pkg/__init__.py" in [n["id"] for n in g["nodes"]]
    assert [n["id"] for n in g["nodes"]] == sorted(n["id"] for n in g["nodes"])


def test_plugins(client, repo, spark):
    seen = []

    class P:
        def __init__(self, ident, fails=None):
            self.id, self.api_version, self.fails = ident, 1, fails

        def before(self, operation, request):
            seen.append((self.id, "before"))
            if self.fails == "before":
                raise ValueError("no")

        def after(self, operation, request, result):
            seen.append((self.id, "after"))

    Client(spark, client.store_root, [P("a"), P("b")]).symbol(repo, "leaf")
    assert seen == [("a", "before"), ("b", "before"), ("a", "after"), ("b", "after")]
    with pytest.raises(errors.PluginFailure) as e:
        Client(spark, client.store_root, [P("a", "before")]).symbol(repo, "leaf")
    assert not e.value.operation_completed
    for bad in ([P("A")], [P("a"), P("a")]):
        with pytest.raises(errors.InvalidArgument):
            Client(spark, client.store_root, bad)


def test_server(client, repo):
    requests = io.BytesIO()
    for i, (method, params) in enumerate([("query.symbol", {"symbol": "leaf"}), ("initialize", {"repository": repo}), ("query.symbol", {"symbol": "leaf"}), ("query.symbol", {"symbol": "gone"}), ("what", {}), ("query.symbol", {})]):
        write_message(requests, {"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    requests.write(b"Content-Length: 3\r\n\r\n{x}")
    write_message(requests, {"jsonrpc": "2.0", "id": 9, "method": "shutdown"})
    write_message(requests, {"jsonrpc": "2.0", "method": "exit"})
    out = io.BytesIO()
    assert serve(client, io.BytesIO(requests.getvalue()), out) == 0
    out.seek(0)
    got = {}
    while (body := read_message(out)) is not None:
        m = json.loads(body)
        got[m["id"]] = m
    code = {k: v["error"]["code"] for k, v in got.items() if "error" in v}
    assert code == {0: -32001, 3: -32012, 4: -32601, 5: -32602, None: -32700}
    assert got[2]["result"]["symbol"]["name"] == "leaf" and got[9]["result"] is None
    assert threading.active_count() >= 1


def test_reindex(client, repo, spark, tmp_path, monkeypatch):
    import shutil

    tree = str(tmp_path / "copy")
    shutil.copytree(repo, tree)
    c = Client(spark, str(tmp_path / "store"))
    n = c.index(tree).counts
    again = c.index(tree).counts
    assert (again["parsed"], again["unchanged"], again["relationships"]) == (0, 7, n["relationships"])
    with open(f"{tree}/src/b.cpp", "a") as f:
        f.write("int extra() { return leaf(); }\n")
    os.unlink(f"{tree}/pkg/other.pyi")
    with open(f"{tree}/src/new.c", "w") as f:
        f.write("int fresh(void) { return 0; }\n")
    third = c.index(tree).counts
    assert (third["added"], third["modified"], third["deleted"], third["unchanged"], third["parsed"]) == (1, 1, 1, 5, 2)
    assert c.symbol(tree, "leaf")["callers"]["resolved"] == 2
    from graphloom.sources.store import Store

    monkeypatch.setattr(Store, "_point", lambda self, m: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        c.index(tree)
    monkeypatch.undo()
    assert c.symbol(tree, "fresh")["symbol"]["file"] == "src/new.c"
    store = Store(spark, tree, str(tmp_path / "store"))
    m = store.manifest()
    m["schema_version"] = 99
    store._point(m)
    with pytest.raises(errors.IndexUnavailable, match="unsupported database schema version: 99"):
        c.symbol(tree, "fresh")


def test_data_source(spark, repo):
    from graphloom.functions.scalars import fnv1a
    from graphloom.sources.datasource import RepositorySource

    spark.dataSource.register(RepositorySource)
    got = spark.read.format("repository").option("shareBytes", "100").load(repo).collect()
    assert {r.path: r.content_fingerprint for r in got} == {f[0]: fnv1a(TREE[f[0]].encode()) for f in scan(repo).files}


def test_streaming_reindex(spark, repo, tmp_path):
    from graphloom.streaming.reindex import follow

    spark.createDataFrame([("changed",)], "path string").write.parquet(f"file://{tmp_path}/events")
    seen = []
    q = follow(spark.readStream.schema("path string").parquet(f"file://{tmp_path}/events"), repo, f"file://{tmp_path}/checkpoint", str(tmp_path / "store"), lambda n, r: seen.append((n, r.counts["files"])))
    q.awaitTermination(120)
    assert seen == [(0, 7)]
