"""A repository with include and call chains, a cycle, ambiguous targets and a longer certain path."""

import os

import pytest

from graphloom.api import errors
from graphloom.api.client import Client
from graphloom.sources.store import Store

TREE = {
    "include/base.hpp": "#pragma once\n",
    "include/wrapper.hpp": '#include "base.hpp"\n',
    "include/a/common.hpp": "// a\n",
    "include/b/common.hpp": "// b\n",
    "src/graph.cpp": '#include "wrapper.hpp"\nint leaf() { return 0; }\nint middle() { return leaf(); }\nint top() { return middle(); }\nint cycle_b();\nint cycle_a() { return cycle_b(); }\nint cycle_b() { return cycle_a(); }\n',
    "src/main.cpp": '#include "wrapper.hpp"\nint top();\nint run() { return top(); }\n',
    "src/ambiguous.cpp": '#include "common.hpp"\nnamespace alpha {\nint candidate() { return 1; }\nint endpoint() { return 1; }\n}\nnamespace beta {\nint candidate() { return 2; }\nint endpoint() { return 2; }\n}\nint maybe() { return candidate(); }\nint bridge() { return alpha::endpoint(); }\nint certainty() { return bridge() + endpoint(); }\n',
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("goldens")
    for path, text in TREE.items():
        os.makedirs(os.path.dirname(top / path), exist_ok=True)
        (top / path).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def client(spark, repo, tmp_path_factory):
    c = Client(spark, str(tmp_path_factory.mktemp("store")))
    c.index(repo)
    return c


def test_graph_counts(client, repo):
    g = client.graph(repo)
    kinds = [e["type"] for e in g["edges"]]
    assert g["counts"] == {"nodes": 20, "edges": 26} and {k: kinds.count(k) for k in set(kinds)} == {"defines": 13, "calls": 9, "includes": 4}
    assert len({n["id"] for n in g["nodes"]}) == 20 and len({e["id"] for e in g["edges"]}) == 26


@pytest.mark.parametrize(
    "target,confirmed,possible",
    [
        ("leaf", [("middle", 1), ("top", 2), ("run", 3)], []),
        ("include/base.hpp", [("include/wrapper.hpp", 1), ("src/graph.cpp", 2), ("src/main.cpp", 2)], []),
        ("src/graph.cpp", [("run", 1)], []),
        ("cycle_a", [("cycle_b", 1)], []),
        ("alpha::candidate", [], [("maybe", 1)]),
        ("include/a/common.hpp", [], [("src/ambiguous.cpp", 1)]),
    ],
)
def test_impact(client, repo, target, confirmed, possible):
    got = client.impact(repo, os.path.join(repo, target) if target.startswith("include/base") else target)
    name = lambda r: r["node"]["symbol"]["name"] if r["node"]["symbol"] else r["node"]["file"]
    assert [(name(r), r["depth"]) for r in got["confirmed"]] == confirmed
    assert [(name(r), r["depth"]) for r in got["possible"]] == possible


def test_unknown_and_ambiguous(client, repo):
    with pytest.raises(errors.NotFound):
        client.impact(repo, "unknown")
    with pytest.raises(errors.AmbiguousSymbol):
        client.impact(repo, "candidate")


@pytest.mark.parametrize(
    "source,target,status,steps",
    [
        ("run", "leaf", "confirmed", ["top", "middle", "leaf"]),
        ("maybe", "alpha::candidate", "possible", ["candidate"]),
        ("certainty", "alpha::endpoint", "confirmed", ["bridge", "endpoint"]),
        ("cycle_a", "cycle_b", "confirmed", ["cycle_b"]),
        ("leaf", "leaf", "confirmed", []),
        ("leaf", "run", "not_found", []),
    ],
)
def test_paths(client, repo, source, target, status, steps):
    got = client.path(repo, source, target)
    assert (got["status"], [s["target"]["name"] for s in got["steps"]]) == (status, steps)


@pytest.mark.parametrize("version", [1, 2, 3])
def test_older_snapshots_are_replaced(client, repo, spark, tmp_path, version):
    c = Client(spark, str(tmp_path))
    first = c.index(repo).counts
    store = Store(spark, repo, str(tmp_path))
    store._point(store.manifest() | {"schema_version": version})
    assert not Store(spark, repo, str(tmp_path)).completed()
    with pytest.raises(errors.IndexUnavailable):
        c.symbol(repo, "leaf")
    again = c.index(repo).counts
    assert (again["parsed"], again["relationships"]) == (7, first["relationships"]) and c.symbol(repo, "leaf")["symbol"]["name"] == "leaf"
