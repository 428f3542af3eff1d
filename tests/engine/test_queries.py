"""Every registered graph query against its SQL in DuckDB, and traversal against a plain queue."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import scalars as s
from graphloom.operators import resolve, traverse
from graphloom.plans import queries

D = "/root/testdata/sf0.001"
need = pytest.mark.skipif(not os.path.isdir(D), reason="test tables not there")


def rows(df):
    columns = sorted(df.columns)
    text = lambda v: "NULL" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([text(v) for v in r] for r in df[columns].itertuples(index=False))


@need
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), c.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@need
def test_entry(spark):
    assert set(queries.SQL) <= set(entry.queries()) and entry.entry(spark).columns == ["node", "dependency", "depth", "evidence", "confidence", "provenance"]


def test_string_functions(spark):
    df = spark.createDataFrame([("a<b<c>>::f", "x::y::g", "src/a.cpp", "../b/./c.h", "pkg/sub/mod.py"), ("::f<", "g", "a.cpp", "x/..", "pkg/__init__.py"), ("f", "a::g", "d/e/f.c", "../../../z", "__init__.pyi")], "t string, c string, p string, i string, m string")
    got = df.select(s.strip_template_arguments(F.col("t")).alias("t"), s.scope_candidates(F.col("c"), F.lit("h")).alias("c"), s.under(s.folder(F.col("p")), F.col("i")).alias("p"), s.python_module(F.col("m")).alias("m"), s.imported_module(F.col("m"), F.lit("..q.r")).alias("i"), s.imported_module(F.col("m"), F.lit(".")).alias("j"), s.component(F.lit("é")).alias("k")).collect()
    assert [r.t for r in got] == ["a::f", "f", "f"]
    assert [r.c for r in got] == [["x::y::h", "x::h", "h"], ["h"], ["a::h", "h"]]
    assert [r.p for r in got] == ["b/c.h", ".", "../z"]
    assert [r.m for r in got] == ["pkg.sub.mod", "pkg", ""]
    assert [r.i for r in got] == ["pkg.q.r", "q.r", "q.r"]
    assert [r.j for r in got] == ["pkg.sub", "pkg", ""] and got[0].k == "2:é"


def plain_impact(edges, maybe, seeds):
    """A queue over edges (source, target, order)."""
    depth, via, queue = {x: 0 for x in seeds}, {}, list(seeds)
    for node in queue:
        for a, _, _ in sorted([e for e in edges if e[1] == node], key=lambda e: (e[0], e[2])):
            if a not in depth:
                depth[a], via[a] = depth[node] + 1, node
                queue.append(a)
    possible = {}
    for a, b, _ in maybe:
        if b in depth and a not in depth:
            possible[a] = min(possible.get(a, 99), depth[b] + 1)
    return {(x, via[x], d) for x, d in depth.items() if d}, set(possible.items())


@pytest.mark.parametrize("seed", range(4))
def test_impact_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randint(0, 14):02d}"
    edges = [(name(), name(), i) for i in range(22)]
    maybe = [(name(), name(), i) for i in range(8)]

    def links(some):
        place = "struct<a:string,b:int,c:string,d:int>"
        df = spark.createDataFrame([(a, b, i) for a, b, i in some], "source string, target string, i int")
        none = F.lit(None).cast(resolve.SYMBOL)
        return df.select("source", "target", F.struct(F.col("source").alias("p"), F.lit(0).alias("s"), F.lit("").alias("q"), F.struct(F.lit("").alias("a"), F.col("i").alias("b"), F.lit("").alias("c"), F.lit(0).alias("d")).cast(place).alias("e")).alias("edge"), none.alias("source_symbol"), none.alias("target_symbol"), F.lit("resolved").alias("resolution"), F.lit("high").alias("confidence"), F.lit("").alias("provenance"), F.lit(None).cast(resolve.RANGE).alias("evidence"), F.lit("calls").alias("relationship"), F.lit("symbol").alias("node_kind"))

    confirmed, possible = traverse.impact(links(edges), links(maybe), spark.createDataFrame([("n00", 1), ("n03", 2)], "node string, pos int"))
    want = plain_impact(edges, maybe, ["n00", "n03"])
    assert {(r.node, r.dependency, r.depth) for r in confirmed.collect()} == want[0]
    assert {(r.node, r.depth) for r in possible.collect()} == want[1]


def test_keys_tell_symbols_apart(spark):
    from graphloom.operators import graph

    df = spark.createDataFrame([(("a|b", "c", 1),), (("a", "b|c", 1),), (("a\\", "b|c", 1),), (("a", "operator|", 1),), (("a|operator", "", 1),)], "x struct<path:string,qualified_name:string,start_byte:int>")
    assert df.select(graph.key("x")).distinct().count() == 5


def test_numbering_by_ranges_equals_one_window(spark, monkeypatch):
    from graphloom.operators import checkpoints

    df = spark.range(200).select((F.col("id") * 37 % 200).alias("k"))
    one = {(r.k, r.pos) for r in checkpoints.numbered(df, ["k"], 200).collect()}
    monkeypatch.setattr(checkpoints, "FEW", 10)
    assert {(r.k, r.pos) for r in checkpoints.numbered(df, ["k"], 200).collect()} == one == {(i, i + 1) for i in range(200)}


def test_empty_tables(spark, tmp_path):
    for t in ("nation", "customer", "orders", "supplier"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name in ("callees", "callers", "file_definitions", "file_outgoing", "path_confirmed", "path_possible", "path_confirmed_steps", "path_possible_steps", "impact_confirmed"):
        assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from graphloom.plans import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", *[queries.QUERIES[q](spark, sys.argv[2]).count() > 0 for q in ("fingerprint_files", "extract_calls")])
"""


@need
def test_workers_get_the_package(tmp_path):
    """Python workers that start elsewhere, without the package on their path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, root, D], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows True True" in done.stdout, done.stderr[-2000:]


def test_candidate_sets_and_hot_names(spark):
    """A name that most calls share: one candidate set, every edge with all of it in order; null names find nothing."""
    place = lambda i: (i, 1, i, 2, i, i + 1)
    files = spark.createDataFrame([("a.cpp", "cpp"), ("b.cpp", "cpp")], "path string, language string")
    symbols = spark.createDataFrame([(p, "function", "definition", "get", f"{n}::get", "get()", place(i)) for i, (p, n) in enumerate([("b.cpp", "y"), ("a.cpp", "x"), ("a.cpp", "z")])] + [("a.cpp", "function", "definition", "one", "one", "one()", place(9))], f"path string, kind string, role string, name string, qualified_name string, signature string, range {resolve.RANGE}")
    calls = spark.createDataFrame([("a.cpp", "one", 9, "get", "get", "unqualified", 0, place(100 + i)) for i in range(50)] + [("a.cpp", "one", 9, "one", "one", "unqualified", 0, place(20)), ("b.cpp", None, None, None, None, "member", 0, place(30))], f"path string, caller_qualified_name string, caller_start_byte int, callee_text string, callee_name string, form string, argument_count int, range {resolve.RANGE}")
    sets = resolve.candidate_sets(resolve.callables(symbols, files)).collect()
    assert [(r["set"], [x.qualified_name for x in r.found]) for r in sets] == [("sget", ["x::get", "y::get", "z::get"])]
    edges = resolve.call_edges(calls, symbols, files).collect()
    assert len(edges) == 52
    hot = [e for e in edges if e.resolution == "ambiguous"]
    assert len(hot) == 50 and all([(c["rank"], c.target_symbol.qualified_name) for c in e.candidates] == [(1, "x::get"), (2, "y::get"), (3, "z::get")] and e.candidate_count == 3 for e in hot)
    rest = sorted((e.resolution, e.target_symbol and e.target_symbol.qualified_name, e.candidate_count, e.candidates) for e in edges if e.resolution != "ambiguous")
    assert rest == [("resolved", "one", 0, None), ("unresolved", None, 0, None)]
