"""Registered queries over the lens, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators import export, graph, incremental, resolve, traverse
from graphloom.plans import lens, sources_lens

_PROOF = ["node", "dependency", "cast(depth as bigint) as depth", "cast(evidence.start_byte as bigint) as evidence", "confidence", "provenance"]
_PATH = "source string, target string, status string, steps long"
Query = Callable[[SparkSession, str], DataFrame]


def flat(edges: DataFrame) -> DataFrame:
    """Edges without nesting; candidates as one string in rank order."""
    shown = F.transform("candidates", lambda c: F.coalesce(c.target_path, graph.key(c.target_symbol)))
    return edges.select(
        "kind", "source_path", F.col("source_symbol.qualified_name").alias("source_name"), F.col("evidence.start_byte").cast("long").alias("start_byte"), "target_text", "resolution", "confidence", "provenance", F.col("candidate_count").cast("long").alias("candidate_count"),
        "target_path", F.col("target_symbol.qualified_name").alias("target_name"), F.col("target_symbol.start_byte").cast("long").alias("target_start"), F.array_join(shown, ";").alias("candidates"),
    )


def _edges(f: dict[str, DataFrame]) -> DataFrame:
    return resolve.relationships(f["files"], f["symbols"], f["calls"], f["includes"])


def _calls(f: dict[str, DataFrame]) -> DataFrame:
    return resolve.call_edges(f["calls"], f["symbols"], f["files"])


def _includes(f: dict[str, DataFrame]) -> DataFrame:
    return resolve.include_edges(f["includes"], f["files"])


def busiest(calls: DataFrame) -> str:
    """Key of the symbol with the most resolved calls into it, the least key of several."""
    top = calls.where("resolution = 'resolved'").groupBy(graph.key("target_symbol").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return top[0] if top else ""


def busiest_file(includes: DataFrame) -> str:
    top = includes.where("resolution = 'resolved'").groupBy("target_path").count().orderBy(F.desc("count"), "target_path").first()
    return top[0] if top else ""


def call_resolution(spark, d):
    return flat(_calls(lens.facts(spark, d)))


def include_resolution(spark, d):
    return flat(_includes(lens.facts(spark, d)))


def defines_edges(spark, d):
    return flat(resolve.defines_edges(lens.facts(spark, d)["symbols"]))


def resolution_summary(spark, d):
    f = lens.facts(spark, d)
    return _edges(f).groupBy("kind", "resolution", "confidence").agg(F.count("*").alias("n"))


def scope_candidates(spark, d):
    c = lens.facts(spark, d)["calls"]
    return c.select("path", F.col("range.start_byte").cast("long").alias("start_byte"), F.posexplode(s.scope_candidates(F.col("caller_qualified_name"), F.col("callee_name"))).alias("tier", "candidate")).withColumn("tier", F.col("tier").cast("long"))


def suffix_match(spark, d):
    return resolve.suffix_index(lens.facts(spark, d)["files"]).select("suffix", F.size("paths").cast("long").alias("n"), F.array_join("paths", ";").alias("paths"))


def scan_classify(spark, d):
    from graphloom.sources.scan import classify

    names = lens.facts(spark, d)["files"].select("path").union(spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("lib/"), F.translate("p_name", " ", "_"), F.element_at(F.array(*[F.lit(x) for x in (".C", ".hh", ".PYI", ".txt", "", ".inc")]), (F.col("p_partkey") % 6 + 1).cast("int")))))
    return classify(names.withColumn("size_bytes", F.length("path").cast("long"))).select("path", "language", "supported", "pruned")


def symbols_selected(spark, d):
    f = lens.facts(spark, d)
    return graph.select_symbol(f["symbols"], "f7").select("path", "kind", "qualified_name", F.col("range.start_byte").cast("long").alias("start_byte"))


def callees(spark, d):
    c = traverse.cut(_calls(lens.facts(spark, d)))
    top = c.where("source_symbol is not null").groupBy(graph.key("source_symbol").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return flat(graph.callees(c, top[0] if top else ""))


def callers(spark, d):
    c = traverse.cut(_calls(lens.facts(spark, d)))
    return flat(graph.callers(c, busiest(c)))


def symbol_counts(spark, d):
    c = traverse.cut(_calls(lens.facts(spark, d)))
    return graph.symbol_counts(c, busiest(c))


def file_definitions(spark, d):
    f = lens.facts(spark, d)
    path = f["symbols"].agg(F.min("path")).first()[0]
    return graph.file_definitions(f["symbols"], path or "").select("path", "kind", "qualified_name", F.col("range.start_byte").cast("long").alias("start_byte"))


def file_outgoing(spark, d):
    i = _includes(lens.facts(spark, d))
    return flat(graph.file_outgoing(i, i.agg(F.min("source_path")).first()[0] or ""))


def file_incoming(spark, d):
    i = _includes(lens.facts(spark, d))
    return flat(graph.file_incoming(i, busiest_file(i)))


def _impact_calls(spark, d):
    c = traverse.cut(_calls(lens.facts(spark, d)))
    seed = spark.createDataFrame([(busiest(c), 1)], "node string, pos int")
    return traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seed)


def impact_confirmed(spark, d):
    return _impact_calls(spark, d)[0].selectExpr(*_PROOF)


def impact_possible(spark, d):
    return _impact_calls(spark, d)[1].selectExpr(*_PROOF)


def impact_ordered(spark, d):
    """Confirmed dependents in the order in which they are reported, as a place within their depth."""
    found = _impact_calls(spark, d)[0]
    return found.select("node", F.col("depth").cast("long").alias("depth"), F.row_number().over(Window.partitionBy("depth").orderBy(*traverse.impact_order(), "node")).cast("long").alias("place"))


def impact_includes(spark, d):
    i = traverse.cut(_includes(lens.facts(spark, d)))
    seed = spark.createDataFrame([(busiest_file(i), 1)], "node string, pos int")
    return traverse.impact(traverse.include_links(i, "resolved"), traverse.include_links(i, "ambiguous"), seed)[0].select("node", F.col("depth").cast("long").alias("depth"))


def impact_file(spark, d):
    """Callers of everything that one file defines."""
    f = lens.facts(spark, d)
    c = traverse.cut(_calls(f))
    path = busiest(c).split("|")[0]
    seeds = resolve.definitions(f["symbols"]).where(F.col("path") == path).select(graph.key(F.struct("path", "qualified_name", F.col("range.start_byte").alias("start_byte"))).alias("node"))
    seeds = seeds.withColumn("pos", F.row_number().over(Window.orderBy("node")))  # of one file
    return traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seeds)[0].select("node", F.col("depth").cast("long").alias("depth"))


def path_confirmed(spark, d):
    """Shortest path from the farthest confirmed caller of the busiest symbol to it."""
    c = traverse.cut(_calls(lens.facts(spark, d)))
    target = busiest(c)
    seed = spark.createDataFrame([(target, 1)], "node string, pos int")
    confirmed, _ = traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seed)
    far = confirmed.orderBy(F.desc("depth"), "node").first()
    if far is None:
        return spark.createDataFrame([], _PATH)
    status, steps = traverse.shortest_path(c, far["node"], target)
    return spark.createDataFrame([(far["node"], target, status, len(steps))], _PATH)


def path_possible(spark, d):
    """Shortest path that needs an ambiguous call: from the least possible caller of the busiest symbol to it."""
    c = traverse.cut(_calls(lens.facts(spark, d)))
    target = busiest(c)
    seed = spark.createDataFrame([(target, 1)], "node string, pos int")
    _, possible = traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seed)
    near = possible.orderBy("node").first()
    if near is None:
        return spark.createDataFrame([], _PATH)
    status, steps = traverse.shortest_path(c, near["node"], target)
    return spark.createDataFrame([(near["node"], target, status, len(steps))], _PATH)


def _steps(spark, steps):
    """Rows of a path's steps, from 1."""
    rows = [(i, r["source"], r["node"], r["resolution"], r["provenance"], r["evidence"]["start_byte"]) for i, r in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step long, source string, target string, resolution string, provenance string, evidence long")


def path_confirmed_steps(spark, d):
    """The steps of path_confirmed."""
    c = traverse.cut(_calls(lens.facts(spark, d)))
    target = busiest(c)
    seed = spark.createDataFrame([(target, 1)], "node string, pos int")
    far = traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seed)[0].orderBy(F.desc("depth"), "node").first()
    return _steps(spark, traverse.shortest_path(c, far["node"], target)[1] if far else [])


def path_possible_steps(spark, d):
    """The steps of path_possible."""
    c = traverse.cut(_calls(lens.facts(spark, d)))
    target = busiest(c)
    seed = spark.createDataFrame([(target, 1)], "node string, pos int")
    near = traverse.impact(traverse.call_links(c, "resolved"), traverse.call_links(c, "ambiguous"), seed)[1].orderBy("node").first()
    return _steps(spark, traverse.shortest_path(c, near["node"], target)[1] if near else [])


def edges_ordered(spark, d):
    """Every edge's place among those of its source file."""
    e = _edges(lens.facts(spark, d))
    return e.select("source_path", "kind", "target_text", F.col("evidence.start_byte").cast("long").alias("start_byte"), F.row_number().over(Window.partitionBy("source_path").orderBy(*resolve.edge_order())).cast("long").alias("place"))


def calls_ordered(spark, d):
    """Every call's place among those of its caller."""
    c = _calls(lens.facts(spark, d)).where("source_symbol is not null")
    return c.select(graph.key("source_symbol").alias("caller"), F.col("evidence.start_byte").cast("long").alias("start_byte"), F.row_number().over(Window.partitionBy(graph.key("source_symbol")).orderBy(*graph.call_order())).cast("long").alias("place"))


def includes_ordered(spark, d):
    """Every include's place among those of its folder's files."""
    i = _includes(lens.facts(spark, d))
    return i.select("source_path", F.col("evidence.start_byte").cast("long").alias("start_byte"), F.row_number().over(Window.partitionBy(s.folder(F.col("source_path"))).orderBy(*graph.include_order())).cast("long").alias("place"))


def name_functions(spark, d):
    c = lens.facts(spark, d)["calls"]
    return c.select("path", F.col("range.start_byte").cast("long").alias("start_byte"), s.unqualified_name(F.col("callee_text")).alias("short"), s.before_template(F.col("callee_text")).alias("head"), s.strip_template_arguments(F.col("callee_text")).alias("bare"), s.ordinal(F.col("form"), ("qualified", "unqualified", "member", "indirect")).cast("long").alias("form"))


def _analysed(spark, d):
    from graphloom.sources.extract import analyses

    return analyses(sources_lens.files(spark, d).withColumn("content_fingerprint", F.lit("")))


def _places(df):
    return [F.col(f"range.{c}").cast("long").alias(c) for c in ("start_line", "start_column", "start_byte")]


def extract_symbols(spark, d):
    from graphloom.sources.extract import fact_table

    found = fact_table(_analysed(spark, d), "symbols").where("path not like 'b/%'")
    return found.select("path", "kind", "role", "name", "qualified_name", "signature", *_places(found))


def extract_includes(spark, d):
    from graphloom.sources.extract import fact_table

    found = fact_table(_analysed(spark, d), "includes")
    return found.select("path", "target", F.col("is_system").cast("long").alias("system"), *_places(found))


def extract_calls(spark, d):
    from graphloom.sources.extract import fact_table

    found = fact_table(_analysed(spark, d), "calls")
    return found.select("path", F.col("caller_qualified_name").alias("caller"), "callee_text", "callee_name", "form", F.col("argument_count").cast("long").alias("arguments"), *_places(found))


def extract_diagnostics(spark, d):
    found = _analysed(spark, d).select("path", incremental.parse_status("status", "diagnostics").alias("parse_status"), F.explode_outer("diagnostics").alias("x"))
    return found.select("path", "parse_status", "x.code", "x.message", F.col("x.range.start_line").cast("long").alias("start_line"))


def integrity_planted(spark, d):
    """Facts with violations of every rule planted, by nation."""
    from graphloom.sources.store import violations

    f = lens.facts(spark, d)
    e = traverse.cut(_edges(f))
    nations = spark.read.parquet(f"{d}/nation.parquet").crossJoin(f["files"].agg(F.min("path").alias("known")))  # one row
    name = F.col("n_nationkey").cast("string")
    none, symbol = F.lit(None), lambda path: F.struct(path.alias("path"), F.lit("x").alias("qualified_name"), F.lit("definition").alias("role"), F.lit(0).alias("start_byte")).cast(resolve.SYMBOL)
    one = lambda path, rank: F.array(F.struct(path.alias("target_path"), none.cast(resolve.SYMBOL).alias("target_symbol"), F.lit("").alias("reason"), F.lit(rank).alias("rank"))).cast(resolve.CANDIDATES)
    sound = {"kind": F.lit("includes"), "source_path": F.col("known"), "source_symbol": none.cast(resolve.SYMBOL), "target_path": F.lit("x"), "target_symbol": none.cast(resolve.SYMBOL), "target_text": name, "resolution": F.lit("unresolved"), "confidence": F.lit("low"), "provenance": F.lit("planted"), "candidate_count": F.lit(0), "evidence": none.cast(resolve.RANGE), "candidates": none.cast(resolve.CANDIDATES)}
    planted = [
        ("n_regionkey = 0", {"resolution": F.lit("resolved"), "target_path": none.cast("string")}),
        ("true", {"kind": F.lit("calls")}),
        ("n_regionkey <= 1", {"kind": F.lit("defines")}),
        ("n_regionkey <= 2", {"candidates": one(F.lit("x"), 0)}),
        ("n_regionkey <= 3", {"candidates": one(none.cast("string"), 1)}),
        ("n_regionkey >= 1", {"target_symbol": symbol(F.concat(F.lit("nowhere/"), name))}),
        ("n_regionkey >= 2", {"source_path": F.concat(F.lit("gone/"), name)}),
    ]
    for which, changed in planted:
        e = e.unionByName(nations.where(which).select(*[(sound | changed)[c].alias(c) for c in resolve.COLUMNS]))
    return violations(f["files"].union(f["files"].where("path like 'r0/%'")), f["symbols"].union(f["symbols"].where("path like 'r1/%'")), e)


def export_nodes(spark, d):
    f = lens.facts(spark, d)
    return export.nodes(f["files"], f["symbols"]).select("id", "type", "file", "role")


def export_edges(spark, d):
    f = lens.facts(spark, d)
    return export.edges(f["symbols"], _edges(f)).select("id", "type", "source", "target", "resolution", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("candidates"))


def integrity_checks(spark, d):
    from graphloom.sources.store import violations

    f = lens.facts(spark, d)
    return violations(f["files"], f["symbols"], traverse.cut(_edges(f)))


def _snapshots(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")

    # a file for each customer and year: the snapshots share all orders but those of the first and the last months
    path = F.concat(F.lit("c/"), F.col("o_custkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(".cpp"))

    def of(kept):
        # order-independent and bounded per file: a sum of digests instead of a list
        part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))), 1, 8), 16, 10).cast("long")
        return kept.groupBy(path.alias("path")).agg(F.sum(part).cast("string").alias("content_fingerprint")).withColumn("language", F.lit("cpp"))

    return of(o.where(F.col("o_orderdate") < F.lit("2001-04-01").cast("timestamp"))), of(o.where(F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp")))


def incremental_diff(spark, d):
    old, new = _snapshots(spark, d)
    return incremental.changes(old, new).groupBy("change").agg(F.count("*").alias("n"))


def reuse_plan(spark, d):
    old, new = _snapshots(spark, d)
    return incremental.changes(old, new).select("path", "change", F.col("change").isin("added", "modified").alias("parse"))


def page_links(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "target")).withColumn("place", F.col("place").cast("long"))


def fingerprint_files(spark, d):
    """Fingerprints of file contents: a file for every turn of every conversation."""
    from graphloom.sources.scan import fingerprints

    turns = spark.read.parquet(f"{d}/conversations.parquet")
    files = turns.select(F.concat_ws("/", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return fingerprints(files).select("path", "content_fingerprint")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (call_resolution, include_resolution, defines_edges, resolution_summary, scope_candidates, suffix_match, scan_classify, symbols_selected, callees, callers, symbol_counts, file_definitions, file_outgoing, file_incoming,
              impact_confirmed, impact_possible, impact_includes, impact_file, path_confirmed, path_possible, export_nodes, export_edges, integrity_checks, incremental_diff, reuse_plan, page_links, fingerprint_files,
              impact_ordered, path_confirmed_steps, path_possible_steps, edges_ordered, calls_ordered, includes_ordered, name_functions, extract_symbols, extract_includes, extract_calls, extract_diagnostics, integrity_planted)
}

# --- the same in DuckDB ---

_FACTS = f"""
lens_files AS ({lens.FILES_SQL}), lens_symbols AS ({lens.SYMBOLS_SQL}), lens_calls AS ({lens.CALLS_SQL}), lens_includes AS ({lens.INCLUDES_SQL}),
defs AS (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'c-family' END AS family FROM lens_symbols WHERE role = 'definition'),
targets AS (SELECT * FROM defs WHERE kind IN ('function', 'method'))
"""

_CALLS = f"""{_FACTS},
c AS (
  SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'c-family' END AS family, regexp_replace(regexp_replace(callee_text, '<[^<>]*>', '', 'g'), '^::', '') AS stripped, string_split(caller_qualified_name, '::') AS p FROM lens_calls
), probe AS (
  SELECT path, start_byte, family, 0 AS tier, stripped AS lookup FROM c WHERE form = 'qualified'
  UNION ALL
  SELECT path, start_byte, family, 1 + len(p) - 1 - i AS tier, array_to_string(p[1:i], '::') || CASE WHEN i > 0 THEN '::' ELSE '' END || CASE WHEN form = 'qualified' THEN stripped ELSE callee_name END AS lookup
  FROM c, range(0, 10) r(i) WHERE form IN ('qualified', 'unqualified') AND i < len(p)
), hit AS (
  SELECT pr.path, pr.start_byte, tier, t.qualified_name, t.path AS tpath, t.start_byte AS tstart FROM probe pr JOIN targets t ON pr.family = t.family AND pr.lookup = t.qualified_name
), first AS (SELECT path, start_byte, min(tier) AS tier FROM hit GROUP BY 1, 2),
short AS (
  SELECT c.path, c.start_byte, CAST(NULL AS BIGINT) AS tier, t.qualified_name, t.path AS tpath, t.start_byte AS tstart
  FROM c JOIN targets t ON c.family = t.family AND c.callee_name = t.name WHERE form <> 'indirect' AND NOT EXISTS (SELECT 1 FROM first f WHERE f.path = c.path AND f.start_byte = c.start_byte)
), found AS (
  SELECT hit.* FROM hit JOIN first USING (path, start_byte, tier) UNION ALL SELECT * FROM short
), grouped AS (
  SELECT path, start_byte, min(tier) AS tier, count(*) AS n, string_agg(tpath || '|' || qualified_name || '|' || tstart, ';' ORDER BY qualified_name, tpath, tstart) AS listed, min(tpath) AS tpath, min(qualified_name) AS tname, min(tstart) AS tstart
  FROM found GROUP BY 1, 2
), call_edges AS (
  SELECT 'calls' AS kind, c.path AS source_path, caller_qualified_name AS source_name, CAST(c.start_byte AS BIGINT) AS start_byte, callee_text AS target_text,
    CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution,
    CASE WHEN tier IS NOT NULL THEN 'high' WHEN n > 0 AND form <> 'member' THEN 'medium' ELSE 'low' END AS confidence,
    'tree-sitter-call:' || form || ':' || CASE WHEN form = 'qualified' AND tier = 0 THEN 'qualified-name-match' WHEN form = 'qualified' AND tier > 0 THEN 'scoped-qualified-match' WHEN tier IS NOT NULL THEN 'lexical-scope-match'
      WHEN n > 0 AND form = 'member' THEN 'member-name-match' WHEN n > 0 THEN 'repository-name-match' ELSE 'no-match' END AS provenance,
    CASE WHEN n > 1 THEN n ELSE 0 END AS candidate_count, CASE WHEN n = 1 THEN tpath END AS target_path, CASE WHEN n = 1 THEN tname END AS target_name, CASE WHEN n = 1 THEN CAST(tstart AS BIGINT) END AS target_start, CASE WHEN n > 1 THEN listed END AS candidates,
    caller_start_byte, found_n
  FROM c LEFT JOIN (SELECT *, n AS found_n FROM grouped) g USING (path, start_byte)
)
"""

_INCLUDES = f"""{_FACTS},
i AS (
  SELECT *, path LIKE '%.py' AS python, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '/[^/]*\\.py$', '') AS pkg FROM lens_includes
), j AS (
  SELECT *, regexp_replace(regexp_replace(dir || '/' || target, '[^/]+/\\.\\./', '', 'g'), '/\\./', '/', 'g') AS near, regexp_replace(regexp_replace(target, '[^/]+/\\.\\./', '', 'g'), '/\\./', '/', 'g') AS root,
    CASE WHEN target LIKE '.%' THEN replace(pkg, '/', '.') || target ELSE target END AS module FROM i
), matched AS (
  SELECT j.path, j.start_byte, CASE WHEN f.path = near THEN 0 WHEN f.path = root THEN 1 ELSE 2 END AS tier, f.path AS tpath FROM j JOIN lens_files f ON NOT python AND NOT is_system AND (f.path = near OR f.path = root OR f.path LIKE '%/' || root)
  UNION ALL SELECT j.path, j.start_byte, 3, f.path FROM j JOIN lens_files f ON python AND f.path LIKE '%.py' AND replace(regexp_replace(f.path, '\\.py$', ''), '/', '.') = module
), best AS (SELECT * FROM matched QUALIFY tier = min(tier) OVER (PARTITION BY path, start_byte)),
grouped AS (SELECT path, start_byte, min(tier) AS tier, count(*) AS n, min(tpath) AS tpath, string_agg(tpath, ';' ORDER BY tpath) AS listed FROM best GROUP BY 1, 2),
include_edges AS (
  SELECT 'includes' AS kind, j.path AS source_path, CAST(NULL AS VARCHAR) AS source_name, CAST(j.start_byte AS BIGINT) AS start_byte, target AS target_text, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution,
    CASE WHEN n IS NULL OR n <> 1 THEN 'low' WHEN tier = 2 THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN python AND n > 0 THEN 'python-import:module-match' WHEN python THEN 'python-import:no-match' WHEN is_system THEN 'system-include' WHEN tier = 0 THEN 'relative-path-match' WHEN tier = 1 THEN 'repository-root-match' ELSE 'path-suffix-match' END AS provenance,
    CASE WHEN n > 1 THEN n ELSE 0 END AS candidate_count, CASE WHEN n = 1 THEN tpath END AS target_path, CAST(NULL AS VARCHAR) AS target_name, CAST(NULL AS BIGINT) AS target_start, CASE WHEN n > 1 THEN listed END AS candidates
  FROM j LEFT JOIN grouped USING (path, start_byte)
)
"""

_DEFINES = "SELECT 'defines' AS kind, path AS source_path, CAST(NULL AS VARCHAR) AS source_name, CAST(start_byte AS BIGINT) AS start_byte, qualified_name AS target_text, 'resolved' AS resolution, 'high' AS confidence, 'tree-sitter-definition' AS provenance, CAST(0 AS BIGINT) AS candidate_count, path AS target_path, qualified_name AS target_name, CAST(start_byte AS BIGINT) AS target_start, CAST(NULL AS VARCHAR) AS candidates FROM defs"
_FLAT = "kind, source_path, source_name, start_byte, target_text, resolution, confidence, provenance, candidate_count, target_path, target_name, target_start, candidates"
_INC_ONLY = _INCLUDES.split(f"{_FACTS},", 1)[1].replace("grouped", "igrouped").replace("best", "ibest").replace("matched", "imatched")
_ALL = f"{_CALLS}, {_INC_ONLY}"

_BUSY = """busy AS (SELECT target_path || '|' || target_name || '|' || target_start AS k FROM call_edges WHERE resolution = 'resolved' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_LINKS = """links AS (SELECT source_path || '|' || source_name || '|' || caller_start_byte AS source, target_path || '|' || target_name || '|' || target_start AS target FROM call_edges WHERE resolution = 'resolved'),
maybe AS (SELECT source_path || '|' || source_name || '|' || caller_start_byte AS source, unnest(string_split(candidates, ';')) AS target FROM call_edges WHERE resolution = 'ambiguous')"""
_REACH = "reach(node, depth) AS (SELECT k, 0 FROM {seed} UNION SELECT l.source, depth + 1 FROM reach JOIN {links} l ON l.target = reach.node WHERE depth < 40), least AS (SELECT node, min(depth) AS depth FROM reach GROUP BY 1)"
# breadth-first search with the order of a queue: by the parent's place in its level, then the edge
_EDGES = """edge_list AS (SELECT source_path || '|' || source_name || '|' || caller_start_byte AS source, target_path || '|' || target_name || '|' || target_start AS target, 'resolved' AS resolution, {'a': source_path, 'b': caller_start_byte, 'c': source_name, 'd': start_byte, 'e': target_text} AS place, start_byte, confidence, provenance, source_name, source_path, caller_start_byte FROM call_edges WHERE resolution = 'resolved'),
maybe_list AS (SELECT source_path || '|' || source_name || '|' || caller_start_byte AS source, unnest(string_split(candidates, ';')) AS target, 'ambiguous' AS resolution, {'a': source_path, 'b': caller_start_byte, 'c': source_name, 'd': start_byte, 'e': target_text} AS place, start_byte, confidence, provenance, source_name, source_path, caller_start_byte FROM call_edges WHERE resolution = 'ambiguous')"""
_QUEUE = """queue(node, depth, pos, dependency, evidence, confidence, provenance) USING KEY (node) AS (
  SELECT k, 0, CAST(1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM busy
  UNION
  SELECT node, depth, row_number() OVER (ORDER BY rank), dependency, evidence, confidence, provenance FROM (
    SELECT l.source AS node, min(q.depth) + 1 AS depth, min({'pos': q.pos, 'place': l.place}) AS rank, arg_min(q.node, {'pos': q.pos, 'place': l.place}) AS dependency, arg_min(l.start_byte, {'pos': q.pos, 'place': l.place}) AS evidence,
      arg_min(l.confidence, {'pos': q.pos, 'place': l.place}) AS confidence, arg_min(l.provenance, {'pos': q.pos, 'place': l.place}) AS provenance
    FROM queue q JOIN edge_list l ON l.target = q.node WHERE l.source NOT IN (SELECT node FROM recurring.queue) GROUP BY l.source)
)"""
_AMONG = """SELECT m.source AS node, arg_min(q.node, {'d': q.depth, 'pos': q.pos, 'place': m.place}) AS dependency, CAST(min(q.depth) + 1 AS BIGINT) AS depth, CAST(arg_min(m.start_byte, {'d': q.depth, 'pos': q.pos, 'place': m.place}) AS BIGINT) AS evidence,
  arg_min(m.confidence, {'d': q.depth, 'pos': q.pos, 'place': m.place}) AS confidence, arg_min(m.provenance, {'d': q.depth, 'pos': q.pos, 'place': m.place}) AS provenance FROM maybe_list m JOIN queue q ON m.target = q.node WHERE m.source NOT IN (SELECT node FROM queue) GROUP BY 1"""
_WALK = f"""every AS (SELECT *, {{{{'a': CASE resolution WHEN 'resolved' THEN {s.RESOLUTIONS.index('resolved')} ELSE {s.RESOLUTIONS.index('ambiguous')} END, 'b': string_split(target, '|')[2], 'c': string_split(target, '|')[1], 'd': CAST(string_split(target, '|')[3] AS BIGINT), 'e': start_byte, 'g': list_position({list(s.CONFIDENCES)!r}, confidence), 'h': provenance}}}} AS rank FROM {{links}}),
walk(node, pos, parent, resolution, evidence, provenance) USING KEY (node) AS (
  SELECT a, CAST(1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM start
  UNION
  SELECT node, row_number() OVER (ORDER BY rank, node), parent, resolution, evidence, provenance FROM (
    SELECT e.target AS node, min({{{{'pos': w.pos, 'rank': e.rank}}}}) AS rank, arg_min(w.node, {{{{'pos': w.pos, 'rank': e.rank}}}}) AS parent, arg_min(e.resolution, {{{{'pos': w.pos, 'rank': e.rank}}}}) AS resolution, arg_min(e.start_byte, {{{{'pos': w.pos, 'rank': e.rank}}}}) AS evidence, arg_min(e.provenance, {{{{'pos': w.pos, 'rank': e.rank}}}}) AS provenance
    FROM walk w JOIN every e ON e.source = w.node WHERE e.target NOT IN (SELECT node FROM recurring.walk) GROUP BY e.target)
),
back(node, parent, n, resolution, evidence, provenance) AS (
  SELECT w.node, w.parent, 0, w.resolution, w.evidence, w.provenance FROM walk w, busy WHERE w.node = k
  UNION ALL SELECT w.node, w.parent, n + 1, w.resolution, w.evidence, w.provenance FROM back b JOIN walk w ON w.node = b.parent
)
SELECT CAST(max(n) OVER () - n + 1 AS BIGINT) AS step, parent AS source, node AS target, resolution, provenance, CAST(evidence AS BIGINT) AS evidence FROM back WHERE parent IS NOT NULL"""
_SID = "'symbol:' || strlen({p}) || ':' || {p} || strlen({k}) || ':' || {k} || {b} || ':' || strlen({q}) || ':' || {q}"
_FID = "'file:' || strlen({p}) || ':' || {p}"


def _eid(kind: str, source: str, start: str, text: str) -> str:
    return f"'edge:{len(kind)}:{kind}' || strlen({source}) || ':' || {source} || {start} || ':' || strlen({text}) || ':' || {text}"


_ME = _SID.format(p="path", k="kind", b="start_byte", q="qualified_name")
_DIFF = """
WITH o AS (SELECT 'c/' || o_custkey || '/' || year(o_orderdate) || '.cpp' AS path, o_orderdate AS d, CAST('0x' || substr(md5(o_orderkey || ':' || o_orderstatus), 1, 8) AS BIGINT) AS x FROM orders),
a AS (SELECT path, sum(x) AS f FROM o WHERE d < TIMESTAMP '2001-04-01' GROUP BY 1), b AS (SELECT path, sum(x) AS f FROM o WHERE d >= TIMESTAMP '1995-07-01' GROUP BY 1),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.f = b.f THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path)
"""

SQL = {
    "call_resolution": f"WITH {_CALLS} SELECT {_FLAT} FROM call_edges",
    "include_resolution": f"WITH {_INCLUDES} SELECT {_FLAT} FROM include_edges",
    "defines_edges": f"WITH {_FACTS} {_DEFINES}",
    "resolution_summary": f"WITH {_ALL}, every AS (SELECT {_FLAT} FROM call_edges UNION ALL SELECT {_FLAT} FROM include_edges UNION ALL {_DEFINES}) SELECT kind, resolution, confidence, count(*) AS n FROM every GROUP BY ALL",
    "scope_candidates": f"WITH {_FACTS}, c AS (SELECT *, string_split(caller_qualified_name, '::') AS p FROM lens_calls) SELECT path, CAST(start_byte AS BIGINT) AS start_byte, CAST(len(p) - 1 - i AS BIGINT) AS tier, array_to_string(p[1:i], '::') || CASE WHEN i > 0 THEN '::' ELSE '' END || callee_name AS candidate FROM c, range(0, 10) r(i) WHERE i < len(p)",
    "suffix_match": f"WITH {_FACTS}, e AS (SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM lens_files, range(1, 10) r(i) WHERE i <= len(string_split(path, '/'))) SELECT suffix, count(*) AS n, string_agg(path, ';' ORDER BY path) AS paths FROM e GROUP BY 1",
    "scan_classify": f"WITH {_FACTS}, p AS (SELECT path FROM lens_files UNION ALL SELECT 'lib/' || replace(p_name, ' ', '_') || (['.C', '.hh', '.PYI', '.txt', '', '.inc'])[p_partkey % 6 + 1] FROM part), e AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS x FROM p) SELECT path, CASE WHEN x = '.c' THEN 'c' WHEN x IN ('.py', '.pyi') THEN 'python' ELSE 'cpp' END AS language, x IN ('.c', '.cc', '.cpp', '.cxx', '.h', '.hh', '.hpp', '.hxx', '.inc', '.py', '.pyi') AS supported, false AS pruned FROM e",
    "symbols_selected": f"WITH {_FACTS} SELECT path, kind, qualified_name, CAST(start_byte AS BIGINT) AS start_byte FROM defs WHERE name = 'f7'",
    "callees": f"WITH {_CALLS}, top AS (SELECT source_path || '|' || source_name || '|' || caller_start_byte AS k FROM call_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT {_FLAT} FROM call_edges, top WHERE source_path || '|' || source_name || '|' || caller_start_byte = k",
    "callers": f"WITH {_CALLS}, {_BUSY} SELECT {_FLAT} FROM call_edges, busy WHERE target_path || '|' || target_name || '|' || target_start = k OR list_contains(string_split(candidates, ';'), k)",
    "symbol_counts": f"WITH {_CALLS}, {_BUSY}, m AS (SELECT *, source_path || '|' || source_name || '|' || caller_start_byte = k AS o, coalesce(target_path || '|' || target_name || '|' || target_start = k, false) AS t, coalesce(list_contains(string_split(candidates, ';'), k), false) AS x FROM call_edges, busy) SELECT count(*) FILTER (o AND resolution = 'resolved') AS callees_resolved, count(*) FILTER (o AND resolution = 'ambiguous') AS callees_ambiguous, count(*) FILTER (o AND resolution = 'unresolved') AS callees_unresolved, count(*) FILTER (t) AS callers_resolved, count(*) FILTER (x) AS callers_ambiguous, CAST(0 AS BIGINT) AS callers_unresolved FROM m",
    "file_definitions": f"WITH {_FACTS} SELECT path, kind, qualified_name, CAST(start_byte AS BIGINT) AS start_byte FROM defs WHERE path = (SELECT min(path) FROM lens_symbols)",
    "file_outgoing": f"WITH {_INCLUDES} SELECT {_FLAT} FROM include_edges WHERE source_path = (SELECT min(source_path) FROM include_edges)",
    "file_incoming": f"WITH {_INCLUDES}, busy AS (SELECT target_path AS k FROM include_edges WHERE resolution = 'resolved' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT {_FLAT} FROM include_edges, busy WHERE source_path <> k AND (target_path = k OR list_contains(string_split(candidates, ';'), k))",
    "impact_confirmed": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_EDGES}, {_QUEUE} SELECT node, dependency, CAST(depth AS BIGINT) AS depth, CAST(evidence AS BIGINT) AS evidence, confidence, provenance FROM queue WHERE depth > 0",
    "impact_possible": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_EDGES}, {_QUEUE} {_AMONG}",
    "impact_ordered": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_EDGES}, {_QUEUE} SELECT node, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY depth ORDER BY string_split(node, '|')[2], string_split(node, '|')[1], evidence, node) AS place FROM queue WHERE depth > 0",
    "path_confirmed_steps": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_EDGES}, {_QUEUE}, start AS (SELECT node AS a FROM queue WHERE depth > 0 ORDER BY depth DESC, node LIMIT 1), {_WALK.format(links='edge_list')}",
    "path_possible_steps": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_EDGES}, {_QUEUE}, start AS (SELECT min(m.source) AS a FROM maybe_list m JOIN queue q ON m.target = q.node WHERE m.source NOT IN (SELECT node FROM queue)), {_WALK.format(links='(SELECT * FROM edge_list UNION ALL SELECT * FROM maybe_list)')}",
    "edges_ordered": f"WITH {_ALL}, every AS (SELECT {_FLAT} FROM call_edges UNION ALL SELECT {_FLAT} FROM include_edges UNION ALL {_DEFINES}) SELECT source_path, kind, target_text, start_byte, row_number() OVER (PARTITION BY source_path ORDER BY start_byte, list_position({list(s.RELATIONSHIP_KINDS)!r}, kind), target_text, provenance) AS place FROM every",
    "calls_ordered": f"WITH {_CALLS} SELECT source_path || '|' || source_name || '|' || caller_start_byte AS caller, start_byte, row_number() OVER (PARTITION BY source_path || '|' || source_name || '|' || caller_start_byte ORDER BY source_path, start_byte, target_text) AS place FROM call_edges",
    "includes_ordered": f"WITH {_INCLUDES} SELECT source_path, start_byte, row_number() OVER (PARTITION BY regexp_replace(source_path, '/[^/]*$', '') ORDER BY source_path, coalesce(target_path, ''), target_text, start_byte, list_position({list(s.RESOLUTIONS)!r}, resolution), list_position({list(s.CONFIDENCES)!r}, confidence), provenance) AS place FROM include_edges",
    "name_functions": f"WITH {_FACTS} SELECT path, CAST(start_byte AS BIGINT) AS start_byte, string_split(callee_text, '::')[-1] AS short, string_split(callee_text, '<')[1] AS head, regexp_replace(regexp_replace(callee_text, '<[^<>]*>', '', 'g'), '^::', '') AS bare, CAST(list_position(['qualified', 'unqualified', 'member', 'indirect'], form) AS BIGINT) AS form FROM lens_calls",
    "extract_symbols": sources_lens.SYMBOLS_SQL,
    "extract_includes": sources_lens.INCLUDES_SQL,
    "extract_calls": sources_lens.CALLS_SQL,
    "extract_diagnostics": sources_lens.DIAGNOSTICS_SQL,
    "fingerprint_files": f"""WITH t AS (SELECT 't/' || conv_id || '/' || turn AS path, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM conversations)
      SELECT path, lpad(lower(to_hex(list_reduce(list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UHUGEINT)), lambda x, y: (xor(x, y) * CAST({s.FNV_PRIME} AS UHUGEINT)) % CAST({1 << 64} AS UHUGEINT), CAST({s.FNV_OFFSET} AS UHUGEINT))::UBIGINT)), 16, '0') AS content_fingerprint FROM t""",
    "integrity_planted": f"""WITH {_FACTS}, n AS (SELECT n_regionkey AS r FROM nation)
      SELECT 'file paths are unique' AS rule, count(*) AS rows FROM lens_files WHERE path LIKE 'r0/%' UNION ALL SELECT 'symbols are unique', count(*) FROM lens_symbols WHERE path LIKE 'r1/%'
      UNION ALL SELECT 'a resolved edge has a target', count(*) FROM n WHERE r = 0 UNION ALL SELECT 'a call has a caller', count(*) FROM n UNION ALL SELECT 'a definition edge has a symbol', count(*) FROM n WHERE r <= 1
      UNION ALL SELECT 'candidates are ranked from one', count(*) FROM n WHERE r <= 2 UNION ALL SELECT 'a candidate has a target', count(*) FROM n WHERE r <= 3
      UNION ALL SELECT 'targets are known symbols', count(*) FROM n WHERE r >= 1 UNION ALL SELECT 'sources are known files', count(*) FROM n WHERE r >= 2""",
    "impact_includes": f"WITH RECURSIVE {_INCLUDES}, busy AS (SELECT target_path AS k FROM include_edges WHERE resolution = 'resolved' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), links AS (SELECT source_path AS source, target_path AS target FROM include_edges WHERE resolution = 'resolved'), {_REACH.format(seed='busy', links='links')} SELECT node, CAST(depth AS BIGINT) AS depth FROM least WHERE depth > 0",
    "impact_file": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_LINKS}, seeds AS (SELECT path || '|' || qualified_name || '|' || start_byte AS k FROM defs WHERE path = (SELECT string_split(k, '|')[1] FROM busy)), {_REACH.format(seed='seeds', links='links')} SELECT node, CAST(depth AS BIGINT) AS depth FROM least WHERE depth > 0",
    "path_confirmed": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_LINKS}, {_REACH.format(seed='busy', links='links')} SELECT node AS source, k AS target, 'confirmed' AS status, CAST(depth AS BIGINT) AS steps FROM least, busy WHERE depth > 0 ORDER BY depth DESC, node LIMIT 1",
    "path_possible": f"WITH RECURSIVE {_CALLS}, {_BUSY}, {_LINKS}, {_REACH.format(seed='busy', links='links')}, near AS (SELECT min(m.source) AS node FROM maybe m JOIN least ON m.target = least.node WHERE m.source NOT IN (SELECT node FROM least)), every AS (SELECT source, target FROM links UNION SELECT source, target FROM maybe), {_REACH.format(seed='busy', links='every').replace('reach', 'wide').replace('least', 'shortest')} SELECT w.node AS source, k AS target, 'possible' AS status, CAST(w.depth AS BIGINT) AS steps FROM shortest w JOIN near USING (node), busy",
    "export_nodes": f"WITH {_FACTS} SELECT {_FID.format(p='path')} AS id, 'file' AS type, path AS file, CAST(NULL AS VARCHAR) AS role FROM lens_files UNION ALL SELECT {_ME}, 'symbol', path, 'definition' FROM defs",
    "export_edges": f"""WITH {_ALL}, d AS (SELECT *, {_ME} AS me, path || '|' || qualified_name || '|' || start_byte AS k FROM defs),
      e AS (SELECT s.me AS source, t.me AS target, c.* FROM call_edges c JOIN d s ON s.k = source_path || '|' || source_name || '|' || caller_start_byte LEFT JOIN d t ON t.k = target_path || '|' || target_name || '|' || target_start),
      n AS (SELECT *, {_FID.format(p='source_path')} AS source, {_FID.format(p='target_path')} AS target FROM include_edges)
      SELECT {_eid('defines', _FID.format(p='path').join(('(', ')')), 'start_byte', 'me')} AS id, 'defines' AS type, {_FID.format(p='path')} AS source, me AS target, 'resolved' AS resolution, CAST(0 AS BIGINT) AS candidates FROM d
      UNION ALL SELECT {_eid('calls', 'source', 'start_byte', 'target_text')}, 'calls', source, target, resolution, candidate_count FROM e
      UNION ALL SELECT {_eid('includes', 'source', 'start_byte', 'target_text')}, 'includes', source, target, resolution, candidate_count FROM n""",
    "integrity_checks": "SELECT 'x' AS rule, CAST(0 AS BIGINT) AS rows WHERE false",
    "incremental_diff": f"{_DIFF} SELECT change, count(*) AS n FROM diff GROUP BY 1",
    "reuse_plan": f"{_DIFF} SELECT path, change, change IN ('added', 'modified') AS parse FROM diff",
    "page_links": "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS t FROM pages) SELECT page_id, CAST(unnest(range(len(t))) AS BIGINT) AS place, unnest(t) AS target FROM l",
}
