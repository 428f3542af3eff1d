"""Cross-file resolution: definitions, calls and includes become edges with evidence and ranked candidates.

Lookups are grouped once into one row per key, so that a call or include stays one row through every join: a name that
half the repository shares costs one array, not a row per pair. Calls are matched by the number of a name's definitions and
the first of them; the sorted arrays of candidates stay apart, one for each ambiguous name, and are joined to the finished
edges last (and not read where nobody asks for candidates). First-match tiers are one equi-join on exploded scope names
and a minimum; the short-name tier runs only over calls that the tiers left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as s

RANGE = "struct<start_line:int,start_column:int,end_line:int,end_column:int,start_byte:int,end_byte:int>"
SYMBOL = "struct<path:string,qualified_name:string,role:string,start_byte:int>"
CANDIDATES = f"array<struct<target_path:string,target_symbol:{SYMBOL},reason:string,rank:int>>"
COLUMNS = ["kind", "source_path", "source_symbol", "target_path", "target_symbol", "target_text", "resolution", "confidence", "provenance", "candidate_count", "evidence", "candidates"]

# Reasons stored with candidates (provenance strings stand where edges are made, fixed too).
CALL_REASON = "matching callable definition"
INCLUDE_REASON, IMPORT_REASON = "repository path suffix match", "matching Python module"


def definitions(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("role") == "definition")


def callables(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Definitions that calls can reach: functions and methods, with their language family."""
    d = definitions(symbols).where(F.col("kind").isin("function", "method"))
    return d.join(files.select("path", s.language_family(F.col("language")).alias("family")), "path")


def _full(name: Column) -> Column:
    return F.concat(F.lit("q"), name)


def _short(name: Column) -> Column:
    return F.concat(F.lit("s"), name)


def _named(defs: DataFrame) -> DataFrame:
    """``family, set, found``: every definition under the keys of its qualified and of its short name."""
    found = F.struct("qualified_name", "path", F.col("range.start_byte").alias("start_byte"))
    return defs.select("family", F.explode(F.array(_full(F.col("qualified_name")), _short(F.col("name")))).alias("set"), found.alias("found"))


def candidate_sets(defs: DataFrame) -> DataFrame:
    """``family, set, found``: the callable definitions of every ambiguous name in candidate order, once each."""
    return _named(defs).groupBy("family", "set").agg(F.sort_array(F.collect_list("found")).alias("found")).where(F.size("found") > 1)


def _apart(name: Column, *row: str) -> Column:
    """A join key that is never null: rows that look nothing up get one that no name has, and not all the same."""
    return F.coalesce(name, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))


def defines_edges(symbols: DataFrame) -> DataFrame:
    """Every definition is a resolved edge from its file."""
    return definitions(symbols).select(
        F.lit("defines").alias("kind"), F.col("path").alias("source_path"), F.lit(None).cast(SYMBOL).alias("source_symbol"), F.col("path").alias("target_path"),
        F.struct("path", "qualified_name", "role", F.col("range.start_byte").alias("start_byte")).cast(SYMBOL).alias("target_symbol"), F.col("qualified_name").alias("target_text"),
        F.lit("resolved").alias("resolution"), F.lit("high").alias("confidence"), F.lit("tree-sitter-definition").alias("provenance"), F.lit(0).alias("candidate_count"),
        F.col("range").cast(RANGE).alias("evidence"), F.lit(None).cast(CANDIDATES).alias("candidates"),
    )


def call_matches(calls: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """Each call with its first matching tier: ``family, n`` (candidates), ``one`` (the first), ``set`` (the key of all,
    if there are several; a key that no set has otherwise), ``confidence, method``.
    """
    c = calls.join(files.select("path", s.language_family(F.col("language")).alias("family")), "path")
    c = c.withColumn("_key", F.struct("path", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b"), "callee_text", "caller_qualified_name", "caller_start_byte"))
    c = c.dropDuplicates(["_key"])
    stripped = s.strip_template_arguments(F.col("callee_text"))
    none = F.array().cast("array<string>")
    names = F.when(F.col("form") == "qualified", F.concat(F.array(stripped), s.scope_candidates(F.col("caller_qualified_name"), stripped))).when(F.col("form") == "unqualified", s.scope_candidates(F.col("caller_qualified_name"), F.col("callee_name"))).otherwise(none)
    # how many definitions a name has, and the first
    known = _named(defs).groupBy("family", "set").agg(F.count("*").alias("n"), F.min("found").alias("one"))
    probes = c.select("_key", "family", F.posexplode(F.transform(names, _full)).alias("tier", "set"))
    hits = probes.join(known, ["family", "set"])
    first = hits.groupBy("_key").agg(F.min_by(F.struct("tier", "set", "n", "one"), "tier").alias("hit"))
    c = c.join(first, "_key", "left")
    short = known.select("family", F.col("set").alias("_name"), F.struct("n", "one").alias("by_name"))
    # calls that a tier settled, and indirect ones, look nothing up
    open_name = F.when(F.col("hit").isNull() & (F.col("form") != "indirect"), _short(F.col("callee_name")))
    c = c.withColumn("_name", _apart(open_name, "_key")).join(short, ["family", "_name"], "left")
    tier, member = F.col("hit.tier"), F.col("form") == "member"
    method = (
        F.when((F.col("form") == "qualified") & (tier == 0), "qualified-name-match").when((F.col("form") == "qualified") & (tier > 0), "scoped-qualified-match").when(tier.isNotNull(), "lexical-scope-match")
        .when(F.col("by_name").isNotNull() & member, "member-name-match").when(F.col("by_name").isNotNull(), "repository-name-match").otherwise("no-match")
    )
    confidence = F.when(tier.isNotNull(), "high").when(F.col("by_name").isNotNull() & ~member, "medium").otherwise("low")
    n = F.coalesce("hit.n", "by_name.n", F.lit(0)).cast("int")
    several = F.when(n > 1, F.coalesce("hit.set", "_name"))
    return c.select(*calls.columns, "family", n.alias("n"), F.coalesce("hit.one", "by_name.one").alias("one"), _apart(several, "_key").alias("set"), confidence.alias("confidence"), method.alias("method"))


def _resolution(n: Column) -> Column:
    return F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")


def call_edges(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per call site."""
    defs = callables(symbols, files)
    m = call_matches(calls, defs, files)
    callers = definitions(symbols).select("path", F.col("qualified_name").alias("caller_qualified_name"), F.col("range.start_byte").alias("caller_start_byte"), F.lit(True).alias("_known")).distinct()
    m = m.join(callers, ["path", "caller_qualified_name", "caller_start_byte"], "left")
    m = m.join(candidate_sets(defs), ["family", "set"], "left")
    n, one = F.col("n"), F.col("one")
    target = lambda x: F.struct(x.path.alias("path"), x.qualified_name.alias("qualified_name"), F.lit("definition").alias("role"), x.start_byte.alias("start_byte"))
    listed = F.transform("found", lambda x, i: F.struct(F.lit(None).cast("string").alias("target_path"), target(x).alias("target_symbol"), F.lit(CALL_REASON).alias("reason"), (i + 1).alias("rank")))
    return m.select(
        F.lit("calls").alias("kind"), F.col("path").alias("source_path"),
        F.when(F.col("_known"), F.struct("path", F.col("caller_qualified_name").alias("qualified_name"), F.lit("definition").alias("role"), F.col("caller_start_byte").alias("start_byte"))).cast(SYMBOL).alias("source_symbol"),
        F.when(n == 1, one.path).alias("target_path"), F.when(n == 1, target(one)).cast(SYMBOL).alias("target_symbol"), F.col("callee_text").alias("target_text"), _resolution(n).alias("resolution"), "confidence",
        F.concat(F.lit("tree-sitter-call:"), "form", F.lit(":"), "method").alias("provenance"), F.when(n > 1, n).otherwise(0).alias("candidate_count"), F.col("range").cast(RANGE).alias("evidence"),
        F.when(n > 1, listed).cast(CANDIDATES).alias("candidates"),
    )


def suffix_index(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``suffix -> paths``: every file under each tail of its path, in path order; of ``wanted`` suffixes only, if given."""
    tails = files.select("path", F.explode(s.path_suffixes(F.col("path"))).alias("suffix"))
    if wanted is not None:
        tails = tails.join(wanted.select("suffix").distinct(), "suffix", "left_semi")
    return tails.groupBy("suffix").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def include_edges(includes: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per include or import."""
    inc = includes.join(files.select("path", "language"), "path").dropDuplicates(["path", "target", "range"])
    python = F.col("language") == "python"
    quoted = ~python & ~F.col("is_system")
    inc = inc.select("*", _apart(F.when(quoted, s.under(s.folder(F.col("path")), F.col("target"))), "path", "range").alias("_near"), _apart(F.when(quoted, s.normalized(F.col("target"))), "path", "range").alias("_root"), _apart(F.when(python, s.imported_module(F.col("path"), F.col("target"))), "path", "range").alias("_module"))
    asked = inc.where(quoted).select(F.col("_root").alias("suffix"))
    paths = files.select("path")
    inc = inc.join(paths.select(F.col("path").alias("_near"), F.lit(True).alias("_by_near")), "_near", "left")
    inc = inc.join(paths.select(F.col("path").alias("_root"), F.lit(True).alias("_by_root")), "_root", "left")
    left = _apart(F.when(F.col("_by_near").isNull() & F.col("_by_root").isNull(), F.col("_root")), "path", "range")
    inc = inc.withColumn("suffix", left).join(suffix_index(files, asked), "suffix", "left")
    modules = files.where(python).groupBy(s.python_module(F.col("path")).alias("_module")).agg(F.sort_array(F.collect_list("path")).alias("_files"))
    inc = inc.join(modules, "_module", "left")
    found = F.when(F.col("_by_near"), F.array("_near")).when(F.col("_by_root"), F.array("_root")).when(python, F.col("_files")).otherwise(F.col("paths"))
    inc = inc.withColumn("found", found)
    n = F.coalesce(F.size("found"), F.lit(0))
    method = F.when(python & (n > 0), "python-import:module-match").when(python, "python-import:no-match").when(F.col("is_system"), "system-include").when(F.col("_by_near"), "relative-path-match").when(F.col("_by_root"), "repository-root-match").otherwise("path-suffix-match")
    confidence = F.when(n != 1, "low").when(python | F.col("_by_near") | F.col("_by_root"), "high").otherwise("medium")
    listed = F.transform("found", lambda p, i: F.struct(p.alias("target_path"), F.lit(None).cast(SYMBOL).alias("target_symbol"), F.when(python, IMPORT_REASON).otherwise(INCLUDE_REASON).alias("reason"), (i + 1).alias("rank")))
    return inc.select(
        F.lit("includes").alias("kind"), F.col("path").alias("source_path"), F.lit(None).cast(SYMBOL).alias("source_symbol"), F.when(n == 1, F.element_at("found", 1)).alias("target_path"), F.lit(None).cast(SYMBOL).alias("target_symbol"),
        F.col("target").alias("target_text"), _resolution(n).alias("resolution"), confidence.alias("confidence"), method.alias("provenance"), F.when(n > 1, n).otherwise(0).alias("candidate_count"), F.col("range").cast(RANGE).alias("evidence"),
        F.when(n > 1, listed).cast(CANDIDATES).alias("candidates"),
    )


def relationships(files: DataFrame, symbols: DataFrame, calls: DataFrame, includes: DataFrame) -> DataFrame:
    """All edges of a repository."""
    return defines_edges(symbols).unionByName(call_edges(calls, symbols, files)).unionByName(include_edges(includes, files))


def edge_order() -> list[Column]:
    """Order of edges: source, place, kind, text; then the end of the place and provenance, so that no tie is left open."""
    return [F.col("source_path"), F.col("evidence.start_byte"), s.ordinal(F.col("kind"), s.RELATIONSHIP_KINDS), F.col("target_text"), F.col("evidence.end_byte"), F.col("provenance")]


def resolution_counts(edges: DataFrame) -> DataFrame:
    """One row: how many edges there are, and of each resolution."""
    return edges.agg(F.count("*").alias("relationships"), *[F.count_if(F.col("resolution") == r).alias(r) for r in s.RESOLUTIONS])
