"""A deterministic lens that reads star-schema tables as code facts, so that the graph operators can be run and
compared at any scale: nations hold files, customers are symbols, orders are call sites, suppliers include.

The statements are plain SQL that Spark and DuckDB both run over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Distinct short names: grows with the customers, so that short names stay about equally ambiguous.
NAMES = "(SELECT greatest(97, CAST(floor(count(*) / 15) AS BIGINT)) AS m FROM customer)"

FILES_SQL = """
SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/' || lower(seg) || CASE WHEN n_regionkey = 4 THEN '.py' ELSE '.cpp' END AS path,
       CASE WHEN n_regionkey = 4 THEN 'python' ELSE 'cpp' END AS language
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) g
"""

SYMBOLS_SQL = f"""
SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/' || lower(c_mktsegment) || CASE WHEN n_regionkey = 4 THEN '.py' ELSE '.cpp' END AS path,
       CASE WHEN c_custkey % 10 = 9 THEN 'class' WHEN c_custkey % 10 = 8 THEN 'method' ELSE 'function' END AS kind,
       CASE WHEN c_custkey % 7 = 6 THEN 'declaration' ELSE 'definition' END AS role,
       'f' || CAST(c_custkey % m AS STRING) AS name,
       'r' || CAST(n_regionkey AS STRING) || '::n' || CAST(n_nationkey AS STRING) || '::f' || CAST(c_custkey % m AS STRING) AS qualified_name,
       'f' || CAST(c_custkey % m AS STRING) || '()' AS signature, CAST(c_custkey AS INT) AS start_byte
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN {NAMES} k
"""

CALLS_SQL = f"""
SELECT path, caller_qualified_name, caller_start_byte, CASE form WHEN 'qualified' THEN CASE k % 3 WHEN 0 THEN head || '::' || tail || '::' || callee_name WHEN 1 THEN tail || '::' || callee_name ELSE tail || '<int>::' || callee_name END
         WHEN 'member' THEN 'object.' || callee_name ELSE callee_name END AS callee_text, callee_name, form, CAST(k % 5 AS INT) AS argument_count, start_byte
FROM (
  SELECT s.path, s.qualified_name AS caller_qualified_name, s.start_byte AS caller_start_byte, o_orderkey AS k,
         CASE WHEN o_orderkey % 13 = 0 THEN 'g' ELSE 'f' END || CAST((o_orderkey * 7) % m AS STRING) AS callee_name,
         CASE o_orderkey % 4 WHEN 0 THEN 'unqualified' WHEN 1 THEN 'qualified' WHEN 2 THEN 'member' ELSE 'indirect' END AS form,
         CAST(o_orderkey AS INT) AS start_byte, split_part(s.qualified_name, '::', 1) AS head, split_part(s.qualified_name, '::', 2) AS tail
  FROM orders JOIN ({SYMBOLS_SQL}) s ON o_custkey = s.start_byte CROSS JOIN {NAMES} n WHERE s.role = 'definition' AND s.kind <> 'class'
) c
"""

INCLUDES_SQL = """
SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/' || seg || CASE WHEN n_regionkey = 4 THEN '.py' ELSE '.cpp' END AS path,
       CASE WHEN n_regionkey = 4 THEN CASE s_suppkey % 3 WHEN 0 THEN '.machinery' WHEN 1 THEN 'r4.n' || CAST(n_nationkey AS STRING) || '.' || seg ELSE 'external.library' END
            ELSE CASE s_suppkey % 6 WHEN 0 THEN 'vector' WHEN 1 THEN '../n' || CAST(n_nationkey AS STRING) || '/machinery.cpp' WHEN 2 THEN 'r' || CAST(n_regionkey AS STRING) || '/./n' || CAST(n_nationkey AS STRING) || '/' || seg || '.cpp'
                 WHEN 3 THEN 'n' || CAST(n_nationkey AS STRING) || '/household.cpp' WHEN 4 THEN seg || 's.hpp' ELSE CASE s_suppkey % 4 WHEN 1 THEN 'furniture.cpp' ELSE 'x/../building.cpp' END END END AS target,
       n_regionkey <> 4 AND s_suppkey % 6 = 0 AS is_system, CAST(s_suppkey AS INT) AS start_byte
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (VALUES (0, 'automobile'), (1, 'building'), (2, 'furniture'), (3, 'machinery'), (4, 'household')) g(i, seg) ON s_suppkey % 5 = i
"""

RANGE = "named_struct('start_line', start_byte + 1, 'start_column', 1, 'end_line', start_byte + 1, 'end_column', 6, 'start_byte', start_byte, 'end_byte', start_byte + 5)"


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``files, symbols, calls, includes`` of the lens over the tables in a folder."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "orders", "supplier")}
    names = {t: "{" + t + "}" for t in tables}

    def run(sql: str) -> DataFrame:
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {names[t]}").replace(f"JOIN {t} ", f"JOIN {names[t]} ")
        used = {t: df for t, df in tables.items() if names[t] in sql}
        return spark.sql(sql, **used)

    out = {"files": run(FILES_SQL)}
    for name, sql in (("symbols", SYMBOLS_SQL), ("calls", CALLS_SQL), ("includes", INCLUDES_SQL)):
        df = run(sql)
        out[name] = df.selectExpr(*[c for c in df.columns if c != "start_byte"], f"{RANGE} AS range")
    return out
