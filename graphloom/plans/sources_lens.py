"""Source files written from star-schema rows, so that extraction can be run and compared at any scale.

Every customer has a Python file, every supplier a C++ one and every part a malformed file of either kind. Each
file is a template whose only variable part, ``@``, is an eight-digit number; so all places in it are known
beforehand, and the facts expected of it are stated here as plain SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PYTHON = [
    "# é",
    "import os, m@ as other",
    "from .base import one, two",
    "from . import three",
    "class C@(Base):",
    "    def run(self, x:int) -> int:",
    "        return self.step(helper(x), y=1)",
    "async def f@(a,",
    "    b): other.go(a)",
]
CPP = [
    '#include "m@.hpp"',
    "#include <vector>",
    "namespace n@ {",
    "class Shape;",
    "int twice(int v), thrice(int v);",
    "namespace {",
    "int hidden() { return 1; }",
    "}",
    "int Shape::area(int s) const {",
    "  this->grow(s); geo::run<int>(s);",
    "  return twice(hidden());",
    "}",
    "}",
]
BROKEN = {".py": ["def ok@():", "    pass", "", "def broken@(:", "    pass"], ".cpp": ["int ok@() { return 1; }", "int broken@( {", "  return 0;", "}", "int more() { ) }"]}

#: Table, key, folder and template of the files.
FILES = {"python": ("customer", "c_custkey", "p", PYTHON), "cpp": ("supplier", "s_suppkey", "c", CPP)}


def place(lines: list[str], part: str) -> tuple[int, int, int]:
    """Line, column and byte (all of UTF-8 bytes) at which a part first stands in a template."""
    text = "".join(line.replace("@", "0" * 8) + "\n" for line in lines)
    at = text.index(part.replace("@", "0" * 8))
    before = text[:at].encode()
    return before.count(b"\n") + 1, len(before) - (before.rfind(b"\n") + 1) + 1, len(before)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, language, content, size_bytes`` of all files."""
    number = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")

    def of(df: DataFrame, key: str, folder: str, suffix: str, language: str, lines: list[str]) -> DataFrame:
        content = F.replace(F.lit("".join(x + "\n" for x in lines)), F.lit("@"), number(key))
        return df.select(F.concat(F.lit(f"{folder}/x"), number(key), F.lit(suffix)).alias("path"), F.lit(language).alias("language"), content.cast("binary").alias("content"))

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part = read("part")
    all_files = of(read("customer"), "c_custkey", "p", ".py", "python", PYTHON).unionByName(of(read("supplier"), "s_suppkey", "c", ".cpp", "cpp", CPP))
    for suffix, language in ((".py", "python"), (".cpp", "cpp")):
        all_files = all_files.unionByName(of(part, "p_partkey", "b", suffix, language, BROKEN[suffix]))
    return all_files.withColumn("size_bytes", F.octet_length("content").cast("long"))


def _rows(language: str, columns: str, rows: list[tuple]) -> str:
    """Expected rows of every file of a language: ``@`` in texts becomes the file's number, ``%`` its module."""
    table, key, folder, _ = FILES[language]
    suffix = ".py" if language == "python" else ".cpp"
    shown = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    names = [c.strip() for c in columns.split(",")]
    texts = {i for r in rows for i, v in enumerate(r) if isinstance(v, str)}
    number = f"lpad(CAST({key} AS VARCHAR), 8, '0')"
    show = ", ".join(f"replace(replace({c}, '@', {number}), '%', '{folder}.x' || {number}) AS {c}" if i in texts else f"CAST({c} AS BIGINT) AS {c}" for i, c in enumerate(names))
    return f"SELECT '{folder}/x' || {number} || '{suffix}' AS path, {show} FROM {table}, (VALUES {shown}) v({columns})"


def _py(part: str) -> tuple[int, int, int]:
    return place(PYTHON, part)


def _cc(part: str) -> tuple[int, int, int]:
    return place(CPP, part)


SYMBOLS_SQL = " UNION ALL ".join(
    [
        _rows(
            "python",
            "kind, role, name, qualified_name, signature, start_line, start_column, start_byte",
            [
                ("class", "definition", "C@", "%::C@", "C@(Base)", *_py("class C@")),
                ("method", "definition", "run", "%::C@::run", "run(self, x:int) -> int", *_py("def run")),
                ("function", "definition", "f@", "%::f@", "async f@(a, b)", *_py("async def")),
            ],
        ),
        _rows(
            "cpp",
            "kind, role, name, qualified_name, signature, start_line, start_column, start_byte",
            [
                ("class", "declaration", "Shape", "n@::Shape", "", *_cc("class Shape")),
                ("function", "declaration", "twice", "n@::twice", "twice(int v)", *_cc("int twice")),
                ("function", "declaration", "thrice", "n@::thrice", "thrice(int v)", *_cc("int twice")),
                ("function", "definition", "hidden", "n@::(anonymous)::hidden", "hidden()", *_cc("int hidden")),
                ("method", "definition", "area", "n@::Shape::area", "Shape::area(int s) const", *_cc("int Shape")),
            ],
        ),
    ]
)
INCLUDES_SQL = " UNION ALL ".join(
    [
        _rows("python", "target, system, start_line, start_column, start_byte", [("os", 0, *_py("import os")), ("m@", 0, *_py("import os")), (".base", 0, *_py("from .base")), (".three", 0, *_py("from . import"))]),
        _rows("cpp", "target, system, start_line, start_column, start_byte", [("m@.hpp", 0, *_cc("#include \"")), ("vector", 1, *_cc("#include <"))]),
    ]
)
CALLS_SQL = " UNION ALL ".join(
    [
        _rows(
            "python",
            "caller, callee_text, callee_name, form, arguments, start_line, start_column, start_byte",
            [
                ("%::C@::run", "step", "step", "unqualified", 2, *_py("self.step")),
                ("%::C@::run", "helper", "helper", "unqualified", 1, *_py("helper(x)")),
                ("%::f@", "other.go", "go", "member", 1, *_py("other.go")),
            ],
        ),
        _rows(
            "cpp",
            "caller, callee_text, callee_name, form, arguments, start_line, start_column, start_byte",
            [
                ("n@::Shape::area", "this->grow", "grow", "member", 1, *_cc("this->grow")),
                ("n@::Shape::area", "geo::run<int>", "run", "qualified", 1, *_cc("geo::run")),
                ("n@::Shape::area", "twice", "twice", "unqualified", 1, *_cc("twice(hidden")),
                ("n@::Shape::area", "hidden", "hidden", "unqualified", 0, *_cc("hidden());")),
            ],
        ),
    ]
)


def _broken(suffix: str, rows: list[tuple[str, str, int]]) -> str:
    shown = ", ".join(f"('{code}', '{message}', {line})" for code, message, line in rows)
    return f"SELECT 'b/x' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '{suffix}' AS path, 'parsed_with_errors' AS parse_status, code, message, CAST(line AS BIGINT) AS start_line FROM part, (VALUES {shown}) v(code, message, line)"


DIAGNOSTICS_SQL = " UNION ALL ".join(
    [
        _broken(".py", [("syntax-error", "unrecognized syntax", 4)]),
        _broken(".cpp", [("missing-syntax", "parser expected )", 2), ("syntax-error", "unrecognized syntax", 5)]),
        *[f"SELECT '{folder}/x' || lpad(CAST({key} AS VARCHAR), 8, '0') || '{suffix}', 'parsed', NULL, NULL, NULL FROM {table}" for (table, key, folder, _), suffix in zip(FILES.values(), (".py", ".cpp"), strict=True)],
    ]
)
