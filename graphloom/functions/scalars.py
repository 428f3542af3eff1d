"""Scalar functions over names, paths and bytes, as column expressions (and plain Python where drivers need them)."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of each enumeration, which sorts use instead of the alphabet.
RELATIONSHIP_KINDS = ("defines", "calls", "includes")
RESOLUTIONS = ("resolved", "ambiguous", "unresolved")
CONFIDENCES = ("high", "medium", "low")
SYMBOL_KINDS = ("function", "method", "class", "struct")
SYMBOL_ROLES = ("declaration", "definition")
CALL_FORMS = ("unqualified", "qualified", "member", "indirect")
NODE_KINDS = ("file", "symbol")
PATH_STATUSES = ("confirmed", "possible", "not_found")
SEVERITIES = ("warning", "error")
PARSE_STATUSES = ("not_parsed", "parsed", "parsed_with_errors", "failed")

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def ordinal(column: Column, values: tuple[str, ...]) -> Column:
    """Place of an enumeration value, from 1; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0))


def checked(column: Column, values: tuple[str, ...], name: str) -> Column:
    """The value, or an error for one that the enumeration lacks."""
    return F.when(column.isNull() | column.isin(*values), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name}: "), column)))


def fnv1a(data: bytes) -> str:
    """FNV-1a 64 as 16 hex digits."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def normalize_space(text: str) -> str:
    """Runs of white space become one blank, but none before , ) ] nor after ( [ : and none at the ends."""
    text = re.sub(r"[ \t\n\v\f\r]+", " ", text).strip(" ")
    return re.sub(r"(?<=[(\[:]) | (?=[,)\]])", "", text)


def scopes_joined(scopes: list[str], name: str) -> str:
    return "::".join([*scopes, *([name] if name else [])])


def unqualified_name(name: Column) -> Column:
    """What follows the last ``::``."""
    return F.substring_index(name, "::", -1)


def before_template(name: Column) -> Column:
    """What precedes the first ``<``."""
    return F.substring_index(name, "<", 1)


def strip_template_arguments(text: Column) -> Column:
    """Text outside ``<...>``, without a leading ``::``; an unclosed ``<`` drops the rest."""
    # a closing bracket counts only inside an open one; texts without an opening one keep everything
    state = lambda d, o: F.struct(d.alias("d"), o.alias("o"))
    walked = F.aggregate(
        F.split(text, ""),
        state(F.lit(0), F.lit("")),
        lambda a, c: F.when(c == "<", state(a.d + 1, a.o)).when((c == ">") & (a.d > 0), state(a.d - 1, a.o)).when(a.d == 0, state(a.d, F.concat(a.o, c))).otherwise(a),
        lambda a: a.o,
    )
    return F.regexp_replace(F.when(F.instr(text, "<") == 0, text).otherwise(walked), r"^::", "")


def scope_candidates(caller: Column, callee: Column) -> Column:
    """Names that a callee may have as seen from its caller, the innermost scope first, the bare name last."""
    parts = F.split(caller, "::")
    depth = F.size(parts) - 1
    inner = F.transform(F.when(depth > 0, F.sequence(depth, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws("::", F.slice(parts, 1, i), F.array(callee)))
    return F.concat(inner, F.array(callee))


def language_family(language: Column) -> Column:
    return F.when(language == "python", "python").otherwise("c-family")


def folder(path: Column) -> Column:
    """Parent directory, empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def normalized(path: Column) -> Column:
    """Lexical normal form: no empty or ``.`` parts, ``..`` folded with the part before it; ``.`` if nothing is left."""
    absolute = path.startswith("/")
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "") | (p == "."), a)
        .when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.element_at(a, -1), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .when((p == "..") & absolute, a)
        .otherwise(F.concat(a, F.array(p))),
    )
    joined = F.array_join(parts, "/")
    return F.when(path == "", "").when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def under(directory: Column, path: Column) -> Column:
    """Path seen from a directory, in normal form; an absolute path stays as it is."""
    return normalized(F.when(path.startswith("/") | (directory == ""), path).otherwise(F.concat(directory, F.lit("/"), path)))


def path_suffixes(path: Column) -> Column:
    """The path and every tail of it that begins after a ``/``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))


def python_module(path: Column) -> Column:
    """Dotted module of a source path; a package's ``__init__`` is the package."""
    dotted = F.translate(F.regexp_replace(path, r"\.[^.]*$", ""), "/", ".")
    return F.when(dotted == "__init__", "").otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))


def imported_module(path: Column, target: Column) -> Column:
    """Absolute module of an import in the file at ``path``; leading dots climb from its package."""
    level = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.substr(target, level + 1)
    own = F.filter(F.split(python_module(path), r"\."), lambda p: p != "")
    is_package = path.rlike(r"(^|/)__init__\.pyi?$")
    keep = F.greatest(F.size(own) - F.when(is_package, level - 1).otherwise(level), F.lit(0))
    return F.when(level == 0, target).otherwise(F.concat_ws(".", F.slice(own, 1, keep), F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))))


def component(text: Column) -> Column:
    """Text with its length in bytes in front."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def posix_normal(path: str) -> str:
    """Lexical normal form of a path on the driver, without a leading ``./``."""
    path = posixpath.normpath(path.replace("\\", "/"))
    return path[2:] if path.startswith("./") else path
