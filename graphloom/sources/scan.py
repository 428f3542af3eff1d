"""Repository scan: which files of a tree are sources, with language, size, fingerprint and content.

The driver lists the tree (names only); contents are read, hashed and analysed on executors from a path each,
so the tree must be on a file system that all of them mount. Spark's own file sources would drop names that
begin with ``_`` or ``.``, ``__init__.py`` among them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.shipping import ship

# Fixed values.
EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inc", ".py", ".pyi")
PRUNED = (".git", ".hg", ".svn", ".graphloom", "build", "out", "dist", "node_modules")
MAX_BYTES = 16 * 1024 * 1024
#: Files that one task reads, from which more tasks are made.
FILES_A_TASK = 2000


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def classify(paths: DataFrame) -> DataFrame:
    """Adds ``language, supported, pruned`` to ``path``: by extension, and whether a folder on the way is pruned."""
    e = extension(F.col("path"))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return paths.withColumns(
        {
            "language": F.when(e == ".c", "c").when(e.isin(".py", ".pyi"), "python").otherwise("cpp"),
            "supported": e.isin(*EXTENSIONS),
            "pruned": F.arrays_overlap(folders, F.array(*[F.lit(x) for x in PRUNED])),
        }
    )


def fnv_many(contents: list[bytes]) -> list[str]:
    """FNV-1a 64 of many byte strings at once, one byte position after the other."""
    order = sorted(range(len(contents)), key=lambda i: -len(contents[i]))
    lengths = np.array([len(contents[i]) for i in order])
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    prime = np.uint64(0x100000001B3)
    live, at = len(order), 0
    block = 4096
    while live and at < lengths[0]:
        live = int(np.searchsorted(-lengths, -at, side="left"))  # those longer than ``at``
        grid = np.zeros((live, block), np.uint8)
        for k in range(live):
            part = contents[order[k]][at : at + block]
            grid[k, : len(part)] = np.frombuffer(part, np.uint8)
        for i in range(min(block, int(lengths[0]) - at)):
            n = int(np.searchsorted(-lengths[:live], -(at + i), side="left"))
            h[:n] = (h[:n] ^ grid[:n, i]) * prime
        at += block
    out = [""] * len(order)
    for k, i in enumerate(order):
        out[i] = f"{int(h[k]):016x}"
    return out


def fingerprints(files: DataFrame) -> DataFrame:
    """``content`` replaced by ``content_fingerprint``."""
    ship(files.sparkSession)
    keep = [c for c in files.columns if c != "content"]
    schema = files.select(*keep).schema.add("content_fingerprint", "string")

    def run(batches):
        for b in batches:
            hashes = fnv_many([x or b"" for x in b.column(b.schema.get_field_index("content")).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(hashes, pa.string())], names=[*keep, "content_fingerprint"])

    return files.select(*keep, "content").mapInArrow(run, schema)


@dataclass
class Scan:
    root: str
    files: list[tuple[str, str, int]]  # path, language, size
    warnings: list[str] = field(default_factory=list)


def language_of(path: str) -> str | None:
    """Language of a supported source, None for other files."""
    e = os.path.splitext(path)[1].lower()
    if e not in EXTENSIONS:
        return None
    return "c" if e == ".c" else "python" if e in (".py", ".pyi") else "cpp"


def scan(root: str) -> Scan:
    """List the sources under a root, by relative path; what is skipped leaves a warning."""
    top = os.path.realpath(root)
    found: dict[str, tuple[str, int]] = {}
    warnings = []
    for folder, folders, names in os.walk(top):  # unreadable folders are passed over
        folders[:] = sorted(f for f in folders if f not in PRUNED)
        for name in names:
            full = os.path.join(folder, name)
            if language_of(name) is None or not os.path.isfile(full):
                continue
            real = os.path.realpath(full)
            if os.path.commonpath([top, real]) != top:
                warnings.append(f"skipped source outside repository: {full}")
                continue
            size = os.path.getsize(real)
            if size > MAX_BYTES:
                warnings.append(f"skipped source larger than 16 MiB: {full}")
                continue
            path = os.path.relpath(real, top).replace(os.sep, "/")
            if language_of(path) is not None:
                found[path] = (language_of(path), size)  # a link and its target are one file
    return Scan(top, sorted((p, *v) for p, v in found.items()), sorted(warnings))


def listed(spark: SparkSession, result: Scan) -> DataFrame:
    """``path, language, size_bytes`` of scanned files."""
    return spark.createDataFrame(result.files, "path string, language string, size_bytes long")


def read_contents(files: DataFrame, top: str, n: int) -> DataFrame:
    """Files (``path, language, size_bytes``, ``n`` of them) with ``content, content_fingerprint``, read on executors."""
    spark = files.sparkSession
    ship(spark)
    rows = files.select("path", "language", "size_bytes").repartition(max(spark.sparkContext.defaultParallelism, n // FILES_A_TASK))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                contents = []
                for path in part.column(0).to_pylist():
                    with open(os.path.join(top, path), "rb") as f:
                        contents.append(f.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary()), pa.array(fnv_many(contents), pa.string())], names=["path", "language", "size_bytes", "content", "content_fingerprint"])

    return rows.mapInArrow(run, "path string, language string, size_bytes long, content binary, content_fingerprint string")


def read_files(spark: SparkSession, result: Scan) -> DataFrame:
    """All scanned files with ``content, content_fingerprint``."""
    return read_contents(listed(spark, result), result.root, len(result.files))
