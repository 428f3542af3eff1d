"""Helpers shared by the training-data operators: shared folders, materialised tables, token arrays."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; also what bytes.split() and Arrow's ASCII split use.
WHITE = " \t\n\x0b\x0c\r"

#: Paths handed out by new_path().
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only if unset (local mode)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, shared_dir.own, True)
    return f"file://{shared_dir.own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; clear() deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has written, once no result reads them any more."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, MADE):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    MADE.clear()


#: Spark's settings while a table is written: a query's shuffle files go when it has ended, and the driver keeps no long
#: descriptions of plans.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "10000"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files behind it are deleted at once; the session's settings are as before afterwards.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in WRITING if spark.conf.isModifiable(k)}
    try:
        for k in before:
            spark.conf.set(k, WRITING[k])
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package (once per context) and keep Arrow batches small enough for long texts."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_ship.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("graphloom", os.path.relpath(full, root)))
        sc.addPyFile(out)
        sc._graphloom_shipped = out
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def tidy(run):
    """Wrap a generator over Arrow data: no collector while it runs (many small objects, no cycles), and at its end,
    also by an error, the collector as before and unused memory back to the system, as workers outlive tasks.
    """

    @functools.wraps(run)
    def inner(*given):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(*given)
        finally:
            if was:
                gc.enable()
            give_back()

    return inner


def give_back() -> None:
    """Hand memory that is free in this process back to the system, that of cycles as well."""
    gc.collect()
    trim()


def trim() -> None:
    """Hand memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def by_bytes(batches, column: int, most: int):
    """Slices of Arrow batches whose texts in ``column`` hold at most ``most`` bytes, or that are one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(large_string(b.column(column))).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds columns: of each (long) expression the sum over all rows before this one in a total order; of 1, the row's
    place from 0. Rows are range-partitioned, so that no task gets them all; the driver gets one row per partition.
    """
    spark = df.sparkSession
    laid = materialize(df.repartitionByRange(parts(spark), *order).withColumn("_range", F.spark_partition_id()), "ordered")
    ends = laid.groupBy("_range").agg(*[F.sum(x).alias(name) for name, x in sums.items()]).orderBy("_range").collect()
    before, rows = [0] * len(sums), []
    for r in ends:
        rows.append((r[0], *before))
        before = [a + (b or 0) for a, b in zip(before, r[1:], strict=True)]
    offsets = spark.createDataFrame(rows, "_range int, " + ", ".join(f"_o_{name} long" for name in sums))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = laid.withColumns({f"_s_{name}": F.coalesce(F.sum(x).over(earlier), F.lit(0)) for name, x in sums.items()}).join(F.broadcast(offsets), "_range")
    return got.select(*df.columns, *[(F.col(f"_s_{name}") + F.col(f"_o_{name}")).cast("long").alias(name) for name in sums])


def crc_mod(column: str, m: int):
    """crc32 of the id written as text, modulo m (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def large_string(column: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets, nulls as empty strings."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text (``[^\\x20\\x09-\\x0D]+``) as one flat array, and the text's index of each word."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        return flat.filter(full), doc[keep]
    return flat, doc


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a large_string array without nulls."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for combining hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batches, most: int):
    """Gather Arrow batches of (key, text) until their texts hold ``most`` bytes; yield key and text arrays."""
    keys, texts, held = [], [], 0
    for b in batches:
        t = large_string(b.column(1))
        for at in range(0, len(t), 16):  # a few very long texts do not pile up
            part = t.slice(at, 16)
            keys.append(b.column(0).slice(at, 16))
            texts.append(part)
            held += pc.sum(pc.binary_length(part)).as_py() or 0
            if held >= most:
                done, keys, texts, held = (pa.concat_arrays(keys), pa.concat_arrays(texts)), [], [], 0
                yield done
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)
