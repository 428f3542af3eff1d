"""Giving executors this package, as their Python workers import it by name."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", None) is not None:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_ship.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("graphloom", os.path.relpath(full, root)))
    sc.addPyFile(out)  # served by the driver
    sc._graphloom_shipped = out
