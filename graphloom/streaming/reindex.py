"""Extension: re-index a tree as changes arrive on a stream, one snapshot per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.plans.indexing import IndexResult, index


def follow(changes: DataFrame, repository: str, checkpoint: str, store_root: str | None = None, on_result: Callable[[int, IndexResult], None] | None = None):
    """Start a query that indexes ``repository`` once per micro-batch with rows in it.

    Indexing is incremental and publishes atomically, so a batch that runs again after a failure does no harm.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            result = index(batch.sparkSession, repository, store_root)
            if on_result:
                on_result(number, result)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
