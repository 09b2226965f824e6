"""Ordered micro-batches: a global order over an unbounded stream does not exist, over each batch it does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidesort.plans.spec import SortSpec


def sorted_batches(stream: DataFrame, spec: SortSpec, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands every micro-batch, ordered and without duplicates, to ``sink(rows, batch id)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(spec.run(batch, pos=None), batch_id)

    return stream.writeStream.foreachBatch(each)
