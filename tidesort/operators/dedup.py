"""Dropping duplicates of an ordered data set.

Where equal keys stand together in the order, keeping the first of each run is keeping the first row of each key.  Rows are
dealt into ranges by the key, so that a run lies in one partition; each task drops most of the repeated keys of a chunk before
it sends the rows, so a hot key is no hot partition.  Keys of types that have no bounds are planned as ``row_number() = 1``.
Other keys need the order: runs are compared row by row over range partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidesort.operators.orders import Order
from tidesort.operators.position import Some, first_of_runs_within, fixed, has_bounds, in_chunks, keep_first_of_runs, numbered, ranged, unpacked


@dataclass(frozen=True)
class Dedup:
    """``columns``: rows are equal when these are.  ``predicate``: or when it says so of (last kept row, row)."""

    columns: tuple[str, ...] = ()
    predicate: Callable[[dict, dict], bool] | None = None


IDENTITY = Dedup()
BY_NAME = Dedup(("name",))
BY_SEQUENCE = Dedup(("sequence",))
BY_SEQUENCE_AND_QUALITY = Dedup(("sequence", "quality"))


def is_global(order: Order, dedup: Dedup) -> bool:
    """Whether equal keys are neighbours in this order: the key is a leading part of the order's columns."""
    n = len(dedup.columns)
    return bool(n) and dedup.predicate is None and set(order.leading[:n]) == set(dedup.columns)


def first_of_key(df: DataFrame, order: Order, columns: tuple[str, ...]) -> DataFrame:
    """The row of each key that comes first in ``order``; no global sort."""
    rank = "__rank"
    ranked = Window.partitionBy(*(F.col(f"`{c}`") for c in columns)).orderBy(*order.columns(df))
    return df.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) == 1).drop(rank)


def fold(fixed_df: DataFrame, equal: Callable[[dict, dict], bool]) -> DataFrame:
    """Keeps a row unless ``equal(last kept row, row)``.

    What is kept depends on all rows before, so this is one task; it sorts packed chunks of rows by partition and
    place (sorted runs that spill to disk), unpacks one after the other and holds one row.  It is for predicates that are no equivalence; for keys use columns.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict | None = None
        for frame in frames:
            keep = []
            for row in frame.to_dict("records"):
                new = last is None or not equal(last, row)
                keep.append(new)
                if new:
                    last = row
            yield frame[pd.Series(keep, index=frame.index, dtype=bool)]

    at = "__at"
    in_order = in_chunks(fixed_df).withColumn(at, F.monotonically_increasing_id()).repartition(1).sortWithinPartitions(at).drop(at)
    return unpacked(in_order, fixed_df.schema).mapInPandas(run, fixed_df.schema)


def reduce_by_key(df: DataFrame, keys: list[Column | str], *aggregates: Column) -> DataFrame:
    """A reduction in place of a choice: one row a key, combined before the shuffle."""
    return df.groupBy(*keys).agg(*aggregates)


def ordered_distinct(df: DataFrame, order: Order, dedup: Dedup = IDENTITY, pos: str | None = "pos", partitions: int | None = None, some: Some | None = None) -> DataFrame:
    """``df`` in ``order`` without duplicates; with ``pos``, each kept row's position.  ``some``: see :func:`ranged`."""
    if is_global(order, dedup):
        columns, dedup = dedup.columns, IDENTITY
        if has_bounds(df, order, len(columns)):
            rows = first_of_runs_within(ranged(df, order, partitions, columns, some), columns)
        else:
            rows = ranged(first_of_key(df, order, columns), order, partitions)
    else:
        rows = ranged(df, order, partitions, some=some)
    if dedup == IDENTITY and pos is None:
        return rows
    rows = fixed(rows)
    if dedup.predicate is not None:
        rows = fixed(fold(rows, dedup.predicate))
    elif dedup.columns:
        rows = keep_first_of_runs(rows, list(dedup.columns))
    return numbered(rows, pos) if pos else rows
