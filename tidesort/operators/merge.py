"""Ordered union of sorted inputs.

The inputs' own order is not relied on: rows are dealt by range and sorted once, and results stay right when an input
is not sorted after all.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidesort.operators.dedup import IDENTITY, Dedup, ordered_distinct
from tidesort.operators.orders import Order
from tidesort.operators.position import some_of


def union_all(runs: Sequence[DataFrame]) -> DataFrame:
    """All rows, duplicates included; the runs need one schema."""
    if not runs:
        raise ValueError("no run has no schema: see nothing()")
    return functools.reduce(DataFrame.unionByName, runs)


def _some(runs: Sequence[DataFrame], share: float) -> DataFrame:
    """Sampled before the union, so that no column is made for rows that are not in the sample."""
    return union_all([some_of(r, share) for r in runs])


def nothing(schema: StructType | str | None, pos: str | None) -> DataFrame:
    """What merging no run gives: no row, with the columns of ``schema`` (none if it is not given) and the position."""
    empty = SparkSession.active().createDataFrame([], schema or StructType([]))
    return empty.withColumn(pos, F.lit(0).cast("long")) if pos else empty


def merge_sorted(runs: Sequence[DataFrame], order: Order, dedup: Dedup = IDENTITY, pos: str | None = "pos", schema: StructType | str | None = None) -> DataFrame:
    """``schema`` counts where there is no run."""
    if not runs:
        return nothing(schema, pos)
    return ordered_distinct(union_all(runs), order, dedup, pos, some=lambda share: _some(runs, share))


def merge_keyed(runs: Sequence[DataFrame], key: Column, order: Order, name: str = "key", pos: str | None = "pos", schema: StructType | str | None = None) -> DataFrame:
    """Merges by a compact key first and by the exact order where keys tie; the key stays as column ``name``."""
    if not runs:
        return nothing(schema, pos)
    coarse = Order((name, *order.keys), order.descending)
    return ordered_distinct(union_all(runs).withColumn(name, key), coarse, IDENTITY, pos, some=lambda share: _some(runs, share).withColumn(name, key))

