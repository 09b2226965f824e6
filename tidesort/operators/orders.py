"""Ordering relations: lists of sort columns that can be reversed and completed to a total order."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesort.operators.keys import ILLUMINA_KEY, LENGTH_KEY, LONG_READ_KEY, NAME_KEY, PAIRED_END_KEY, ColumnLike, KeyKind, length_of, packed_kind, resolve


@dataclass(frozen=True)
class Order:
    """Keys from most to least significant.  ``reversed()`` turns every key around; twice is the order itself.

    ``leading`` names the columns of the first key where equal values stand together in this order.
    ``key`` is the compact key that goes with the order; it is a description, the exact keys decide.
    """

    keys: tuple[ColumnLike, ...]
    descending: bool = False
    leading: tuple[str, ...] = ()
    key: KeyKind | None = None

    def reversed(self) -> Order:
        return replace(self, descending=not self.descending)

    def unkeyed(self) -> Order:
        return replace(self, key=None)

    def parts(self, df: DataFrame) -> tuple[list[Column], list[Column]]:
        """The keys, and the remaining columns of ``df`` that complete them to a total order."""
        named = {k for k in self.keys if isinstance(k, str)}
        return [resolve(k, df) for k in self.keys], [F.col(f"`{c}`") for c, kind in df.dtypes if c not in named and not kind.startswith("map")]

    def columns(self, df: DataFrame) -> list[Column]:
        """Sort columns, the remaining columns of ``df`` last, so that only equal rows are tied."""
        own, rest = self.parts(df)
        return [c.desc() if self.descending else c.asc() for c in own] + [c.asc() for c in rest]

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` with an error on a null key: keys are values, and nulls have no place in the order."""
        bad = functools.reduce(lambda a, b: a | b, (resolve(k, df).isNull() for k in self.keys))
        first = df.columns[0]
        return df.withColumn(first, F.when(bad, F.raise_error(F.lit("a sort key is null"))).otherwise(F.col(f"`{first}`")))

    # predicates of the relation, for pairs of columns
    def lt(self, a: Column, b: Column) -> Column:
        return a > b if self.descending else a < b

    def le(self, a: Column, b: Column) -> Column:
        return a >= b if self.descending else a <= b

    def gt(self, a: Column, b: Column) -> Column:
        return self.lt(b, a)

    def ge(self, a: Column, b: Column) -> Column:
        return self.le(b, a)

    def eq(self, a: Column, b: Column) -> Column:
        return a == b

    def max(self, a: Column, b: Column) -> Column:
        """``a`` on ties."""
        return F.when(self.ge(a, b), a).otherwise(b)

    def min(self, a: Column, b: Column) -> Column:
        """``a`` on ties."""
        return F.when(self.le(a, b), a).otherwise(b)


def natural(*keys: ColumnLike) -> Order:
    return Order(tuple(keys), leading=tuple(k for k in keys[:1] if isinstance(k, str)))


def via(*columns: str, target: str = "binary") -> Order:
    """Compares columns through a common type."""
    return Order(tuple(lambda df, c=c: F.col(c).cast(target) for c in columns))


def normalized(rule: Callable[[Column], Column], *columns: str) -> Order:
    """Compares a normal form, such as ``F.lower``; values of one normal form are ordered by the value itself."""
    return Order(tuple(lambda df, c=c: rule(F.col(c)) for c in columns))


def sequence_order(width: int | None = None) -> Order:
    """Sequence, then quality, by bytes."""
    return Order(("sequence", "quality"), leading=("sequence", "quality"), key=packed_kind(width) if width else None)


ILLUMINA_ORDER = replace(sequence_order(), key=ILLUMINA_KEY)
PAIRED_END_ORDER = replace(sequence_order(), key=PAIRED_END_KEY)
LONG_READ_ORDER = replace(sequence_order(), key=LONG_READ_KEY)
UNKEYED_SEQUENCE_ORDER = sequence_order()
NAME_ORDER = Order(("name",), leading=("name",), key=NAME_KEY)
LENGTH_ORDER = Order((lambda df: length_of("sequence"),), key=LENGTH_KEY)


class Comparable:
    """A value ordered by a Python comparator ``compare(a, b) -> int``; picklable when the comparator is importable."""

    __slots__ = ("compare", "value")

    def __init__(self, value: object, compare: Callable[[object, object], int]):
        self.value, self.compare = value, compare

    def __lt__(self, other: Comparable) -> bool:
        return self.compare(self.value, other.value) < 0

    def __gt__(self, other: Comparable) -> bool:
        return self.compare(self.value, other.value) > 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Comparable) and self.compare(self.value, other.value) == 0

    def __hash__(self) -> int:
        return 0

    def __reduce__(self) -> tuple:
        return Comparable, (self.value, self.compare)


def sort_by_comparator(df: DataFrame, columns: Sequence[str], compare: Callable[[tuple, tuple], int], partitions: int | None = None) -> DataFrame:
    """Orders by an arbitrary comparator over tuples of ``columns``; ties keep no order.

    Catalyst can't express such an order, so rows go through Python.  Use :func:`normalized` wherever the comparator has a
    normal form.
    """
    places = [df.columns.index(c) for c in columns]
    rows = df.rdd.sortBy(lambda r: Comparable(tuple(r[i] for i in places), compare), numPartitions=partitions)
    return df.sparkSession.createDataFrame(rows, df.schema)
