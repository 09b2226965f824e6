"""The declarative builder: what to order by, what to keep, where the rows go.

Every step returns a new specification.  Settings that steer memory, spilling or in-memory algorithms elsewhere are
accepted, checked and kept as hints: Spark decides those itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import StructType

from tidesort.functions.transforms import Format, UserFormat
from tidesort.operators import orders
from tidesort.operators.dedup import BY_NAME, BY_SEQUENCE, BY_SEQUENCE_AND_QUALITY, IDENTITY, Dedup, is_global, ordered_distinct
from tidesort.operators.keys import ILLUMINA_KEY, LONG_READ_KEY, PAIRED_END_KEY, ColumnLike, KeyKind
from tidesort.operators.merge import nothing, union_all
from tidesort.operators.orders import Order
from tidesort.operators.position import fixed, keep_first_of_runs, numbered, ranged
from tidesort.sources import sinks


@dataclass(frozen=True)
class MergeConfig:
    max_fan_in: int = 128
    read_buffer_bytes: int = 64 * 1024
    write_buffer_bytes: int = 64 * 1024
    temp_dir: str | None = None

    def __post_init__(self) -> None:
        if self.max_fan_in < 2:
            raise ValueError("a merge needs a fan-in of at least 2")


@dataclass(frozen=True)
class SortSpec:
    order: Order | None = None
    dedup: Dedup = IDENTITY
    format: Format | UserFormat = Format()
    keyer: tuple[KeyKind, str] | None = None
    custom: Callable[[DataFrame], DataFrame] | None = None
    strict: bool = True
    hints: dict[str, Any] = field(default_factory=dict)

    # -- order
    def sort_by(self, order: Order) -> SortSpec:
        return replace(self, order=order)

    def sort_by_unkeyed(self, order: Order) -> SortSpec:
        return self.sort_by(order.unkeyed())

    def key(self, *keys: ColumnLike) -> SortSpec:
        return self.sort_by(orders.natural(*keys))

    def compare_reversed(self) -> SortSpec:
        return self.sort_by(self._order().reversed())

    def sort_by_illumina(self) -> SortSpec:
        return self.sort_by(orders.ILLUMINA_ORDER).hint(chunk_sort="radix")

    def sort_by_paired_end(self) -> SortSpec:
        return self.sort_by(orders.PAIRED_END_ORDER).hint(chunk_sort="radix")

    def sort_by_long_read(self) -> SortSpec:
        return self.sort_by(orders.LONG_READ_ORDER).hint(chunk_sort="radix")

    def sort_by_name(self) -> SortSpec:
        return self.sort_by(orders.NAME_ORDER)

    def sort_by_length(self) -> SortSpec:
        return self.sort_by(orders.LENGTH_ORDER)

    # -- duplicates; the last call counts
    def dedup_by_name(self) -> SortSpec:
        return replace(self, dedup=BY_NAME)

    def dedup_by_sequence(self) -> SortSpec:
        return replace(self, dedup=BY_SEQUENCE)

    def dedup_by_sequence_and_quality(self) -> SortSpec:
        return replace(self, dedup=BY_SEQUENCE_AND_QUALITY)

    def dedup_by(self, *columns: str) -> SortSpec:
        return replace(self, dedup=Dedup(columns))

    def dedup_when(self, equal: Callable[[dict, dict], bool]) -> SortSpec:
        return replace(self, dedup=Dedup(predicate=equal))

    def dedup_with(self, transform: Callable[[DataFrame], DataFrame]) -> SortSpec:
        """Any function of the ordered, numbered rows."""
        return replace(self, custom=transform)

    # -- values
    def codec(self, fmt: Format | UserFormat) -> SortSpec:
        return replace(self, format=fmt)

    def with_record_keyer(self, kind: KeyKind, name: str = "key") -> SortSpec:
        """The derived key of each row that comes out, with its tag, as column ``name``."""
        return replace(self, keyer=(kind, name))

    def with_illumina_key(self, name: str = "key") -> SortSpec:
        return self.with_record_keyer(ILLUMINA_KEY, name)

    def with_paired_end_key(self, name: str = "key") -> SortSpec:
        return self.with_record_keyer(PAIRED_END_KEY, name)

    def with_long_read_key(self, name: str = "key") -> SortSpec:
        return self.with_record_keyer(LONG_READ_KEY, name)

    def lossy_n(self) -> SortSpec:
        return replace(self, format=replace(self.format, sequence="lossy_n"))

    def two_bit_exact(self) -> SortSpec:
        return replace(self, format=replace(self.format, sequence="exact"))

    def binned_quality(self) -> SortSpec:
        return replace(self, format=replace(self.format, quality="binned"))

    def omit_quality(self) -> SortSpec:
        return replace(self, format=replace(self.format, quality="omit"))

    def split_names(self) -> SortSpec:
        return replace(self, format=replace(self.format, name="split"))

    def omit_names(self) -> SortSpec:
        return replace(self, format=replace(self.format, name="omit"))

    def with_block_records(self, n: int) -> SortSpec:
        return replace(self, format=replace(self.format, block_records=n))

    # -- hints
    def hint(self, **values: Any) -> SortSpec:
        return replace(self, hints=self.hints | values)

    def memory_budget(self, n: int) -> SortSpec:
        return self._positive("memory_budget", n)

    def measured_budget(self, n: int) -> SortSpec:
        return self._positive("measured_budget", n)

    def fixed_size_budget(self, n: int) -> SortSpec:
        return self._positive("fixed_size_budget", n)

    def max_buffer_items(self, n: int) -> SortSpec:
        return self._positive("max_buffer_items", n)

    def merge_config(self, config: MergeConfig) -> SortSpec:
        return self.hint(merge_config=config)

    def chunk_sort(self, name: str) -> SortSpec:
        return self.hint(chunk_sort=name)

    def sort_with_sequential(self) -> SortSpec:
        return self.chunk_sort("sequential")

    def sort_with_parallel(self) -> SortSpec:
        return self.chunk_sort("parallel")

    def arena(self) -> SortSpec:
        return self.hint(arena=True)

    def _positive(self, name: str, n: int) -> SortSpec:
        if n <= 0:
            raise ValueError(f"{name} must be positive")
        return self.hint(**{name: n})

    def _order(self) -> Order:
        if self.order is None:
            raise ValueError("an order is missing: call sort_by, key or one of the ready-made orders")
        return self.order

    # -- results
    def key_column(self) -> KeyKind | None:
        return self._order().key

    def run(self, df: DataFrame, pos: str | None = "pos") -> DataFrame:
        """Orders raw values, then applies the format, then drops duplicates of the formatted values."""
        order = self._order()
        df = order.checked(df) if self.strict else df
        if self.format.plain:
            out = self.format.apply(ordered_distinct(df, order, self.dedup, pos))
        elif self.dedup == IDENTITY:
            out = self.format.apply(numbered(fixed(ranged(df, order)), pos) if pos else ranged(df, order))
        elif self.dedup.predicate is not None:
            raise ValueError("a predicate and a lossy format can't be combined; pass the formatted rows in")
        else:
            rows = keep_first_of_runs(fixed(self.format.apply(ranged(df, order))), list(self.dedup.columns))
            out = numbered(rows, pos) if pos else rows
        if self.keyer:
            out = self.keyer[0].attach(out, self.keyer[1])
        return self.custom(out) if self.custom else out

    def merge(self, runs: Sequence[DataFrame], pos: str | None = "pos", schema: StructType | str | None = None) -> DataFrame:
        """``schema`` counts where there is no run."""
        return self.run(union_all(runs), pos) if runs else nothing(schema, pos)

    def plan(self) -> str:
        """Which plan duplicates get: none, by key before the sort, or by neighbours after it."""
        if self.dedup == IDENTITY:
            return "none"
        return "key" if is_global(self._order(), self.dedup) else "neighbours"

    def iterate(self, df: DataFrame) -> Iterator[Row]:
        return sinks.iterate(self.run(df, pos=None))

    def visit(self, df: DataFrame, consume: Callable[[Row], None]) -> int:
        return sinks.visit(self.run(df, pos=None), consume)

    def write_with(self, df: DataFrame, open_sink: Callable[[int], Any]) -> list[Any]:
        return sinks.write_with(self.run(df, pos=None), open_sink)

    def write_to(self, df: DataFrame, path: str, file_format: str = "parquet", **options: str) -> None:
        sinks.write_to(self.run(df, pos=None), path, file_format, **options)
