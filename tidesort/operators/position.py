"""Global order over many partitions, and each row's position in it.

The ordered rows are written to the shared checkpoint folder: one range partition a task, in order.  That fixes the
partitions, so counts and neighbours taken from one pass hold for the next one, also when an executor is lost.
"""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidesort.operators.orders import Order

_LOW = (1 << 33) - 1


def use_shared_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own only where none is set, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="tidesort-")
            atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)


def ranged(df: DataFrame, order: Order, partitions: int | None = None, once: tuple[str, ...] = (), some: Some | None = None) -> DataFrame:
    """Rows in range partitions, sorted within each; concatenated partitions are in the total order.

    Sampled bounds deal the rows out (:func:`bounds_of`); they travel packed, so a row is made once and shuffled once.  A key
    with very many equal rows is split over partitions like any other.  ``once``: leading columns of which only the first row
    counts; equal ones come into one partition, and most of the others don't travel.  ``some``: gives about a share of
    the rows of ``df``, where that is cheaper than a filter over it.
    """
    found = bounds_of(df, order, partitions, len(once), some)
    if found is None:
        return _ranged_by_spark(df, order, partitions)
    p, n = _free(df, "__p"), found.partitions
    columns = df.columns
    marked = df.select(found.place().alias(p), *(F.col(f"`{c}`") for c in columns))
    by = [(k, "descending" if order.descending else "ascending") for k in order.keys if isinstance(k, str)]
    plain = len(by) == len(order.keys) and not any(kind in ("float", "double") or not _atomic(kind) for _, kind in df.dtypes)
    by += [(c, "ascending") for c in columns if c not in dict(by)]
    by = by if once and plain else []
    packed = marked.mapInArrow(lambda batches: _pack(batches, p, by, once), f"`{p}` int, rows binary")
    rows = unpacked(packed.repartitionById(n, F.col(f"`{p}`")).select("rows"), df.schema)
    return rows.sortWithinPartitions(*order.columns(rows))


def _ranged_by_spark(df: DataFrame, order: Order, partitions: int | None = None) -> DataFrame:
    """For keys that have no bounds of ours.  A row number ends the order, so that equal rows are split."""
    last = _free(df, "__row")
    numbered = df.withColumn(last, F.monotonically_increasing_id())
    keys = [*order.columns(df), F.col(last).asc()]
    dealt = numbered.repartitionByRange(partitions, *keys) if partitions else numbered.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop(last)


def _free(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a range partition at most, on average; rows from which a further core is worth a partition; sampled rows.
PARTITION_ROWS, CORE_ROWS, SAMPLE_ROWS = 400_000, 20_000, 20_000
#: Rows and bytes that a task packs at a time.
PACK_ROWS, PACK_BYTES = 1 << 18, 1 << 26
_ATOMIC = {"tinyint", "smallint", "int", "bigint", "float", "double", "string", "binary", "boolean", "date"}


def _atomic(kind: str) -> bool:
    return kind in _ATOMIC or kind.startswith("decimal") or kind == "timestamp"


@dataclass(frozen=True)
class Bounds:
    """Sorted values of the first sort columns; partition i holds what lies between bounds i - 1 and i."""

    columns: list[Column]  # sort columns that are compared, and their types
    kinds: list[str]
    down: int  # so many of them are descending
    values: list[tuple]
    split: bool  # rows that equal several bounds may go to any of the partitions between

    @property
    def partitions(self) -> int:
        return len(self.values) + 1

    def place(self) -> Column:
        """The partition of a row."""
        if not self.values:
            return F.lit(0)
        groups = [g for g in (range(self.down), range(self.down, len(self.columns))) if len(g)]
        pack = lambda values: F.struct(*(F.struct(*(values[i].alias(f"k{i}") for i in g)).alias(f"g{j}") for j, g in enumerate(groups)))
        literal = lambda v: [F.lit(x).cast(kind) for x, kind in zip(v, self.kinds, strict=True)]
        bounds, row = F.array(*(pack(literal(v)) for v in self.values)), pack(self.columns)

        def before(bound: Column, tied: bool) -> Column:
            """Whether the bound comes before the row, or ties with it."""
            out = F.lit(tied)
            for j in reversed(range(len(groups))):
                a, b = bound[f"g{j}"], row[f"g{j}"]
                out = (a > b if self.down and not j else a < b) | ((a == b) & out)
            return out

        def count(tied: bool) -> Column:
            """Binary search; a place beyond the last bound is null, which is no."""
            steps = [1 << i for i in reversed(range(len(self.values).bit_length()))]
            return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(before(F.get(bounds, at + step - 1), tied), at + step).otherwise(at))

        low = count(False)
        if not self.split or len(set(self.values)) == len(self.values):
            return low
        return low + F.pmod(F.monotonically_increasing_id(), count(True) - low + 1).cast("int")


Some = Callable[[float], DataFrame]


def some_of(df: DataFrame, share: float) -> DataFrame:
    return df.where(F.rand(7) < share)


def has_bounds(df: DataFrame, order: Order, key: int) -> bool:
    """Whether rows can be dealt by the first ``key`` sort columns alone."""
    own, rest = order.parts(df)
    kinds = [kind for _, kind in df.select(*(c.alias(f"k{i}") for i, c in enumerate([*own, *rest][:key]))).dtypes]
    return all(map(_atomic, kinds)) and _packable(df)


def bounds_of(df: DataFrame, order: Order, partitions: int | None = None, key: int = 0, some: Some | None = None) -> Bounds | None:
    """Bounds from a sample of the sort columns; None where the first of them has a type that is not compared here.

    The count reads no column, and the sample makes the columns of sampled rows alone.  As few of the sort columns are compared
    as tell the sampled rows apart; with ``key``, so many.
    """
    own, rest = order.parts(df)
    columns = [*own, *rest][: key or None]
    kinds = [kind for _, kind in df.select(*(c.alias(f"k{i}") for i, c in enumerate(columns))).dtypes]
    good = next((i for i, kind in enumerate(kinds) if not _atomic(kind)), len(kinds))
    if not good or good < key or not _packable(df):
        return None
    columns, kinds = columns[:good], kinds[:good]
    columns = [F.unix_micros(c) if kind == "timestamp" else c for c, kind in zip(columns, kinds, strict=True)]
    kinds = ["bigint" if kind == "timestamp" else kind for kind in kinds]
    down = min(len(own), good) if order.descending else 0
    total = df.count()
    n = partitions or max(1, -(-total // PARTITION_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-total // CORE_ROWS)))
    if n == 1 or not total:
        return Bounds(columns, kinds, down, [], not key)
    share = min(SAMPLE_ROWS, max(2000, 60 * n)) / total
    few = df if share >= 1 else some(share) if some else some_of(df, share)
    few = few.select(*(c.alias(f"k{i}") for i, c in enumerate(columns))).repartition(1)
    sample = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in few.sortWithinPartitions(*(F.desc(f"k{i}") if i < down else F.asc(f"k{i}") for i in range(good))).collect()]
    if not sample:
        return Bounds(columns, kinds, down, [], not key)
    width = good
    for w in range(1, good):
        if max(sum(1 for _ in g) for _, g in itertools.groupby(r[:w] for r in sample)) * 2 * n <= len(sample):
            width = w
            break
    values = [sample[i * len(sample) // n][:width] for i in range(1, n)]
    if key:
        values = list(dict.fromkeys(values))
    return Bounds(columns[:width], kinds[:width], min(down, width), values, not key)


def _packable(df: DataFrame) -> bool:
    try:
        to_arrow_schema(df.schema)
    except Exception:  # a type without an Arrow form
        return False
    return True


def _packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = PACK_ROWS, size: int = PACK_BYTES) -> Iterator[pa.Table]:
    held, n, b = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pack(batches: Iterator[pa.RecordBatch], place: str, by: list[tuple[str, str]], once: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(partition, its rows of one chunk); given ``by``, of rows that are equal in ``once`` the first in that order alone."""
    for table in _gathered(batches):
        if by and not any(c.null_count for c in table.columns):
            before = table.num_rows
            table = table.take(pc.sort_indices(table, sort_keys=by))
            new = functools.reduce(pc.or_, (_changes(table.column(c).combine_chunks()) for c in once))
            table = table.filter(new)
            if table.num_rows > 0.9 * before:
                by = []  # hardly any are equal here
        p = table.column(place).to_numpy()
        order = np.argsort(p, kind="stable")
        if not by:
            table = table.take(pa.array(order))
        p, table = p[order], table.drop_columns([place]).combine_chunks()
        edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
        blobs = [_packed(table.slice(a, b - a)) for a, b in itertools.pairwise(edge)]
        yield pa.RecordBatch.from_arrays([pa.array(p[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], [place, "rows"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("rows")):
                yield from pa.ipc.open_stream(blob.as_buffer())

    for table in _gathered(parts(), 10_000, 1 << 24):
        yield from table.to_batches(max_chunksize=10_000)


def in_chunks(df: DataFrame) -> DataFrame:
    """(rows): the rows of each partition as they stand, packed by chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1 << 16, 1 << 24):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(table)], pa.binary())], ["rows"])

    return df.mapInArrow(pack, "rows binary")


def unpacked(chunks: DataFrame, schema: StructType) -> DataFrame:
    return chunks.mapInArrow(lambda batches: _unpack(batches), schema)


def fixed(df: DataFrame) -> DataFrame:
    """The partitions of ``df`` as they are, in shared storage.  This runs ``df`` at once, before any action on the result."""
    use_shared_dir(df.sparkSession)
    return unpacked(in_chunks(df).checkpoint(), df.schema) if _packable(df) else df.checkpoint()


def numbered(fixed_df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds positions from 1.  ``fixed_df`` must have fixed partitions, or be a narrow function of such rows."""
    partition = F.spark_partition_id()
    counts = {r["p"]: r["n"] for r in fixed_df.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    if not offsets:
        return fixed_df.withColumn(name, F.lit(0).cast("long"))
    base = F.element_at(F.array(*(F.lit(x) for x in offsets)), F.spark_partition_id() + 1)
    return fixed_df.withColumn(name, base + F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)) + 1)


def with_position(df: DataFrame, order: Order, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``df`` with the position of each row in ``order``."""
    return numbered(fixed(ranged(df, order, partitions)), name)


def _differs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null-safe inequality."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.and_not(pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pa.scalar(True), pc.fill_null(pc.not_equal(a, b), False)), both)


def _changes(column: pa.Array) -> pa.Array:
    """Whether a value differs from the one before; the first does."""
    return pa.concat_arrays([pa.array([True]), _differs(column.slice(1), column.slice(0, len(column) - 1))])


def first_of_runs_within(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose ``columns`` differ from those of the row before in the same partition."""
    return df.mapInArrow(lambda batches: _first(batches, list(columns), None), df.schema)


def _first(batches: Iterator[pa.RecordBatch], columns: list[str], last: list[pa.Array] | None) -> Iterator[pa.RecordBatch]:
    """Rows that differ in ``columns`` from the row before; ``last``: what stands before the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keep = None
        for i, c in enumerate(columns):
            now = batch.column(batch.schema.get_field_index(c))
            new = _changes(now) if last is None else _differs(now, pa.concat_arrays([last[i].cast(now.type), now.slice(0, len(now) - 1)]))
            keep = new if keep is None else pc.or_(keep, new)
        last = [pa.concat_arrays([batch.column(batch.schema.get_field_index(c)).slice(batch.num_rows - 1, 1)]) for c in columns]
        yield batch.filter(keep)


def keep_first_of_runs(fixed_df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` differ from those of the row before, across partitions.

    One narrow pass takes the last values of each partition (a row a partition for the driver), a second drops the
    rows; nothing is shuffled.
    """
    tail_schema = fixed_df.select(F.lit(0).alias("__p"), *columns).schema

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            p = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([p, *last.columns], ["__p", *columns])

    found = fixed_df.select(*columns).mapInArrow(tails, tail_schema).toArrow().sort_by("__p")
    at = found.column("__p").to_pylist()
    kinds = [found.schema.field(c).type for c in columns]
    values = list(zip(*(found.column(c).to_pylist() for c in columns), strict=True))
    before = dict(zip(at[1:], values[:-1], strict=True)) if at else {}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = before.get(TaskContext.get().partitionId())
        last = None if own is None else [pa.array([v], k) for v, k in zip(own, kinds, strict=True)]
        return _first(batches, columns, last)

    return fixed_df.mapInArrow(first, fixed_df.schema)


def with_next(fixed_df: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the row after it, across partitions, named with ``prefix``; null after the last row.

    One narrow pass takes the first values of each partition (a row a partition for the driver), a second adds the columns;
    nothing is shuffled.
    """
    head_schema = fixed_df.select(F.lit(0).alias("__p"), *columns).schema
    out_schema = StructType([*fixed_df.schema.fields, *(StructField(prefix + c, fixed_df.schema[c].dataType) for c in columns)])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b.slice(0, 1) for b in batches if b.num_rows), None)
        for _ in batches:
            pass  # a worker is used again only when its input is read
        if first is not None:
            p = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([p, *first.columns], ["__p", *columns])

    found = fixed_df.select(*columns).mapInArrow(heads, head_schema).toArrow().sort_by("__p")
    at = found.column("__p").to_pylist()
    values = list(zip(*(found.column(c).to_pylist() for c in columns), strict=True))
    after = dict(zip(at[:-1], values[1:], strict=True)) if at else {}

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(batch: pa.RecordBatch, following: list[pa.Array]) -> pa.RecordBatch:
            more = [pa.concat_arrays([batch.column(c).slice(1), x.cast(batch.column(c).type)]) for c, x in zip(columns, following, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(prefix + c for c in columns)])

        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield joined(held, [batch.column(c).slice(0, 1) for c in columns])
                held = batch
        if held is not None:
            own = after.get(TaskContext.get().partitionId(), [None] * len(columns))
            yield joined(held, [pa.array([v], held.column(c).type) for c, v in zip(columns, own, strict=True)])

    return fixed_df.mapInArrow(follow, out_schema)
