"""Best-fit packing with several permitted sequence lengths.

Texts are cut into pieces of at most the largest length.  Pieces go, by decreasing size, into the open bin that they
fill best; if none has room, a bin opens whose length costs least for what it can be expected to hold; at the
end every bin shrinks to the smallest length that holds its contents.  The lengths are chosen jointly: the same is tried with
each permitted length as the one that opens where it can, and the plan of least cost counts, so it never costs more than
packing for one length.  The cost of a length is ``length + length^2 / 16384`` by default (linear and quadratic work of a
model), so short lengths are worth using and long ones fill better.

Sizes are words, or those of a column (``size``) such as the tokens of an encoder.  Pieces are packed in shards of about ``shard_rows`` pieces, dealt by hash, so no task sees more than that, and a source or a
key with very many rows is spread over all of them.

Defined results: a null, empty or blank text has no words and no piece, hence no row; null keys and repeated rows are
packed like others; keys keep their type and value, nulls beside them or not; pieces of equal size are taken by key (nulls
last), piece and row; pieces keep the key, so extra columns don't clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesort.llm.graph import written
from tidesort.llm.quality_rules import words_of

LENGTHS = (512, 1024, 2048, 4096)


def work(length: int) -> float:
    return length + length * length / 16384


Plan = tuple[list[int], list[int], list[int]]


def _planned(order: Sequence[int], sizes: Sequence[int], lengths: Sequence[int], opens: Callable[[int, int], int]) -> Plan:
    """Best fit in the given order; ``opens(size, rest)`` is the length of a new bin."""
    room: dict[int, list[int]] = {}  # free space -> open bins
    free_mask = 0  # bit f is set where a bin with f free places is open
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    rest = sum(sizes)
    for i in order:
        size = sizes[i]
        fits = free_mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            b = room[free].pop()
            if not room[free]:
                free_mask &= ~(1 << free)
        else:
            b, free = len(used), opens(size, rest)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        rest -= size
        if free > size:
            room.setdefault(free - size, []).append(b)
            free_mask |= 1 << (free - size)
    return bins, offsets, [next(c for c in lengths if c >= n) for n in used]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = work) -> Plan:
    """(bin of each piece, offset of each piece, length of each bin); a size is 1 to the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda j: (-sizes[j], j))
    opens = [lambda size, rest: min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, rest), c))]
    opens += [lambda size, rest, least=least: next(c for c in lengths if c >= max(size, least)) for least in lengths]
    plans = [_planned(order, sizes, lengths, choice) for choice in opens]
    return min(plans, key=lambda plan: sum(map(cost, plan[2])))


def pieces(df: DataFrame, key: str, text: str, most: int, size: str | None = None) -> DataFrame:
    """(key, piece, start, size): runs of at most ``most`` words (or units of column ``size``) that cover every text."""
    n = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)) if size else F.size(words_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    sized = df.select(F.col(f"`{key}`").alias("key"), n.alias("n"))
    cut = sized.select("key", "n", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int")))).alias("piece"))
    return cut.where("piece is not null").select("key", "piece", (F.col("piece") * most).cast("long").alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("size"))


PACKED = "piece int, start long, size long, bin_id long, bin_length long, offset long"


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, shard_rows: int = 8192, size: str | None = None) -> DataFrame:
    """(key, piece, start, size, bin_id, bin_length, offset): where each piece of each text lies."""
    # the row's own number keeps copies of one row, or a null key, from falling into one shard
    cut = pieces(df, key, text, max(lengths), size).withColumn("row", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "row"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("size", "descending"), ("key", "ascending"), ("piece", "ascending"), ("row", "ascending")]))
        bins, offsets, capacity = pack(table.column("size").to_pylist(), lengths)
        base = table.column("shard")[0].as_py() << 32
        longs = lambda values: pa.array(values, pa.int64())
        columns = [table.column("key"), table.column("piece"), table.column("start"), table.column("size"), longs([base | b for b in bins]), longs([capacity[b] for b in bins]), longs(offsets)]
        return pa.Table.from_arrays(columns, [key, "piece", "start", "size", "bin_id", "bin_length", "offset"])

    return dealt.groupBy("shard").applyInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKED}")
