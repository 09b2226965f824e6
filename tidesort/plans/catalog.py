"""Registered queries of the ordering engine and the SQL that gives the same rows.

Each ordered query emits ``pos``, the row's place in a total order, so that a comparison which ignores row order still
sees the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesort.functions import predicates, transforms
from tidesort.operators import keys, orders
from tidesort.operators.dedup import Dedup, ordered_distinct, reduce_by_key
from tidesort.operators.merge import merge_keyed, merge_sorted
from tidesort.operators.orders import Order
from tidesort.operators.position import fixed, numbered, use_shared_dir, with_next, with_position
from tidesort.plans.spec import MergeConfig, SortSpec
from tidesort.sources.records import MIXED_SQL, READS_SQL, record_bytes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records that a task makes.
TASK_ROWS = 500_000


def records_of(lines: DataFrame) -> DataFrame:
    """READS_SQL over ``lines``.  There are few sequences, by the remainder of the part key: each is made once."""
    spark = lines.sparkSession
    make = lambda rows: spark.sql(READS_SQL.replace("{S}", "string").replace("FROM lineitem", "FROM {lineitem}"), lineitem=rows)
    parts = make(spark.range(-499, 500).select(F.lit(0).alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("id").alias("l_partkey")))
    sequences = parts.select(F.col("l_partkey").alias("__part"), F.col("sequence").alias("__sequence"))
    made = make(lines).join(F.broadcast(sequences), F.col("l_partkey") % 500 == F.col("__part"), "left")
    return made.withColumn("sequence", F.col("__sequence")).drop("__part", "__sequence")


def reads(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    few, most = lines.rdd.getNumPartitions(), max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))
    # A file is few tasks; the records are dear to make and large, so their keys are dealt out first.
    made = records_of(lines.repartition(most) if few < most else lines)
    if mixed:
        made = spark.sql(MIXED_SQL.replace("FROM reads", "FROM {reads}"), reads=made)
    return made.select("name", "sequence", "quality")


READS = f"WITH reads AS ({READS_SQL.replace('{S}', 'varchar')}), mixed AS ({MIXED_SQL}), r AS (SELECT name, sequence, quality FROM reads)"

# order: (the engine's order, SQL of the total order)
RECORD_ORDERS: dict[str, tuple[Order, str]] = {
    "seq": (orders.ILLUMINA_ORDER, "sequence, quality, name"),
    "seq_reverse": (orders.ILLUMINA_ORDER.reversed(), "sequence DESC, quality DESC, name"),
    "name": (orders.NAME_ORDER, "name, sequence, quality"),
    "name_reverse": (orders.NAME_ORDER.reversed(), "name DESC, sequence, quality"),
    "length": (orders.LENGTH_ORDER, "strlen(sequence), name, sequence, quality"),
    "length_reverse": (orders.LENGTH_ORDER.reversed(), "strlen(sequence) DESC, name, sequence, quality"),
}
DEDUPS = {"name": ("name",), "sequence": ("sequence",), "seq_qual": ("sequence", "quality")}


def _record_sort(order: Order, mixed: bool) -> Query:
    return lambda spark, d: SortSpec().sort_by(order).run(reads(spark, d, mixed))


def _record_dedup(order: Order, columns: tuple[str, ...], mixed: bool) -> Query:
    return lambda spark, d: SortSpec().sort_by(order).dedup_by(*columns).run(reads(spark, d, mixed))


def _sorted_sql(source: str, order: str) -> str:
    return f"{READS} SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM {source}"


def _dedup_sql(source: str, order: str, columns: tuple[str, ...]) -> str:
    fresh = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in columns)
    return f"""{READS}, o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM {source}),
    k AS (SELECT *, n = 1 OR {fresh} AS fresh FROM o WINDOW w AS (ORDER BY n))
    SELECT name, sequence, quality, row_number() OVER (ORDER BY n) AS pos FROM k WHERE fresh"""


def by_last_digit_then_down(a: tuple, b: tuple) -> int:
    """A comparator of one number; executors find it by its name."""
    x, y = (a[0] % 10, -a[0]), (b[0] % 10, -b[0])
    return (x > y) - (x < y)


def through_files(df: DataFrame, spec: SortSpec) -> DataFrame:
    """Rows as a reader of the written files finds them: files by name, rows as they stand, with positions.

    The files lie in the shared folder and go when the session's JVM ends.  One row a file gives the offsets.
    """
    spark = df.sparkSession
    use_shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"
    spec.write_to(df, path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(files, "file").select(*df.columns, (F.col("base") + F.col("at") + 1).alias("pos"))


def _tables() -> dict[str, tuple[Query, str]]:
    """Sorts, merges and dedup over the generic tables."""
    out: dict[str, tuple[Query, str]] = {}

    def ordered(name: str, source: str, columns: str, order: Order, total: str, drop: tuple[str, ...] = ()) -> None:
        names = columns.split(", ")
        shown = [c for c in names if c not in drop]
        out[name] = (
            lambda spark, d: SortSpec().sort_by(order).run(table(spark, d, source).select(*names)).select(*shown, "pos"),
            f"SELECT {', '.join(shown)}, row_number() OVER (ORDER BY {total}) AS pos FROM {source}",
        )

    line = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    rest = "l_linenumber, l_partkey, l_suppkey"
    ordered("u64_sort_asc", "lineitem", line, orders.natural("l_orderkey"), f"l_orderkey, {rest}")
    ordered("u64_sort_desc", "lineitem", line, orders.natural("l_orderkey").reversed(), f"l_orderkey DESC, {rest}")
    ordered("double_reverse_sort", "lineitem", line, orders.natural("l_orderkey").reversed().reversed(), f"l_orderkey, {rest}")
    ordered("tuple_key_sort", "events", "event_type, ts, event_id", orders.natural("event_type", "ts"), "event_type, ts, event_id", ("ts",))
    ordered("ci_desc_sort", "customer", "c_custkey, c_name", orders.normalized(F.lower, "c_name").reversed(), "lower(c_name) DESC, c_custkey, c_name")
    ordered("via_common_type_sort", "part", "p_partkey, p_name", orders.via("p_name"), "p_name, p_partkey")
    ordered("double_key_sort", "lineitem", f"l_extendedprice, {line}", orders.natural("l_extendedprice"), f"l_extendedprice, {line}")
    price = lambda df: F.col("l_extendedprice") * (1 - F.col("l_discount"))
    ordered("computed_key_sort", "lineitem", f"{line}, l_extendedprice, l_discount", Order((price,)), f"l_extendedprice * (1 - l_discount), {line}, l_extendedprice, l_discount")

    out["adjacent_dedup_u64"] = (
        lambda spark, d: ordered_distinct(table(spark, d, "lineitem").select("l_orderkey"), orders.natural("l_orderkey"), Dedup(("l_orderkey",))),
        "SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS pos FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
    )
    out["adjacent_dedup_prefix"] = (
        lambda spark, d: ordered_distinct(
            table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), orders.natural("l_orderkey", "l_linenumber"), Dedup(("l_returnflag",))
        ),
        f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (ORDER BY l_orderkey, {rest}, l_returnflag) AS n FROM lineitem),
        k AS (SELECT *, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (ORDER BY n) AS fresh FROM o)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (ORDER BY n) AS pos FROM k WHERE fresh""",
    )
    out["adjacent_dedup_fold"] = (
        lambda spark, d: SortSpec().key("o_custkey").dedup_when(lambda a, b: abs(a["o_custkey"] - b["o_custkey"]) <= 3).run(table(spark, d, "orders").select("o_custkey")),
        """WITH RECURSIVE v AS (SELECT DISTINCT o_custkey AS c FROM orders),
        kept(c) AS (SELECT min(c) FROM v UNION ALL SELECT (SELECT min(v.c) FROM v WHERE v.c > kept.c + 3) FROM kept WHERE kept.c IS NOT NULL)
        SELECT c AS o_custkey, row_number() OVER (ORDER BY c) AS pos FROM kept WHERE c IS NOT NULL""",
    )
    out["dedup_reduce"] = (
        lambda spark, d: reduce_by_key(table(spark, d, "lineitem"), ["l_orderkey"], F.sum("l_quantity").alias("sum_qty"), F.max("l_extendedprice").alias("max_price"), F.count("*").alias("n_rows")),
        "SELECT l_orderkey, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey",
    )
    split = lambda spark, d, k: [table(spark, d, "orders").select("o_orderkey", "o_custkey").where(F.col("o_orderkey") % k == i) for i in range(k)]
    out["merge_sorted_runs"] = (
        lambda spark, d: merge_sorted([r.sortWithinPartitions("o_custkey") for r in split(spark, d, 4)], orders.natural("o_custkey")),
        "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders",
    )
    out["merge_one_run"] = (
        lambda spark, d: merge_sorted(split(spark, d, 1), orders.natural("o_custkey")),
        "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders",
    )
    out["merge_dedup"] = (
        lambda spark, d: merge_sorted([table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))], orders.natural("l_partkey"), Dedup(("l_partkey",))),
        "SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS pos FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part)",
    )
    out["merge_coarse_key"] = (
        lambda spark, d: merge_keyed(split(spark, d, 3), F.floor(F.col("o_custkey") / 10), orders.natural("o_custkey")),
        "SELECT o_orderkey, o_custkey, (o_custkey // 10)::BIGINT AS key, row_number() OVER (ORDER BY o_custkey // 10, o_custkey, o_orderkey) AS pos FROM orders",
    )
    out["merge_no_run"] = (
        lambda spark, d: merge_sorted([], orders.natural("o_custkey"), schema=table(spark, d, "orders").select("o_orderkey", "o_custkey").schema),
        "SELECT o_orderkey, o_custkey, 0::BIGINT AS pos FROM orders WHERE false",
    )
    by_customer, customers = SortSpec().key("o_custkey"), lambda spark, d: table(spark, d, "orders").select("o_orderkey", "o_custkey")
    placed = "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders"
    small = by_customer.memory_budget(1 << 20).max_buffer_items(100).merge_config(MergeConfig(max_fan_in=2)).arena().sort_with_sequential()
    out["sort_with_hints"] = (lambda spark, d: small.run(customers(spark, d)), placed)
    out["sort_to_files"] = (lambda spark, d: through_files(customers(spark, d), by_customer), placed)
    firsts = by_customer.dedup_with(lambda rows: rows.groupBy("o_custkey").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_rows")))
    out["dedup_with_function"] = (
        lambda spark, d: firsts.run(customers(spark, d)),
        f"SELECT o_custkey, min(pos) AS first_pos, count(*) AS n_rows FROM ({placed}) GROUP BY o_custkey",
    )
    out["comparator_sort"] = (
        lambda spark, d: numbered(fixed(orders.sort_by_comparator(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], by_last_digit_then_down))),
        "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 10, s_suppkey DESC) AS pos FROM supplier",
    )
    top = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem"

    def topk(spark: SparkSession, d: str) -> DataFrame:
        """First 100 of an order: one pass, no global sort."""
        order = orders.natural("l_extendedprice").reversed()
        df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        return with_position(df.orderBy(*order.columns(df)).limit(100), order)

    out["topk"] = (topk, f"SELECT * FROM ({top}) WHERE pos <= 100")

    def relation(spark: SparkSession, d: str) -> DataFrame:
        """The predicates of a reversed order, and its larger and smaller value."""
        down, a, b = orders.natural("l_partkey").reversed(), F.col("l_partkey"), F.col("l_suppkey")
        tests = [getattr(down, n)(a, b).alias(f"rev_{n}") for n in ("lt", "le", "gt", "ge", "eq")]
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a, b, *tests, down.max(a, b).alias("rev_max"), down.min(a, b).alias("rev_min"))

    out["comparator_predicates"] = (
        relation,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey > l_suppkey AS rev_lt, l_partkey >= l_suppkey AS rev_le, l_partkey < l_suppkey AS rev_gt,
        l_partkey <= l_suppkey AS rev_ge, l_partkey = l_suppkey AS rev_eq, least(l_partkey, l_suppkey) AS rev_max, greatest(l_partkey, l_suppkey) AS rev_min FROM lineitem""",
    )
    return out


def _packed_sql(width: int, source: str = "r") -> str:
    """Hex of the packed key: two digits of base four make a hex digit."""
    clean = f"regexp_replace(upper(substr(sequence, 1, {4 * width})), '[^ACGT]', 'A', 'g')"
    digits = f"translate(rpad({clean}, {4 * width}, 'A'), 'ACGT', '0123')"
    pair = "substr('0123456789ABCDEF', 1 + 4 * CAST(substr(d, 2 * i + 1, 1) AS INT) + CAST(substr(d, 2 * i + 2, 1) AS INT), 1)"
    return f"{READS} SELECT name, sequence, array_to_string(list_transform(range({2 * width}), lambda i: {pair}), '') AS key_hex FROM (SELECT name, sequence, {digits} AS d FROM {source})"


def _records() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}
    for name, (order, total) in RECORD_ORDERS.items():
        out["_".join([name.split("_")[0], "sort", *name.split("_")[1:]])] = (_record_sort(order, False), _sorted_sql("r", total))
        for kind, columns in DEDUPS.items():
            mixed = name.startswith("length")
            out[f"{name}_dedup_{kind}"] = (_record_dedup(order, columns, mixed), _dedup_sql("mixed" if mixed else "r", total, columns))
    out["seq_sort_mixed"] = (_record_sort(orders.UNKEYED_SEQUENCE_ORDER, True), _sorted_sql("mixed", RECORD_ORDERS["seq"][1]))
    out["length_sort_mixed"] = (_record_sort(orders.LENGTH_ORDER, True), _sorted_sql("mixed", RECORD_ORDERS["length"][1]))

    def hexed(kind: keys.KeyKind, mixed: bool = False) -> Query:
        return lambda spark, d: kind.attach(reads(spark, d, mixed)).select("name", "sequence", F.hex(kind.decoded("key")).alias("key_hex"))

    for width, kind in ((38, keys.ILLUMINA_KEY), (64, keys.PAIRED_END_KEY), (128, keys.LONG_READ_KEY)):
        out[f"packed_key_{width}"] = (hexed(kind), _packed_sql(width))
    out["packed_key_mixed"] = (hexed(keys.ILLUMINA_KEY, True), _packed_sql(38, "mixed"))
    out["name_key16"] = (hexed(keys.NAME_KEY), f"{READS} SELECT name, sequence, rpad(substr(hex(name::BLOB), 1, 32), 32, '0') AS key_hex FROM r")
    out["length_key8"] = (hexed(keys.LENGTH_KEY, True), f"{READS} SELECT name, sequence, lpad(upper(to_hex(strlen(sequence))), 16, '0') AS key_hex FROM mixed")

    def coarse(spark: SparkSession, d: str) -> DataFrame:
        rows = reads(spark, d)
        runs = [rows.where(F.pmod(F.octet_length("name"), F.lit(3)) == i) for i in range(3)]
        return merge_keyed(runs, keys.packed_sequence_key("sequence", 2), orders.ILLUMINA_ORDER).withColumn("key", F.hex("key"))

    digits = "translate(substr(sequence, 1, 8), 'ACGT', '0123')"
    nibble = "substr('0123456789ABCDEF', 1 + 4 * CAST(substr(d, 2 * i + 1, 1) AS INT) + CAST(substr(d, 2 * i + 2, 1) AS INT), 1)"
    out["coarse_packed_merge"] = (
        coarse,
        f"{READS}, k AS (SELECT *, {digits} AS d FROM r) SELECT name, sequence, quality, array_to_string(list_transform(range(4), lambda i: {nibble}), '') AS key, row_number() OVER (ORDER BY d, sequence, quality, name) AS pos FROM k",
    )

    seq = SortSpec().sort_by_illumina()
    place = f"row_number() OVER (ORDER BY {RECORD_ORDERS['seq'][1]}) AS pos"
    binned = "translate(quality, {}, {})".format(*("'" + x.replace("'", "''") + "'" for x in transforms.bin_alphabets()))
    formats = {
        "codec_exact": (seq.two_bit_exact(), "name, sequence, quality"),
        "codec_lossy_n": (seq.lossy_n(), "name, regexp_replace(sequence, '[^ACGTacgt]', 'N', 'g') AS sequence, quality"),
        "codec_binned_quality": (seq.binned_quality(), f"name, sequence, {binned} AS quality"),
        "codec_omit_quality": (seq.omit_quality(), "name, sequence, '' AS quality"),
        "codec_omit_names": (seq.omit_names(), "'' AS name, sequence, quality"),
        "codec_split_names_sort": (seq.split_names(), "name, sequence, quality"),
    }
    for name, (spec, shown) in formats.items():
        out[name] = (lambda spark, d, spec=spec: spec.run(reads(spark, d, True)), f"{READS} SELECT {shown}, {place} FROM mixed")
    out["codec_binned_dedup"] = (
        lambda spark, d: seq.binned_quality().dedup_by_sequence_and_quality().run(reads(spark, d, True)),
        f"""{READS}, o AS (SELECT name, sequence, {binned} AS quality, row_number() OVER (ORDER BY {RECORD_ORDERS['seq'][1]}) AS n FROM mixed),
        k AS (SELECT *, n = 1 OR sequence <> lag(sequence) OVER w OR quality <> lag(quality) OVER w AS fresh FROM o WINDOW w AS (ORDER BY n))
        SELECT name, sequence, quality, row_number() OVER (ORDER BY n) AS pos FROM k WHERE fresh""",
    )
    def foreign(spark: SparkSession, d: str) -> DataFrame:
        """Records as bytes, with a character of two bytes in each sequence and quality."""
        with_mark = lambda c: F.concat(F.substring(c, 1, 7), F.lit("\u00e9"), F.substring(c, 8, 200)).cast("binary").alias(c)
        return reads(spark, d, True).select(F.col("name").cast("binary").alias("name"), with_mark("sequence"), with_mark("quality"))

    marked = "SELECT name, substr(sequence, 1, 7) || 'é' || substr(sequence, 8) AS sequence, substr(quality, 1, 7) || 'é' || substr(quality, 8) AS quality FROM mixed"
    out["codec_bytes"] = (
        lambda spark, d: seq.lossy_n().binned_quality().run(foreign(spark, d)).select(F.hex("name").alias("name"), F.hex("sequence").alias("sequence"), F.hex("quality").alias("quality"), "pos"),
        f"{READS}, m AS ({marked}), o AS (SELECT *, row_number() OVER (ORDER BY sequence, quality, name) AS pos FROM m) SELECT hex(name) AS name, hex(regexp_replace(replace(sequence, 'é', 'NN'), '[^ACGTacgt]', 'N', 'g')) AS sequence, hex({binned}) AS quality, pos FROM o",
    )
    foreign_digits = "translate(rpad(regexp_replace(upper(replace(substr(sequence, 1, 151), 'é', 'NN')), '[^ACGT]', 'A', 'g'), 152, 'A'), 'ACGT', '0123')"
    out["packed_key_bytes"] = (
        lambda spark, d: keys.ILLUMINA_KEY.attach(foreign(spark, d)).select(F.col("name").cast("string").alias("name"), F.hex("key").alias("key_hex")),
        f"{READS}, m AS ({marked}) SELECT name, array_to_string(list_transform(range(76), lambda i: {nibble}), '') AS key_hex FROM (SELECT name, {foreign_digits} AS d FROM m)",
    )
    out["sort_with_key"] = (
        lambda spark, d: seq.with_illumina_key().run(reads(spark, d)).select("name", "sequence", F.hex("key").alias("key_hex"), "pos"),
        f"{READS}, o AS (SELECT *, {place} FROM r) SELECT name, sequence, array_to_string(list_transform(range(76), lambda i: {nibble}), '') AS key_hex, pos FROM (SELECT name, sequence, pos, translate(rpad(regexp_replace(upper(substr(sequence, 1, 152)), '[^ACGT]', 'A', 'g'), 152, 'A'), 'ACGT', '0123') AS d FROM o)",
    )
    own = transforms.UserFormat(lambda df: df.withColumn("quality", F.substring("quality", 1, 10)))
    out["codec_user"] = (
        lambda spark, d: seq.codec(own).run(reads(spark, d, True)),
        f"{READS} SELECT name, sequence, substr(quality, 1, 10) AS quality, {place} FROM mixed",
    )
    out["codec_omit_names_dedup_name"] = (
        lambda spark, d: SortSpec().sort_by_name().omit_names().dedup_by_name().run(reads(spark, d)),
        f"{READS} SELECT '' AS name, sequence, quality, 1::BIGINT AS pos FROM r ORDER BY r.name, sequence, quality LIMIT 1",
    )
    out["codec_split_names"] = (
        lambda spark, d: reads(spark, d).select(F.concat("name", F.lit(" 1:N:0:"), F.substring("sequence", 1, 6)).alias("name"), "sequence").select("name", "sequence", transforms.short_name("name").alias("identifier"), transforms.description("name").alias("description")),
        f"{READS}, s AS (SELECT name || ' 1:N:0:' || substr(sequence, 1, 6) AS name, sequence FROM r) SELECT name, sequence, split_part(name, ' ', 1) AS identifier, substr(name, strpos(name, ' ') + 1) AS description FROM s",
    )

    def pairs(spark: SparkSession, d: str) -> DataFrame:
        """Each record against its follower in sequence order, which lies in the same range partition or heads the next."""
        fields = ["name", "sequence", "quality"]
        rows = with_next(SortSpec().sort_by_illumina().run(reads(spark, d, True)), ["pos", *fields])
        both = rows.where("next_pos is not null").select("pos", F.struct(*fields).alias("a"), F.struct(*(F.col(f"next_{c}").alias(c) for c in fields)).alias("b"))
        return both.select("pos", predicates.has_same_name("a", "b").alias("same_name"), predicates.has_same_sequence("a", "b").alias("same_sequence"), predicates.has_same_sequence_and_quality("a", "b").alias("same_both"))

    out["record_predicates"] = (
        pairs,
        f"""{READS}, o AS (SELECT *, {place} FROM mixed)
        SELECT a.pos, a.name = b.name AS same_name, a.sequence = b.sequence AS same_sequence, a.sequence = b.sequence AND a.quality = b.quality AS same_both FROM o a JOIN o b ON b.pos = a.pos + 1""",
    )
    out["record_byte_len"] = (
        lambda spark, d: reads(spark, d, True).select("name", "sequence", record_bytes().alias("record_bytes"), predicates.sequence_len().alias("sequence_len"), predicates.is_empty().alias("is_empty")),
        f"{READS} SELECT name, sequence, (strlen(name) + strlen(sequence) + strlen(quality))::BIGINT AS record_bytes, strlen(sequence)::BIGINT AS sequence_len, strlen(sequence) = 0 AS is_empty FROM mixed",
    )
    return out


def _all() -> dict[str, tuple[Query, str]]:
    return _tables() | _records()


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by sequence and quality, with positions."""
    return queries()["seq_sort"](spark, sf_dir)
