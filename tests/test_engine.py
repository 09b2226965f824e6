import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidesort.functions import predicates, transforms
from tidesort.operators import keys, orders, position
from tidesort.operators.dedup import BY_NAME, BY_SEQUENCE, BY_SEQUENCE_AND_QUALITY, Dedup, is_global, ordered_distinct
from tidesort.operators.merge import merge_keyed, merge_sorted, union_all
from tidesort.operators.orders import Order
from tidesort.operators.position import with_position
from tidesort.plans.spec import MergeConfig, SortSpec
from tidesort.sources import records, sinks


def values(df, *names):
    """Rows in order of pos, without it."""
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("pos").collect()]


def ints(spark, xs, parts=3):
    return spark.createDataFrame([(x,) for x in xs], "v long").repartition(parts)


@pytest.mark.parametrize("xs", [[], [42], list(range(10)), list(range(10, 0, -1)), [9, 7, 5, 3, 1, 2, 4, 6, 8, 10], [3, 1, 2, 1, 3, 2], [5] * 30])
def test_sorts_like_python(spark, xs):
    got = with_position(ints(spark, xs), orders.natural("v"))
    assert values(got, "v") == sorted(xs)
    assert sorted(r.pos for r in got.collect()) == list(range(1, len(xs) + 1))


def test_reverse_is_its_own_inverse(spark):
    xs = [random.Random(1).randrange(100) for _ in range(200)]
    order = orders.natural("v")
    assert values(with_position(ints(spark, xs), order.reversed()), "v") == sorted(xs, reverse=True)
    assert order.reversed().reversed() == order


def test_a_key_that_most_rows_share_is_split_over_partitions(spark):
    df = with_position(ints(spark, [7] * 2000 + list(range(50)), 4), orders.natural("v"), partitions=4)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2050 and max(sizes) < 1500


def test_ties_are_ordered_by_the_other_columns(spark):
    rows = [(1, "b"), (0, "z"), (1, "a"), (1, "c"), (0, "y")]
    got = SortSpec().key("k").run(spark.createDataFrame(rows, "k int, s string"))
    assert values(got, "k", "s") == sorted(rows)


def test_normal_forms_and_tuple_keys(spark):
    names = spark.createDataFrame([(x,) for x in ("zeta", "Alpha", "beta", "Gamma", "delta")], "s string")
    assert values(SortSpec().sort_by(orders.normalized(F.lower, "s").reversed()).run(names), "s") == ["zeta", "Gamma", "delta", "beta", "Alpha"]
    events = [(5, 2, "m"), (3, 9, "n"), (3, 1, "o")]
    assert values(SortSpec().key("level", "ts").run(spark.createDataFrame(events, "level int, ts long, m string")), "m") == ["o", "n", "m"]


def test_comparator_that_has_no_normal_form(spark):
    sys.path.insert(0, str(Path(__file__).parent))
    from comparators import by_last_digit_then_down

    spark.sparkContext.addPyFile(str(Path(__file__).parent / "comparators.py"))
    got = orders.sort_by_comparator(ints(spark, [31, 12, 2, 41, 30]), ["v"], by_last_digit_then_down, partitions=2)
    assert [r.v for r in got.collect()] == [30, 41, 31, 12, 2]


def test_null_keys_are_refused(spark):
    df = spark.createDataFrame([(None,), (1,)], "v long")
    with pytest.raises(Exception, match="null"):
        SortSpec().key("v").run(df).collect()


def test_relation_predicates_keep_the_first_on_ties(spark):
    row = spark.createDataFrame([(1, 2)], "a int, b int")
    up, down = orders.natural("a"), orders.natural("a").reversed()
    a, b = F.col("a"), F.col("b")
    got = row.select(up.lt(a, b), up.ge(a, b), down.lt(a, b), down.gt(a, b), up.max(a, b), down.max(a, b), up.min(a, a)).first()
    assert tuple(got) == (True, False, False, True, 2, 1, 1)


# duplicates


def dedup_model(rows, fields):
    out = []
    for r in rows:
        if not out or any(out[-1][f] != r[f] for f in fields):
            out.append(r)
    return out


@pytest.mark.parametrize("xs", [[1, 1, 2, 3, 3, 3], [5, 5, 5, 5], [], [1]])
def test_adjacent_dedup(spark, xs):
    got = ordered_distinct(ints(spark, xs), orders.natural("v"), Dedup(("v",)))
    assert values(got, "v") == sorted(set(xs))


def test_keys_apart_in_the_order_are_kept(spark):
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "x"), (5, "y")]
    got = ordered_distinct(spark.createDataFrame(rows, "v int, k string").repartition(3), orders.natural("v"), Dedup(("k",)))
    assert values(got, "v") == [1, 2, 3, 5]


def test_predicate_compares_with_the_last_kept_row(spark):
    spec = SortSpec().key("v").dedup_when(lambda a, b: abs(a["v"] - b["v"]) <= 1)
    assert values(spec.run(ints(spark, [0, 1, 2, 3, 4, 5, 10])), "v") == [0, 2, 4, 10]


def test_every_order_with_every_dedup_equals_the_model(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 3))), "".join(rng.choice("ACN") for _ in range(rng.randrange(3))), rng.choice("!I")) for _ in range(120)]
    df = spark.createDataFrame(rows, "name string, sequence string, quality string").repartition(4)
    recs = [dict(zip(records.FIELDS, r, strict=True)) for r in rows]
    tie = lambda r: (r["name"], r["sequence"], r["quality"])
    sorts = {
        "seq": (orders.ILLUMINA_ORDER, lambda rs: sorted(sorted(rs, key=tie), key=lambda r: (r["sequence"], r["quality"]))),
        "seq_down": (orders.ILLUMINA_ORDER.reversed(), lambda rs: sorted(sorted(rs, key=tie), key=lambda r: (r["sequence"], r["quality"]), reverse=True)),
        "name": (orders.NAME_ORDER, lambda rs: sorted(rs, key=tie)),
        "length": (orders.LENGTH_ORDER, lambda rs: sorted(sorted(rs, key=tie), key=lambda r: len(r["sequence"]))),
        "length_down": (orders.LENGTH_ORDER.reversed(), lambda rs: sorted(sorted(rs, key=tie), key=lambda r: -len(r["sequence"]))),
    }
    sorts["seq_down"] = (sorts["seq_down"][0], lambda rs: sorted(sorted(rs, key=tie), key=lambda r: (tuple(-ord(c) for c in r["sequence"].ljust(3, "\0")), tuple(-ord(c) for c in r["quality"]))))
    for name, (order, model) in sorts.items():
        for dedup in (BY_NAME, BY_SEQUENCE, BY_SEQUENCE_AND_QUALITY):
            got = values(ordered_distinct(df, order, dedup), *records.FIELDS)
            assert got == [tie(r) for r in dedup_model(model(recs), dedup.columns)], (name, dedup)


def test_planner_knows_where_keys_stand_together():
    assert is_global(orders.ILLUMINA_ORDER, BY_SEQUENCE) and is_global(orders.ILLUMINA_ORDER, BY_SEQUENCE_AND_QUALITY)
    assert is_global(orders.NAME_ORDER.reversed(), BY_NAME)
    assert not is_global(orders.NAME_ORDER, BY_SEQUENCE) and not is_global(orders.LENGTH_ORDER, BY_NAME)
    assert SortSpec().sort_by_name().dedup_by_name().plan() == "key" and SortSpec().sort_by_length().dedup_by_name().plan() == "neighbours"


def test_the_last_dedup_call_counts():
    assert SortSpec().dedup_by_name().dedup_by_sequence().dedup == BY_SEQUENCE


# keys


def packed_model(seq: bytes, width: int) -> bytes:
    codes = {ord(c): i for i, c in enumerate("ACGT")} | {ord(c): i for i, c in enumerate("acgt")}
    digits = [codes.get(b, 0) for b in seq[: 4 * width]] + [0] * max(0, 4 * width - len(seq))
    return bytes(digits[i] << 6 | digits[i + 1] << 4 | digits[i + 2] << 2 | digits[i + 3] for i in range(0, 4 * width, 4))


@pytest.mark.parametrize("width", [1, 2, 4, 38, 64, 128])
def test_packed_key(spark, width):
    rng = random.Random(width)
    seqs = ["", "A", "ACGTACGT", "AC", "NCGT", "acgt", "T" * 600] + ["".join(rng.choice("ACGTNacgt-") for _ in range(rng.randrange(600))) for _ in range(30)]
    got = spark.createDataFrame([(s,) for s in seqs], "sequence string").select("sequence", keys.packed_sequence_key("sequence", width).alias("k")).collect()
    assert all(bytes(r.k) == packed_model(r.sequence.encode(), width) for r in got)


def test_name_and_length_keys_and_their_widths(spark):
    df = spark.createDataFrame([(b"ab", b"ACG"), (b"x" * 20, b"")], "name binary, sequence binary")
    got = df.select(keys.name_key("name").alias("n"), keys.length_key("sequence").alias("l")).collect()
    assert [bytes(r.n) for r in got] == [b"ab" + b"\0" * 14, b"x" * 16] and [bytes(r.l) for r in got] == [(3).to_bytes(8, "big"), bytes(8)]
    tagged = keys.ILLUMINA_KEY.attach(df.withColumn("sequence", F.col("sequence").cast("string")))
    assert tagged.schema["key"].metadata == {"key_tag": "spill:seq2b:0038", "key_width": 38}
    with pytest.raises(Exception, match="38 bytes"):
        df.select(keys.ILLUMINA_KEY.decoded("name")).collect()


# merges


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_merging_runs_keeps_duplicates(spark, k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(30) for _ in range(20)) for _ in range(k)]
    assert values(merge_sorted([ints(spark, r, 1) for r in runs], orders.natural("v")), "v") == sorted(x for r in runs for x in r)


def test_merging_nothing_and_empty_runs(spark):
    with pytest.raises(ValueError):
        union_all([])
    assert merge_sorted([ints(spark, []), ints(spark, [])], orders.natural("v")).count() == 0


def test_coarse_key_falls_back_to_the_exact_order(spark):
    got = merge_keyed([ints(spark, [11, 19, 25]), ints(spark, [12, 18, 26])], F.floor(F.col("v") / 10), orders.natural("v"))
    assert values(got, "v") == [11, 12, 18, 19, 25, 26]


def test_ambiguous_and_lower_case_bases_keep_byte_order(spark):
    rows = [("a", s, "") for s in ("TTTT", "AAAA", "NNNN", "GGGG", "acgt")]
    df = spark.createDataFrame(rows, "name string, sequence string, quality string")
    spec = SortSpec().sort_by_illumina()
    assert values(spec.merge([df.limit(2), df.subtract(df.limit(2))]), "sequence") == ["AAAA", "GGGG", "NNNN", "TTTT", "acgt"]


# formats, records, sinks


def test_formats_apply_after_ordering_and_before_dedup(spark):
    df = spark.createDataFrame([("b", "ACNR", "!5"), ("a", "ACRN", "!6"), ("c", "T", "~~")], "name string, sequence string, quality string")
    spec = SortSpec().sort_by_illumina().lossy_n()
    assert values(spec.run(df), "sequence") == ["ACNN", "ACNN", "T"]
    assert values(spec.dedup_by_sequence().run(df), "name") == ["b", "c"]
    assert values(SortSpec().sort_by_name().omit_names().dedup_by_name().run(df), "sequence") == ["ACRN"]
    assert values(SortSpec().sort_by_name().binned_quality().run(df), "quality") == ["!7", "!7", "II"]
    assert values(SortSpec().sort_by_name().omit_quality().run(df), "quality") == ["", "", ""]
    with pytest.raises(ValueError):
        transforms.Format(name="short")


def test_records_validate_and_measure(spark):
    df = records.from_rows(spark, [("instrument:run 1:N:0", "ACGT", "!!!!"), (b"x", b"", b"")])
    got = records.as_records(df, validate=True).select(records.record_bytes().alias("n"), predicates.is_empty().alias("e"), predicates.sequence_len().alias("l")).collect()
    assert [tuple(r) for r in got] == [(28, False, 4), (1, True, 0)]
    with pytest.raises(Exception, match="differ"):
        records.as_records(records.from_rows(spark, [("x", "ACGT", "!")]), validate=True).collect()
    named = spark.createDataFrame([("a b c",), ("a",)], "name string").select(transforms.short_name("name"), transforms.description("name")).collect()
    assert [tuple(r) for r in named] == [("a", "b c"), ("a", "")]


def test_visiting_stops_at_the_first_error_and_tells_sides_apart(spark):
    spec, seen = SortSpec().key("v"), []

    def sink(row):
        if row.v == 3:
            raise RuntimeError("full")
        seen.append(row.v)

    with pytest.raises(sinks.SortSinkError, match="full"):
        spec.visit(ints(spark, [5, 3, 1, 2]), sink)
    assert seen == [1, 2]
    bad = ints(spark, [1, 2]).withColumn("w", F.raise_error(F.lit("broken")))
    with pytest.raises(sinks.SortSourceError):
        list(sinks.iterate(bad))
    assert [r.v for r in spec.iterate(ints(spark, [3, 1, 2]))] == [1, 2, 3]


def test_files_are_in_order(spark, tmp_path):
    SortSpec().key("v").write_to(ints(spark, list(range(500, 0, -1))), str(tmp_path / "out"))
    import pyarrow.parquet as pq

    found = [v for f in sorted((tmp_path / "out").glob("part-*.parquet")) for v in pq.read_table(f).column("v").to_pylist()]
    assert found == list(range(1, 501))


def test_settings_are_checked_and_kept_as_hints():
    spec = SortSpec().memory_budget(1 << 30).max_buffer_items(100).merge_config(MergeConfig()).sort_with_parallel().arena()
    assert spec.hints["memory_budget"] == 1 << 30 and spec.hints["chunk_sort"] == "parallel"
    assert SortSpec().chunk_sort("mine").sort_by_illumina().hints["chunk_sort"] == "radix"
    with pytest.raises(ValueError):
        MergeConfig(max_fan_in=1)
    with pytest.raises(ValueError):
        SortSpec().max_buffer_items(0)
    with pytest.raises(ValueError, match="order"):
        SortSpec().run(None)


def test_custom_reduction_in_place_of_dedup(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int")
    got = SortSpec().key("k").dedup_with(lambda d: d.groupBy("k").agg(F.sum("v").alias("s"))).run(df)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5), (2, 5)]


def test_micro_batches_are_ordered(spark, tmp_path):
    from tidesort.streaming.batches import sorted_batches

    ints(spark, [3, 1, 2, 1]).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("v long").parquet(str(tmp_path / "in"))
    query = sorted_batches(stream, SortSpec().key("v").dedup_by("v"), lambda df, i: got.extend(r.v for r in df.toLocalIterator())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert got == [1, 2, 3]


def test_order_without_a_name_resolves_functions(spark):
    order = Order((lambda df: -F.col("v"),))
    assert values(with_position(ints(spark, [1, 3, 2]), order), "v") == [3, 2, 1]


def test_user_sinks_get_rows_in_order(spark):
    class ListSink:
        def __init__(self, partition):
            self.partition, self.rows = partition, []

        def write(self, row):
            if row.v < 0:
                raise ValueError("negative")
            self.rows.append(row.v)

        def close(self):
            return self.partition, self.rows

    df = spark.createDataFrame([(v * 37 % 1000,) for v in range(1000)], "v long").repartition(5)
    spec = SortSpec().key("v")
    parts = spec.write_with(df, ListSink)
    assert [p for p, _ in parts] == sorted(p for p, _ in parts) and [v for _, rows in parts for v in rows] == list(range(1000))
    with pytest.raises(sinks.SortSinkError, match="negative"):
        spec.write_with(spark.createDataFrame([(-1,)], "v long"), ListSink)


def test_formats_keep_bytes(spark):
    from tidesort.sources.records import from_rows

    rows = [(b"a", bytes(range(256)), bytes(range(255, -1, -1)))]
    out = SortSpec().sort_by_illumina().lossy_n().binned_quality().run(from_rows(spark, rows)).first()
    assert bytes(out.sequence) == bytes(b if chr(b) in "ACGTacgt" else 78 for b in range(256)) and len(out.quality) == 256 and bytes(out.quality)[:128] == bytes(range(255, 127, -1))
    assert SortSpec().key("v").merge([], schema="v long").columns == ["v", "pos"] and SortSpec().key("v").merge([]).count() == 0


def test_rows_after_across_partitions(spark):
    """The follower of a partition's last row heads the next partition that has rows."""
    df = spark.range(0, 100, 1, 7).where("id not between 14 and 43").withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    got = [tuple(r) for r in position.with_next(position.fixed(df), ["id", "v"]).collect()]
    ids = [i for i in range(100) if not 14 <= i <= 43]
    name = lambda i: None if i is None or i % 3 == 0 else str(i)
    assert got == [(i, name(i), j, name(j)) for i, j in zip(ids, [*ids[1:], None], strict=True)]
    assert position.with_next(position.fixed(df.where("id < 0")), ["id"]).count() == 0


def test_equal_keys_come_into_one_range_without_a_window(spark):
    """One shuffle by bounds of the key in place of a window by key and a range shuffle."""
    df = spark.createDataFrame([(f"n{i * 7919 % 1500:04}", i) for i in range(6000)], "name string, v int").repartition(4)
    rows = position.ranged(df, orders.natural("name"), 5, once=("name",))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan
    found = {}
    for r in rows.select("name", F.spark_partition_id().alias("p")).collect():
        found.setdefault(r.name, set()).add(r.p)
    assert len(found) == 1500 and all(len(p) == 1 for p in found.values()) and len(set.union(*found.values())) == 5
    got = ordered_distinct(df, orders.natural("name"), Dedup(("name",)), partitions=5)
    assert values(got, "name", "v") == [(f"n{k:04}", min(i for i in range(6000) if i * 7919 % 1500 == k)) for k in range(1500)]


def test_repeated_keys_are_dropped_before_they_travel(spark):
    import pyarrow as pa

    def sent(by, once):
        table = pa.RecordBatch.from_pydict({"p": pa.array([0] * 9000, pa.int32()), "k": [f"k{i % 3}" for i in range(9000)], "v": list(range(9000, 0, -1))})
        return list(position._unpack(position._pack(iter([table]), "p", by, once)))

    order = [("k", "descending"), ("v", "ascending")]
    assert [r for b in sent(order, ("k",)) for r in b.to_pylist()] == [{"k": "k2", "v": 1}, {"k": "k1", "v": 2}, {"k": "k0", "v": 3}]
    assert sum(b.num_rows for b in sent([], ())) == 9000


def test_records_travel_packed(spark):
    """Reads take less than half of their bytes in a shuffle."""
    import pyarrow as pa

    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(150))
    rows = pa.RecordBatch.from_pydict({"p": pa.array([0] * 2000, pa.int32()), "sequence": [text("ACGT") for _ in range(2000)], "quality": [text("!#%&*+-5:;<=?AEI") for _ in range(2000)]})
    sent = list(position._pack(iter([rows]), "p", [], ()))
    assert sum(len(x.as_py()) for b in sent for x in b.column("rows")) < 150_000 + 150_000
    assert pa.Table.from_batches(position._unpack(iter(sent))).equals(pa.Table.from_batches([rows.drop_columns(["p"])]))


@pytest.mark.parametrize("down", [False, True])
def test_types_and_nulls_in_range_bounds(spark, down):
    """Values of every type that is compared, with nulls in the columns that break ties, over several ranges."""
    from pyspark.sql import Row

    made = spark.range(3000).select(
        (F.col("id") % 7 - 3).cast("decimal(9,2)").alias("a"),
        F.when(F.col("id") % 5 > 0, F.timestamp_micros(F.xxhash64("id") % 10**15)).alias("t"),
        F.when(F.col("id") % 3 > 0, F.md5(F.col("id").cast("string")).cast("binary")).alias("b"),
        F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.rand(1)).alias("x"),
        F.array("id").alias("list"),
    ).persist()
    order = orders.natural("a")
    order = order.reversed() if down else order
    got = with_position(made, order, partitions=6)
    assert got.select(F.spark_partition_id()).distinct().count() == 6
    plain = lambda rows: [tuple("nan" if v != v else bytes(v) if isinstance(v, bytearray) else v for v in Row(*r)) for r in rows]
    assert plain(got.orderBy("pos").drop("pos").collect()) == plain(made.orderBy(*order.columns(made)).collect())


def test_a_fold_sorts_chunks_and_no_rows(spark):
    rows = position.fixed(spark.range(0, 300_000, 1, 3).withColumnRenamed("id", "v"))
    assert position.in_chunks(rows).count() <= 9
    spec = SortSpec().key("v").dedup_when(lambda a, b: b["v"] - a["v"] < 1000)
    assert values(spec.run(spark.range(100_000).withColumnRenamed("id", "v").repartition(3)), "v") == list(range(0, 100_000, 1000))


def test_a_format_is_applied_once(spark):
    """It is applied before the rows are stored, not in each pass over them."""
    df = spark.createDataFrame([("a", "AC", "!5"), ("b", "AC", "!6"), ("c", "T", "~~")], "name string, sequence string, quality string")
    out = SortSpec().sort_by_illumina().binned_quality().dedup_by_sequence_and_quality().run(df)
    assert "translate" not in out._jdf.queryExecution().optimizedPlan().toString() and values(out, "name") == ["a", "c"]


def test_a_merge_samples_its_runs_before_the_union(spark):
    from tidesort.operators import merge

    runs = [ints(spark, range(k, 6000, 3)) for k in range(3)]
    plan = merge._some(runs, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("rand(")
    got = ordered_distinct(union_all(runs), orders.natural("v"), partitions=4, some=lambda share: merge._some(runs, share))
    assert values(got, "v") == list(range(6000))
