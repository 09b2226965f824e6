"""Registered queries against their SQL in DuckDB."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidesort.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
SOME = ["u64_sort_desc", "ci_desc_sort", "computed_key_sort", "adjacent_dedup_prefix", "adjacent_dedup_fold", "merge_coarse_key", "topk", "seq_sort_mixed", "seq_reverse_dedup_sequence", "length_dedup_name", "packed_key_mixed", "codec_binned_dedup", "coarse_packed_merge", "record_predicates", "merge_no_run", "codec_bytes", "packed_key_bytes", "sort_with_key", "codec_user", "sort_with_hints", "sort_to_files", "dedup_with_function", "comparator_sort"]


def database():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    want = database().execute(catalog.oracle_sql()[name]).fetch_df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_queries_are_listed_without_a_session():
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_runs(spark):
    spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    df = module.entry(spark)
    assert df.columns == ["name", "sequence", "quality", "pos"] and df.count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())


def test_sequences_of_records_are_made_once_each(spark):
    """The sequence comes from a broadcast table of remainders, also for negative and missing part keys."""
    from tidesort.sources.records import READS_SQL

    rows = [(k, k % 7, p) for k, p in enumerate([0, 1, 499, 500, 501, -1, -499, -500, -1234, None, 10**12])]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long")
    want = spark.sql(READS_SQL.replace("{S}", "string").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines).select("name", "sequence", "quality")
    got = catalog.records_of(lines).select("name", "sequence", "quality")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()
