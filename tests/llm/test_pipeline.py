"""The pipeline's decisions against plain Python on a small fixture, and the registered SQL against DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def tables(spark, tmp_path):
    base = "The house of the old man is in the garden by the river and it was not as dry as this"
    names = ["red", "blue", "green", "white", "black", "brown", "grey", "pink", "gold", "teal"]
    good = [f"{base} {' '.join(f'{n}{i}{k}' for k, n in enumerate(names * 3))} with the mail x{i}@example.com" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, good[i]) for i in range(5)] + [(200 + i, good[i] + " more") for i in range(5)]
    junk = [(300 + i, f"$$$ ### %%% {'&&& |' * 30} {i}") for i in range(20)]
    rude = [(400 + i, f"{good[i]} you idiot and clown of a moron {' '.join(f'z{i}{k}' for k in range(30))}") for i in range(20)]
    more = [(500, None), (501, ""), (None, good[3]), (7, good[7])]
    all_rows = [(k, t, "en", None, 1, "extra") for k, t in rows + junk + rude + more]
    spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(30)] + [(300 + i, 0, 0) for i in range(20)] + [(400 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return tmp_path


def test_stages(spark, tables):
    import corpus_pipeline as c

    docs = spark.read.parquet(str(tables / "documents.parquet"))
    kept = {}
    for name, stage in c.STAGES:
        out = c.written(stage(spark, docs, str(tables)), name)
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    ids = lambda name: sorted(str(r.doc_id) for r in kept[name])
    assert not [r for r in kept["quality_rules"] if r.doc_id in range(300, 320) or r.doc_id in (500, 501)]
    assert len(kept["quality_rules"]) == 30 + 10 + 20 + 2
    assert ids("quality_classifier") == sorted([str(i) for i in range(30)] + [str(100 + i) for i in range(5)] + [str(200 + i) for i in range(5)] + ["7", "None"])
    assert ids("near_duplicates") == sorted(str(i) for i in range(30))  # the row without an id repeats good[3]
    assert ids("pii") == ids("near_duplicates")
    for r in kept["pii"]:
        assert "@" not in r.text and "[email]" in r.text and r.n_chars == len(r.text)
    assert ids("packing") == ids("pii")


def test_one_id_at_several_texts(spark):
    import corpus_pipeline as c

    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, text("y")), (5, text("y") + " more"), (5, text("x")), (9, text("x")), (7, text("z")), (7, text("z") + " end"), (8, " "), (8, " "), (8, "")]
    rows += [(None, text("y") + " again"), (None, text("w")), (None, text("w") + " end"), (None, text("v")), (None, ""), (None, "")]
    out = c.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = sorted(((r.doc_id, r.text) for r in out if r.doc_id != 7 and "w0" not in r.text), key=str)
    assert got == sorted([(3, text("y")), (5, text("x")), (8, " "), (8, ""), (None, text("v")), (None, "")], key=str)
    assert len([r for r in out if r.doc_id == 7]) == 1 and len([r for r in out if "w0" in r.text]) == 1


def test_stages_carry_columns_of_their_own_names(spark, tables):
    """Clashing names, a null text, an empty one and a long one pass each stage unharmed."""
    import corpus_pipeline as c

    long = "the mail of the house is a@b.example and so on " + " ".join(f"w{i} of" for i in range(40_000))
    rows = [(1, long, 7, "a", 1.5, True, "x"), (2, None, 7, "b", 2.5, False, "y"), (3, "", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __near int, __KEPT string, __rating double, __row boolean, __pii string")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tables))
        assert out.columns == docs.columns, name
        got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
        assert got.items() <= {r[0]: r[2:] for r in rows}.items() and (1 in got or name == "quality_classifier"), name
    assert c.STAGES[-1][1](spark, docs, str(tables)).where("doc_id = 1").agg({"size": "sum"}).first()[0] == len(long.split())


def test_the_classifier_bounds_its_batches(spark, tables):
    """Whole texts go to Python by 16 MB, not 64, also where no other stage ran before."""
    import corpus_pipeline as c

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    c.quality_classifier_stage(spark, spark.read.parquet(str(tables / "documents.parquet")), str(tables))
    assert spark.conf.get(name) == "16m"


def test_stages_alone_where_executors_lack_the_package(tables, tmp_path):
    """The second stage is the first that needs Python on the executors; here only the driver can import the repository."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import corpus_pipeline as c
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
docs = spark.read.parquet({str(tables / "documents.parquet")!r})
for name, stage in c.STAGES[:2]:
    docs = c.written(stage(spark, docs, {str(tables)!r}), name)
assert docs.count() == 42, docs.count()
"""
    cwd = tmp_path / "elsewhere"
    cwd.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and "SPARK" not in k} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_run_on_an_empty_table(spark, tables, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(str(tables / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tables / "labels.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op4_quality_rules", "op9_chat_format"])
def test_queries_equal_their_sql(spark, name):
    from tidesort.llm import queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.oracle_sql()[name]).fetch_df()
    got = queries.queries()[name](spark, str(DATA)).toPandas()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)
