"""Connected components and working tables, shared by operators that link rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a folder of its own; on a cluster that would lose data, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("tidesort.work.dir", None)
        if not found:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="tidesort-")
            atexit.register(shutil.rmtree, found, True)
            spark.conf.set("tidesort.work.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of a batch of rows between the JVM and Python where rows can be long (both sides hold one or two a task).
BATCH = "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has chosen a size itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(name, BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends there, and any executor can read it.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidesort/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of more links than this are dealt over SALTS tasks, unless there are so many links that HEAVY nodes would exceed it.
LINKS, HEAVY, SALTS = 1000, 10_000, 64


def _with_low(e: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``e`` (a, b) with m and n of ``low`` (a, m, n: one row a node); nodes of very many links are salted.

    Heavy nodes have more than max(LINKS, total / HEAVY) of the ``total`` rows, so at most HEAVY are broadcast.
    """
    most = max(LINKS, total // HEAVY)
    heavy = low.where(F.col("n") > most).select("a", F.lit(SALTS).alias("salts"))
    deal = lambda df: df.join(F.broadcast(heavy), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = deal(e).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    right = deal(low).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("a", "salt", "m")
    return left.join(right, ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for each node of ``edges`` (a, b: long) the least node that links reach.

    Alternating large and small stars; a node of very many links is spread over tasks in the joins and combined before the
    shuffle in the minima.  Each round's edges are written to the shared folder.
    """
    shared_dir(edges.sparkSession)

    def mark(e: DataFrame) -> tuple[int, int]:
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        return int(row["n"]), int(row["s"])

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_low(both, low, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, 2 * before[0])
        e = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("b").agg(F.lit(1).alias("x")).select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
