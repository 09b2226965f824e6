"""Sequencing records: name, sequence and quality as bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

FIELDS = ("name", "sequence", "quality")
SCHEMA = StructType([StructField(f, BinaryType(), False) for f in FIELDS])


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Records from (name, sequence, quality) of bytes or text."""
    return spark.createDataFrame([tuple(bytearray(_bytes(x)) for x in r) for r in rows], SCHEMA)


def as_records(df: DataFrame, name: Column | str = "name", sequence: Column | str = "sequence", quality: Column | str = "quality", keep: Iterable[str] = (), validate: bool = False) -> DataFrame:
    """Maps columns to a record's fields; text and bytes are both taken.  ``validate``: lengths must agree unless the quality is empty."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(column(name).alias("name"), column(sequence).alias("sequence"), column(quality).alias("quality"), *keep)
    if validate:
        n, m = F.octet_length("sequence"), F.octet_length("quality")
        bad = F.concat(F.lit("sequence and quality differ in length: "), n.cast("string"), F.lit(" and "), m.cast("string"))
        out = out.withColumn("sequence", F.when((m == 0) | (n == m), F.col("sequence")).otherwise(F.raise_error(bad)))
    return out


def as_struct(name: Column, sequence: Column, quality: Column) -> Column:
    return F.struct(name.cast("binary").alias("name"), sequence.cast("binary").alias("sequence"), quality.cast("binary").alias("quality"))


def record_bytes() -> Column:
    """Bytes of the three fields."""
    return sum((F.octet_length(f) for f in FIELDS[1:]), F.octet_length("name")).cast("long")


# Text fixtures over ``lineitem``; {S} is the engine's name for text, so Spark and DuckDB make the same rows.
READS_SQL = """
SELECT concat('read_', cast(l_orderkey AS {S}), '_', cast(l_linenumber AS {S})) AS name,
  substr(translate(concat(md5(cast(l_partkey%500 AS {S})), md5(cast(l_partkey%500+1000 AS {S})), md5(cast(l_partkey%500+2000 AS {S})), md5(cast(l_partkey%500+3000 AS {S})), md5(cast(l_partkey%500+4000 AS {S}))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 150) AS sequence,
  substr(translate(concat(md5(cast(l_orderkey*8+l_linenumber AS {S})), md5(cast(l_orderkey*8+l_linenumber+1 AS {S})), md5(cast(l_orderkey*8+l_linenumber+2 AS {S})), md5(cast(l_orderkey*8+l_linenumber+3 AS {S})), md5(cast(l_orderkey*8+l_linenumber+4 AS {S}))), '0123456789abcdef', '!#%&*+-5:;<=?AEI'), 1, 150) AS quality,
  l_linenumber, l_partkey
FROM lineitem
"""
MIXED_SQL = """
SELECT name,
  substr(CASE WHEN l_linenumber=3 THEN concat(substr(sequence,1,4),'N',substr(sequence,6)) WHEN l_linenumber=5 THEN lower(sequence) ELSE sequence END, 1, cast(20+l_partkey%131 AS int)) AS sequence,
  substr(quality, 1, cast(20+l_partkey%131 AS int)) AS quality
FROM reads
"""
