"""From raw documents to packed training sequences: five stages over the operators of ``tidesort.llm``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``docs``; other columns
than ``doc_id``, ``text`` and ``n_chars`` are carried through as they are, and any column may hold nulls.  Each sends the package
to the executors, so stages can also be called one by one, without the registered query.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesort.llm import ngram_join, ordinal, packing, pii, quality_rules
from tidesort.llm.graph import written
from tidesort.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


def _free(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _kept(df: DataFrame, verdict: str, columns: list[str]) -> DataFrame:
    """Rows with a true verdict.  The row number keeps the optimizer from writing the verdict's expression out below."""
    row = _free(df, "__row")
    marked = df.withColumn(row, F.monotonically_increasing_id())
    return marked.where(F.col(verdict) & (F.col(row) >= 0)).select(*(F.col(f"`{c}`") for c in columns))


@_shipped
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts; empty and null texts go."""
    rules, kept = _free(docs, "__rules"), _free(docs, "__kept")
    return _kept(quality_rules.apply_rules(docs, out=rules, kept=kept), kept, docs.columns)


@_shipped
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the cut of the model; the model learns from the rated raw documents.

    A null text is scored like an empty one; a null id or a tie changes nothing, as every row is judged by its text; repeated rows are
    judged alike; without ratings all stay; an empty table stays empty; columns of any names are carried through.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal.train(raw, ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rating = _free(docs, "__rating")
    rated = ordinal.score(docs, model, out=rating)
    return rated.where(F.col(f"{rating}.tails")[1] >= model.cut).select(*(F.col(f"`{c}`") for c in docs.columns))


@_shipped
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Groups are of rows, as one id may stand at different texts.  Rows without an id are grouped like others and stay only where
    no row of their group has an id.  Of blank rows that repeat both id and text one stays; texts are compared whole, however
    long; an empty table stays empty; columns of any names are carried through.
    """
    near = _free(docs, "__near")
    rows = written(docs.withColumn(near, F.monotonically_increasing_id()), "rows")
    found = written(ngram_join.join_documents(rows, ngram_join.Rule(width=5, least=80), key=near), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", near))[near].alias(near)
    named = found.where("n_shingles > 0").join(rows.select(near, "doc_id"), near).groupBy("component").agg(first).select(near)
    blank = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).groupBy("doc_id", "text").agg(F.min(near).alias(near)).select(near)
    gone = written(found.select(near).join(named.union(blank), near, "left_anti"), "gone")
    few = gone.limit(ngram_join.BROADCAST_ROWS + 1).count() <= ngram_join.BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, near, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


@_shipped
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by ``[kind]`` and ``n_chars`` counted anew.

    A null text stays null, an empty one empty; very long texts are redacted whole; of overlapping spans the first names the
    replacement; repeated rows are redacted alike, also those without an id; an empty table stays empty.
    """
    spans = _free(docs, "__pii")
    marked = pii.find_pii(docs, pii.train(docs), out=spans)
    clean = pii.redact(marked, spans=spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


@_shipped
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text lies: doc_id, piece, start, size, bin_id, bin_length, offset (in words).

    Null and blank texts have no piece; null ids and repeated rows are packed like others; longer texts are cut, none is shortened;
    an empty table gives no row.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fitted models and packing are not SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
