"""Native (JVM-side) helpers for finding regular-expression spans with code-point offsets.

Spark's regular-expression functions return matched text but no offsets.  The offsets follow from the pieces
between the matches: ``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping matches, so the
running total of piece and match lengths gives every start and end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13.
BLANK = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\f\r"
SPAN = "struct<start:int,end:int,kind:string,text:string>"
#: Running totals are taken over blocks of this many matches, so that a text with very many matches costs
#: (matches x block) steps and not the square of its matches.
BLOCK = 256


def empty_spans(around: int = 0) -> Column:
    kind = SPAN.replace(">", ",before:string,after:string>") if around else SPAN
    return F.expr(f"cast(array() as array<{kind}>)")


def with_spans(df: DataFrame, text: str, out: str, kind: str, pattern: str, around: int = 0) -> DataFrame:
    """Adds ``out``: array of (start, end, kind, text) of each match of ``pattern`` in column ``text``.

    Offsets count code points, ends are exclusive.  The text must not be null.  Rows without a match pay one
    pass of the pattern; the second pass and the totals run for the others alone.  With ``around`` the spans also
    have ``before`` and ``after``: so many code points of context, as far as the next match of the same pattern.
    """
    hits, pieces, steps, blocks, bases = (f"__{out}_{x}" for x in ("hits", "pieces", "steps", "blocks", "bases"))
    lit = F.lit(pattern)
    df = df.withColumn(hits, F.regexp_extract_all(F.col(text), lit, F.lit(0)))
    df = df.withColumn(pieces, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)))

    def step_of(gap: Column, hit: Column, after: Column | None = None) -> Column:
        fields = [F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("text")]
        if after is not None:
            fields += [F.substring(gap, -around, around).alias("before"), F.substring(after, 1, around).alias("after")]
        return F.struct(*fields)

    n = F.size(hits)
    if around:
        paired = F.transform(F.sequence(F.lit(1), n), lambda i: step_of(F.element_at(F.col(pieces), i), F.element_at(F.col(hits), i), F.element_at(F.col(pieces), i + 1)))
    else:
        paired = F.zip_with(F.slice(F.col(pieces), F.lit(1), n), F.col(hits), lambda gap, hit: step_of(gap, hit))
    df = df.withColumn(steps, F.when(n > 0, paired))
    df = df.withColumn(
        blocks,
        F.when(
            F.size(hits) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                lambda k: F.slice(F.col(steps), k * BLOCK + 1, F.lit(BLOCK)),
            ),
        ),
    )
    df = df.withColumn(
        bases,
        F.when(
            F.size(hits) > 0,
            F.aggregate(
                F.col(blocks),
                F.array(F.lit(0)),
                lambda acc, block: F.concat(
                    acc,
                    F.array(
                        F.element_at(acc, -1)
                        + F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["size"])
                    ),
                ),
            ),
        ),
    )

    def within(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty_spans(around).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + s["gap"]
            end = begin + s["size"]
            context = [s["before"].alias("before"), s["after"].alias("after")] if around else []
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), *context)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, start, step, lambda acc: acc["out"])

    df = df.withColumn(
        out,
        F.when(
            F.size(hits) > 0,
            F.flatten(F.zip_with(F.col(blocks), F.slice(F.col(bases), F.lit(1), F.size(blocks)), within)),
        ).otherwise(empty_spans(around)),
    )
    return df.drop(hits, pieces, steps, blocks, bases)


def joined(spans: Column, order: Sequence[str], by_kind: bool) -> Column:
    """``kind:start:end`` of all spans, comma-joined; by start then kind, or (``by_kind``) by kind then start."""
    def key(s: Column) -> Column:
        rank = F.array_position(F.array(*map(F.lit, order)), s["kind"])
        first, second = (rank, s["start"].cast("long")) if by_kind else (s["start"].cast("long"), rank)
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("end"), s["start"].alias("start"), s["kind"].alias("kind"))

    rows = F.array_sort(F.transform(spans, key))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
