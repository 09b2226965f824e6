"""Quality rules: one threshold table compiled into one Spark projection.

``measure`` adds the counts of a text (length, symbols, stop words, lines, repeated windows), ``verdict`` turns a table
of thresholds into a single boolean column.  Everything is a built-in column function: no user function, no shuffle, so
a hot source or a very long text costs its own length and nothing else.

Defined results: a null or empty text has no words and fails the length rule; other columns are carried through
untouched, also when their names look like ours (the measures live in one struct column); repeated rows are
judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesort.llm.spans import BLANK, BLANK_CHARS

SYMBOLS = r"[#*$%&|<>]"
#: Letters of other scripts than Latin.
OTHER_SCRIPT = r"[^\x00-\x{24F}\P{L}\p{IsLatin}]"
#: Frequent function words of the languages of the corpus, as they stand inside a sentence.
STOP_WORDS = (
    "the of to and in is it that for was on are as with he be by at this have from or an not which you a "
    "de la que el en y los se del las un por con una su para es al lo como más pero sus le "
    "et les des une du est dans qui au pour par sur pas plus ce avec sont "
    "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch zu"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; a rule holds where its bottom is 0 and for texts of fewer than ``from_words`` words.

    Where more than half of the words count in ``unless``, it holds as well.
    """

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    unless: str | None = None


#: Production thresholds.  They are read by :func:`verdict` alone; each line is one ratio of two measures.
TABLE = (
    Rule("word_length", "word_chars", "n_words", low=1.0, high=20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    # The list knows languages of Latin script alone, so texts mostly in other scripts are not judged by it.
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, from_words=50, unless="n_other_script"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def words_of(text: Column) -> Column:
    """Words between blanks; no words for an empty or blank text."""
    trimmed = F.trim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, f"{BLANK}+", -1))


def measure(df: DataFrame, text: str = "text", out: str = "quality", window: int = 5) -> DataFrame:
    """Adds struct ``out``: n_words, word_chars, n_symbols, n_stop_words, n_other_script, n_lines, n_dup_lines, n_repeat_words (long).

    Stop words count in any case; ``n_other_script`` counts words with a letter of another script than Latin.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    words, lines, hashes, ranked, places = "__q_words", "__q_lines", "__q_hashes", "__q_ranked", "__q_places"
    df = df.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__q_text"))
    df = df.withColumn(words, words_of(F.col("__q_text"))).withColumn(
        lines, F.filter(F.split(F.col("__q_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    n = F.size(words)
    # A window's hash is built by zipping shifted arrays: words to pairs, pairs to fours, then word by word.
    df = df.withColumn("__q_1", F.when(n >= window, F.transform(F.col(words), lambda w: F.xxhash64(w))))
    have = 1
    while have < window:
        more = have if 2 * have <= window else 1
        left, right = F.col(f"__q_{have}"), F.col(f"__q_{more}")
        length = F.size(right) - have
        df = df.withColumn(
            f"__q_{have + more}",
            F.when(n >= window, F.zip_with(F.slice(left, F.lit(1), length), F.slice(right, F.lit(have + 1), length), lambda a, b: F.xxhash64(a, b))),
        )
        have += more
    df = df.withColumn(hashes, F.col(f"__q_{have}"))
    # Where all windows differ, nothing is sorted; that is the case of nearly every clean text.
    df = df.withColumn(
        ranked,
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))),
        ),
    )
    size = F.size(ranked)
    r = F.col(ranked)
    df = df.withColumn(
        places,
        F.when(
            r.isNotNull(),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(1), size),
                        lambda k: (
                            ((k > 1) & (F.element_at(r, F.greatest(k - 1, F.lit(1)))["h"] == F.element_at(r, k)["h"]))
                            | ((k < size) & (F.element_at(r, F.least(k + 1, size))["h"] == F.element_at(r, k)["h"]))
                        ),
                    ),
                    lambda k: F.element_at(r, k)["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.col(places),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    stop = F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(*STOP_WORDS)))
    other = F.when(F.col("__q_text").rlike(OTHER_SCRIPT), F.size(F.filter(F.col(words), lambda w: w.rlike(OTHER_SCRIPT)))).otherwise(0)
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(F.col("__q_text"), F.lit(SYMBOLS)),
        "n_stop_words": stop,
        "n_other_script": other,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return df.select(*kept, F.struct(*(v.cast("long").alias(k) for k, v in counts.items())).alias(out))


def base_failed(q: Column) -> Column:
    """The fixed part of the verdict: too few words, or more than a fifth of the words in repeated windows."""
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def verdict(q: Column, table: tuple[Rule, ...] = TABLE) -> Column:
    """True where no rule of the table is broken: one boolean expression over the measures."""
    good = ~base_failed(q)
    for rule in table:
        top = q[rule.top].cast("double")
        bottom = q[rule.bottom].cast("double") if rule.bottom else F.lit(1.0)
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (top >= F.lit(rule.low) * bottom)
        if rule.high is not None:
            holds = holds & (top <= F.lit(rule.high) * bottom)
        if rule.unless:
            holds = holds | (2 * q[rule.unless] > q["n_words"])
        good = good & (holds | (bottom == 0) | (q["n_words"] < rule.from_words))
    return good


def apply_rules(df: DataFrame, text: str = "text", out: str = "quality", kept: str = "kept", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """All rows with the measures and the verdict; a filter on ``kept`` is the stage of a pipeline."""
    df = measure(df.drop(kept), text, out)
    return df.withColumn(kept, verdict(F.col(out), table))
