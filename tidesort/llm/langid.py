"""Language ID: script ranges narrow the candidates, Viterbi with a switching penalty labels spans of words.

A word's score for a language is the log-probability of its hashed letter windows (one to three letters, word ends
included) under that language, taken against the best candidate and bounded below, so that one odd word cannot decide
a text.  Languages that don't use the word's script are no candidates.  The best path over the words of a text, where
each change of language costs ``penalty``, labels every word; runs of one label are the spans, and the label that
covers most letters is the text's language.

Learned counts come from about ``max_rows`` rows of each language (those whose hashed key is least); whole texts of
these rows are counted on the executors, and the driver receives one number for each language and window bucket.
Every language that occurs is learned; the model takes 128 KiB for each.  Every text is predicted whole.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the language that sorts
first; with nothing to learn from, everything is ``und``; repeated rows are labelled alike; other columns are carried
through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
CACHE = 300_000
#: Words (times languages) whose path is found at once.
CELLS = 8_000_000
#: First code points of the scripts, in order; a letter belongs to the last range that begins before it.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_NAME = np.array([NAMES.index(n) for _, n in SCRIPTS])


def letters(token: str) -> str:
    """The letters of a token, lower case."""
    low = token.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


def windows(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each letter window of one to three code points, word ends counting as one code point."""
    points = np.frombuffer("".join(f"\n{w}" for w in words).encode("utf-32-le") + b"\n\0\0\0", np.uint32).astype(np.uint64)
    edge = points == 10
    word = np.cumsum(edge) - 1
    where, buckets = [], []
    hashed = np.zeros(len(points), np.uint64)
    for n in (1, 2, 3):
        m = len(points) - n + 1
        hashed = hashed[:m] * np.uint64(0x100000001B3) + (points[n - 1 :] + np.uint64(7919 * n)) * np.uint64(0x9E3779B97F4A7C15)
        # A single code point must be a letter; a word end may stand first or last, but not inside.
        use = ~edge if n == 1 else np.ones(m, bool) if n == 2 else ~edge[1:-1]
        at = np.flatnonzero(use)
        where.append(word[at])
        buckets.append((hashed[at] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(where), np.concatenate(buckets)


def script_of(words: list[str]) -> np.ndarray:
    """Script (a place in NAMES) of each word's first letter."""
    return _NAME[np.searchsorted(_FIRST, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # (bucket, language): log-probability
    allowed: np.ndarray  # (script, language): the language uses the script
    penalty: float = 6.0
    floor: float = -8.0


class Words:
    """Token -> row of scores; row 0 is for tokens without letters."""

    def __init__(self, model: Model):
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1, len(self.m.langs)), np.float32)
        self.letters = np.zeros(1, np.int64)

    def rows(self, tokens: set[str]) -> None:
        if len(self.index) > CACHE:
            self.clear()
        new = [t for t in tokens if t not in self.index]
        words = [letters(t) for t in new]
        for t, w in zip(new, words, strict=True):
            if not w:
                self.index[t] = 0
        pairs = [(t, w) for t, w in zip(new, words, strict=True) if w]
        if not pairs:
            return
        kept = [w for _, w in pairs]
        word, bucket = windows(kept, int(np.log2(len(self.m.table))))
        total = np.stack([np.bincount(word, weights=self.m.table[bucket, j], minlength=len(kept)) for j in range(len(self.m.langs))], axis=1)
        may = self.m.allowed[script_of(kept)]
        may = may | ~may.any(axis=1, keepdims=True)
        total = np.where(may, total, -np.inf)
        total = np.maximum(total - total.max(axis=1, keepdims=True), self.m.floor)
        for k, (t, _) in enumerate(pairs):
            self.index[t] = len(self.scores) + k
        self.scores = np.concatenate([self.scores, total.astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, kept), np.int64, len(kept))])


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of many texts at once; ``scores`` holds the texts one after another, ``sizes`` their words."""
    n, k = scores.shape
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts that have a word at each step
    stay = np.ones((n, k), bool)
    origin = np.zeros(n, np.int16)
    value = scores[first[: live[0]]].astype(np.float32) if longest else None
    last = np.zeros(len(sizes), np.int64)
    for t in range(1, longest):
        m = live[t]
        if m < len(value):
            last[m : len(value)] = value[m:].argmax(axis=1)
            value = value[:m]
        at = first[:m] + t
        best = value.argmax(axis=1)
        moved = value[np.arange(m), best] - np.float32(penalty)
        keep = value >= moved[:, None]
        stay[at], origin[at] = keep, best
        value = np.where(keep, value, moved[:, None]) + scores[at]
    if longest:
        last[: len(value)] = value.argmax(axis=1)
    out = np.zeros(n, np.int16)
    state = last
    for t in range(longest - 1, -1, -1):
        m = live[t]
        at, own = first[:m] + t, state[:m]
        out[at] = own
        state[:m] = np.where(stay[at, own], own, origin[at])
    return out


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", max_rows: int = 3000, bits: int = BITS, penalty: float = 6.0) -> Model:
    """Counts windows in about ``max_rows`` rows of each language of ``docs``; rows without language or text teach nothing."""
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("k is not null and lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = tuple(sorted(r["lang"] for r in found))
    if not langs:
        return Model((), np.zeros((1 << bits, 0)), np.zeros((len(NAMES), 0), bool), penalty)
    # A row is in the sample when its hash falls below its language's share: no sort, no shuffle of rows.
    share = F.create_map(*(x for r in found for x in (F.lit(r["lang"]), F.lit(int(min(1.0, max_rows / r["n"]) * (1 << 30))))))
    chosen = rows.where(F.col("lang").isin(*langs) & (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), (1 << bits) + len(NAMES)), np.int32)
        place = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w for t in body.split() if (w := letters(t))]
                if words:
                    total[place[name], : 1 << bits] += np.bincount(windows(words, bits)[1], minlength=1 << bits)
                    total[place[name], 1 << bits :] += np.bincount(script_of(words), minlength=len(NAMES))
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[row, bucket].astype(np.int64))], ["l", "b", "n"])

    got = chosen.select("lang", "text").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), (1 << bits) + len(NAMES)))
    counts[got["l"], got["b"]] = got["n"]
    grams, scripts = counts[:, : 1 << bits] + 0.5, counts[:, 1 << bits :]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    allowed = (scripts >= 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T & (scripts.T > 0)
    return Model(langs, np.ascontiguousarray(table), allowed, penalty)


LABELS = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans): spans are runs of words (white-space tokens, end exclusive) of one language."""
    if not model.langs:
        none = F.expr("cast(array() as array<struct<start:int,end:int,lang:string>>)")
        return docs.select(F.col(f"`{key}`"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words, k = Words(m), len(m.langs)
        for batch in batches:
            langs, scores, spans = [], [], []
            for tokens in _groups(batch.column(1).to_pylist(), CELLS // k):
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                words.rows({t for own in tokens for t in own})
                get = words.index.__getitem__
                index = np.fromiter((get(t) for own in tokens for t in own), np.int64, int(sizes.sum()))
                path = viterbi(words.scores[index], sizes, m.penalty)
                weight = words.letters[index]
                doc = np.repeat(np.arange(len(tokens)), sizes)
                cover = np.bincount(doc * k + path, weights=weight, minlength=len(tokens) * k).reshape(len(tokens), k)
                total, best = cover.sum(axis=1), cover.argmax(axis=1)
                ends = np.cumsum(sizes)
                turn = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]) if len(path) else np.zeros(0, np.int64)
                cut = np.searchsorted(turn, np.r_[0, ends])
                for i, n in enumerate(sizes):
                    if not total[i]:
                        langs.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    langs.append(m.langs[best[i]])
                    scores.append(float(cover[i, best[i]] / total[i]))
                    own, base = turn[cut[i] : cut[i + 1]], ends[i] - n
                    stops = np.r_[own[1:], ends[i]] - base
                    spans.append([{"start": int(a - base), "end": int(b), "lang": m.langs[path[a]]} for a, b in zip(own, stops, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], [key, "lang_pred", "score", "spans"])

    rows = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {LABELS}")


def _groups(texts: list[str], most: int) -> Iterator[list[list[str]]]:
    """Texts as tokens, in groups of at most ``most`` tokens (a longer text is a group of its own)."""
    group: list[list[str]] = []
    held = 0
    for x in texts:
        own = x.split()
        if group and held + len(own) > most:
            yield group
            group, held = [], 0
        group.append(own)
        held += len(own)
    if group:
        yield group
