"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(t_k - w.x)`` with one weight vector ``w`` over hashed text features shared by all grades and
ordered thresholds ``t_0 < t_1 < ...``.  The model gives the expected grade and the probability of the tail
(``grade >= k``), by which rows are selected.

Features of a text are hashed counts of its words (letters only, lower case), of their first 4 to 7 letters (a stem
stands under many endings), of the shapes of its tokens (case, digits, trailing marks), of immediate repetitions, and a
bucket of its length; counts enter as log(1 + n), whatever the text's length, so one word weighs the same in any text.
The model uses the ``most`` features whose presence depends most on the grade (G statistic, ``least_g`` at least), of
those that ``min_rows`` of the rated rows have.

Rows are selected by ``Model.cut``, a bound for the probability of the top grade: it is chosen on a fifth of the rated
rows, with a model of the others, to keep the share ``keep`` of the top grade and as few of the lower grades as that allows.

The model is fitted on the driver on at most ``max_rows`` rated rows (those whose hashed id is least, so the sample is
the same on every run).  The executors count features by grade, the driver chooses the used ones and gets those alone for
each row.  Every row of the table is scored.

Defined results: a null or empty text has the length bucket as its only feature; rows without a rating, with a null id
or with a null rating are not learned from, several ratings of one id count as their least; without any rating all
rows get the top grade; repeated rows are scored alike; a very long text is read whole, by blocks; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesort.llm.graph import bounded_batches, written

BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Words of a text that are held at once; features of longer texts are added up over blocks.
BLOCK = 200_000
CACHE = 300_000
_MARKS = re.compile(r"[^\W\d_]+")


class Features:
    """Token -> its features (word, shape, prefixes), with a bounded cache; one per worker task.

    Given ``known`` (feature -> whether it is used), words, shapes and prefixes that are not used are left out.
    """

    def __init__(self, bits: int = BITS, known: np.ndarray | None = None):
        self.size, self.known = 1 << bits, known
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.table = np.full((1024, 2 + len(PREFIXES)), -1, np.int64)
        self.same = np.zeros(1024, np.int64)  # word and shape in one number

    def bucket(self, text: str) -> int:
        return crc32(text.encode()) & (self.size - 1)

    def _token(self, token: str) -> int:
        word = "".join(_MARKS.findall(token))
        case = "-" if not word else "a" if word.islower() else "A" if word.isupper() else "Aa" if word[0].isupper() else "m"
        digits = "9" if any(c.isdigit() for c in token) else ""
        tail = "".join(c for c in token[-3:] if not c.isalnum())
        low = word.lower()
        found = [self.bucket("w:" + low), self.bucket(f"s:{case}{digits}{tail}"), *(self.bucket("p:" + low[:k]) if len(low) > k else -1 for k in PREFIXES)]
        at = len(self.cache)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.same = np.concatenate([self.same, np.zeros_like(self.same)])
        self.same[at] = found[0] << 32 | found[1]
        self.table[at] = found if self.known is None else [f if f >= 0 and self.known[f] else -1 for f in found]
        self.cache[token] = at
        return at

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, log(1 + count)) of all texts, sorted by row and feature."""
        if len(self.cache) > CACHE:
            self.clear()
        keys, counts = [], []
        group: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not group:
                return
            sizes = np.fromiter((len(w) for _, w in group), np.int64, len(group))
            row = np.repeat(np.fromiter((i for i, _ in group), np.int64, len(group)), sizes) << 32
            get, make = self.cache.get, self._token
            index = np.fromiter((p if (p := get(w)) is not None else make(w) for _, words in group for w in words), np.int64, int(sizes.sum()))
            mark = self.same[index]
            again = np.flatnonzero((mark[1:] == mark[:-1]) & (row[1:] == row[:-1]))
            token, times = np.unique(row | index, return_counts=True)
            found = self.table[token & 0xFFFFFFFF]
            on = found >= 0
            found = np.concatenate([((token >> 32 << 32)[:, None] | found)[on], row[again] | self.bucket("r:")])
            key, at = np.unique(found, return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(at, weights=np.concatenate([np.repeat(times, on.sum(axis=1)), np.ones(len(again), np.int64)]), minlength=len(key)))
            group.clear()
            held = 0

        length = []
        for i, text in enumerate(texts):
            words = text.split()
            length.append(i << 32 | self.bucket(f"l:{len(words).bit_length()}"))
            for k in range(0, len(words), BLOCK):
                part = words[k : k + BLOCK]
                group.append((i, part))
                held += len(part)
                if held >= BLOCK:
                    flush()
        flush()
        keys.append(np.array(length, np.int64))
        counts.append(np.ones(len(length), np.int64))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.log1p(np.bincount(at, weights=np.concatenate(counts), minlength=len(key)))
        return key >> 32, key & 0xFFFFFFFF, value


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    known: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    cut: float = 0.5

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        on = self.known[feature]
        row, feature, value = row[on], feature[on], value[on]
        return np.bincount(row, weights=value * self.weights[feature], minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def seen_by_grade(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, bits: int) -> np.ndarray:
    """(feature, grade): how many rows of the grade have the feature."""
    return np.stack([np.bincount(feature[(grade == j)[row]], minlength=1 << bits) for j in range(grades)], axis=1)


def associated(feature: np.ndarray, has: np.ndarray, rows: np.ndarray, bits: int, min_rows: int = 5, least_g: float = 20.0, most: int = 2000) -> np.ndarray:
    """Feature -> whether it is used: the ``most`` with the largest G of (has the feature, grade).

    ``has``: rows of each grade that have ``feature``; ``rows``: rows of each grade.
    """
    on = has.sum(axis=1) >= min_rows
    used, has, rows = feature[on], has[on].astype(float), rows.astype(float)
    share = has.sum(axis=1, keepdims=True) / max(1.0, rows.sum())
    g = np.zeros(len(used))
    for seen, expected in ((has, share * rows), (rows - has, (1 - share) * rows)):
        g += 2 * (seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))).sum(axis=1)
    best = np.lexsort((used, -g))[:most]
    known = np.zeros(1 << bits, bool)
    known[used[best[g[best] >= least_g]]] = True
    return known


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, bits: int = BITS, min_rows: int = 5, l2: float = 1e-4, steps: int = 300, rate: float = 0.1, least_g: float = 20.0, most: int = 2000, known: np.ndarray | None = None) -> Model:
    """Full-batch Adam on the mean negative log-likelihood; thresholds stay ordered as a first one plus positive gaps.

    Features are centred (their means go into the thresholds), and the step falls to zero, so the fit settles.
    """
    n, k = len(grade), grades - 1
    if known is None:
        has = seen_by_grade(row, feature, grade, grades, bits)
        known = associated(np.arange(1 << bits), has, np.bincount(grade, minlength=grades), bits, min_rows, least_g, most)
    on = known[feature]
    row, feature, value = row[on], feature[on], value[on].astype(np.float64)
    used, at = np.unique(feature, return_inverse=True)
    mean = np.bincount(at, weights=value, minlength=len(used)) / n
    w, free = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(k - 1)])
    m, v = np.zeros(len(used) + k), np.zeros(len(used) + k)
    for step in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(row, weights=value * w[at], minlength=n) - mean @ w
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _cdf(edge[grade + 1] - score), _cdf(edge[grade] - score)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        slope = d_hi - d_lo
        g_w = np.bincount(at, weights=value * slope[row], minlength=len(used)) - mean * slope.sum() + l2 * w
        g_theta = np.array([-d_hi[grade == j].sum() + d_lo[grade == j + 1].sum() for j in range(k)])
        g_free = np.array([g_theta.sum(), *(np.exp(free[j]) * g_theta[j:].sum() for j in range(1, k))])
        g = np.concatenate([g_w, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[:-k], free - move[-k:]
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    return Model(weights, known, theta + mean @ w, bits)


def choose_cut(score: np.ndarray, top: np.ndarray, keep: float) -> float:
    """A score that the share ``keep`` of the rows of grade ``top`` reaches, in the middle of the gap below those rows."""
    good, rest = np.sort(score[top]), score[~top]
    if not len(good):
        return 0.0
    least = good[min(len(good) - 1, int((1 - keep) * len(good)))]
    below = rest[rest < least]
    return float((least + below.max()) / 2) if len(below) else float(min(0.0, least))


def fit_with_cut(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, held: np.ndarray, known: tuple[np.ndarray, np.ndarray], grades: int, bits: int = BITS, keep: float = 0.99) -> Model:
    """The model of all rows; its cut comes from the rows ``held`` and a model of the others.

    ``known``: the features of the model of the others, and of the model of all.
    """
    place = np.where(held, np.cumsum(held), np.cumsum(~held)) - 1
    cut = 0.5
    if held.any() and not held.all():
        on = ~held[row]
        part = fit(place[row[on]], feature[on], value[on], grade[~held], grades, bits, known=known[0])
        on = ~on
        seen = part.score(place[row[on]], feature[on], value[on], int(held.sum())) - part.thresholds[-1]
        cut = float(_sigmoid(np.array(choose_cut(seen, grade[held] == grades - 1, keep))))
    return replace(fit(row, feature, value, grade, grades, bits, known=known[1]), cut=cut)


def _cdf(x: np.ndarray) -> np.ndarray:
    out = np.where(x > 0, 1.0, 0.0)
    ok = np.isfinite(x)
    out[ok] = _sigmoid(x[ok])
    return out


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", grades: int = 3, max_rows: int = 12_000, key: str = "doc_id", text: str = "text", bits: int = BITS) -> Model:
    """Fits on at most ``max_rows`` rated rows of ``docs``; ``ratings`` has (key, grade from 0 to grades - 1)."""
    bounded_batches(docs.sparkSession)
    rated = ratings.select(F.col(f"`{key}`").alias("k"), F.col(f"`{grade}`").cast("int").alias("g")).where("k is not null and g is not null")
    rated = rated.where((F.col("g") >= 0) & (F.col("g") < grades)).groupBy("k").agg(F.min("g").alias("g"))
    sample = rated.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "k")
    rows = rows.groupBy("k", "g").agg(F.min("text").alias("text"))
    key_text = F.col("k").cast("string")
    rows = rows.select(key_text.alias("k"), "g", (F.crc32(key_text) % 5 == 4).alias("held"), "text")
    # The sample is bounded, so a task for each thousand rows is enough, however many partitions a shuffle has.
    rows = written(rows.coalesce(max_rows // 1000 + 1), "rated")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(bits), np.zeros((2 * grades, (1 << bits) + 1), np.int32)
        for batch in batches:
            cell = batch.column("g").to_numpy() + grades * batch.column("held").to_numpy(zero_copy_only=False)
            for k in range(0, batch.num_rows, 256):
                row, feature, _ = features.rows(batch.column("text").slice(k, 256).to_pylist())
                np.add.at(total, (cell[k : k + 256][row], feature), 1)
            np.add.at(total, (cell, 1 << bits), 1)  # the rows themselves
        cell, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[cell, feature].astype(np.int64))], ["f", "cell", "n"])

    # What comes to the driver: counts of features that enough rows have, then the used features of each row.
    cells = [F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).cast("int").alias(f"n{c}") for c in range(2 * grades)]
    counted = rows.mapInArrow(count, "f int, cell int, n long").groupBy("f").agg(*cells, F.sum("n").alias("n"))
    got = counted.where((F.col("n") >= 5) | (F.col("f") == 1 << bits)).drop("n").toArrow()
    if not got.num_rows:
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool), np.full(grades - 1, -40.0), bits)
    feature, has = got.column("f").to_numpy(), np.stack([got.column(f"n{c}").to_numpy() for c in range(2 * grades)], axis=1)
    total, feature, has = has[feature == 1 << bits][0], feature[feature < 1 << bits], has[feature < 1 << bits]
    both = [associated(feature, h, n, bits) for h, n in ((has[:, :grades], total[:grades]), (has[:, :grades] + has[:, grades:], total[:grades] + total[grades:]))]
    known = both[0] | both[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits, known)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, feature, value = features.rows(part.column("text").to_pylist())
                on = known[feature]
                row, feature, value = row[on], feature[on], value[on]
                edge = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("g"), part.column("held"), pa.ListArray.from_arrays(edge, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32)))],
                    ["k", "g", "held", "f", "v"],
                )

    got = rows.mapInArrow(run, "k string, g int, held boolean, f array<int>, v array<float>").toArrow().sort_by("k")
    feature, value = got.column("f").combine_chunks(), got.column("v").combine_chunks().flatten().to_numpy()
    sizes, feature, grade_of = feature.value_lengths().to_numpy(), feature.flatten().to_numpy(), got.column("g").to_numpy()
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return fit_with_cut(row, feature, value, grade_of, got.column("held").to_numpy(), (both[0], both[1]), grades, bits)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "rating") -> DataFrame:
    """All rows and columns of ``docs`` with struct ``out``: expected (grade), tails (array: P(grade >= 1), ...)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.known, model.thresholds))
    bits = model.bits

    @F.pandas_udf("expected double, tails array<double>")
    def rate(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, features = Model(*sent.value, bits), Features(bits, sent.value[1])
        for texts in frames:
            total = np.zeros(len(texts))
            for k in range(0, len(texts), 256):
                part = texts.iloc[k : k + 256].tolist()
                total[k : k + len(part)] = m.score(*features.rows(part), len(part))
            tails = m.tails(total)
            yield pd.DataFrame({"expected": tails.sum(axis=1), "tails": list(tails)})

    return docs.withColumn(out, rate(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
