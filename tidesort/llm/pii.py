"""PII: candidate gradient boosting with built-in column functions alone.

High-recall generators propose spans, also overlapping ones: e-mail addresses, dotted quads, digit groups, international numbers,
spelled-out addresses, loose numbers, colon-separated addresses.  Boosted trees of depth two look at a candidate's format
(digits, separators, letters, checks) and context (neighbours, cue words).  Calibrated margins select what is redacted.
Candidates that pass the fixed rules of their kind are always selected; the trees add others that look like them.

The trees are fitted on candidates of at most ``max_rows`` rows (least hashed key).  A fixed rule labels its own generator.
The loose generators have no rule: what they propose outside the spans of the rules counts as negative, and their positives
are planted: the sampled texts a second time, each international number without its prefix, each address spelled out, each
dotted quad with colons, in the contexts in which they stand.  The features hold no verdict of a rule.  The executors count
candidates by feature cell; the driver boosts over all cells, or the ``max_cells`` most frequent if there are more.  A
quarter of the rows is held back for calibration, one generator at a time: pooled precision by margin, made monotone; a
generator's threshold is the least margin of precision ``precision``, and it adds nothing where no margin has that.  The trees
then stand as one array in a column expression.

Defined results: a null or empty text has no spans; other columns are carried through, except one named as ``out``;
repeated rows give repeated results; a very long text is searched whole, at a cost in proportion to its length; of chosen
candidates that overlap the one that starts first stays (ties: the one that ends first, then by name), and none that overlaps
a span of a rule; without any candidate to learn from nothing is added; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesort.llm.spans import BLOCK, empty_spans, joined, with_spans

#: Runs are taken whole (possessive), from their beginning or from the end of the last match: one pass over any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z])"
COLONS = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
ANY = r"[0-9@]|at[)\]}]"

BASE = ("email", "ip", "card", "phone")
GENERATORS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "spelled": SPELLED, "number": NUMBER, "colons": COLONS}
KINDS = tuple(GENERATORS)
CUES = r"(?i)(mail|phone|\btel|call|fax|mobile|card|visa|credit|account|iban|\bip\b|host|contact)[^\n]{0,20}$"
AROUND = 32
#: Stands before what is planted in training texts (word joiner, which no pattern takes).
PLANTED = "\u2060"
FEATURES = ("generator", "digits", "seps", "dots", "letters", "size", "at", "plus", "paren", "prev", "next", "cue")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.when((n > 0) & (n <= 40), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def octets(text: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    return F.forall(F.split(text, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(text, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255
    )


def passes(s: Column) -> Column:
    """The fixed rule of a candidate's kind; false for the loose generators."""
    n = F.length(_digits(s["text"]))
    return (
        F.when(s["kind"] == "email", True)
        .when(s["kind"] == "ip", octets(s["text"]))
        .when(s["kind"] == "card", n.between(16, 19) & luhn(_digits(s["text"])))
        .when(s["kind"] == "phone", n.between(8, 15))
        .otherwise(False)
    )


def _side(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 3).when(c.rlike(r"[\p{L}]"), 2).when(c.rlike(r"[\x20\x09-\x0D]"), 0).when(F.length(c) == 0, 0).otherwise(1)


def _features(s: Column) -> list[Column]:
    text, n = s["text"], F.length(s["text"])
    count = lambda cls: F.least(n - F.length(F.regexp_replace(text, cls, "")), F.lit(24))
    one = lambda c: c.cast("int")
    before = F.regexp_replace(s["before"], PLANTED + "$", "")
    values = {
        "generator": F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]),
        "digits": count("[0-9]+"),
        "seps": count(r"[\x20()./:-]+"),
        "dots": count(r"\.+"),
        "letters": count("[A-Za-z]+"),
        "size": F.least(n, F.lit(40)),
        "at": one(text.rlike(r"@|at[)\]}]")),
        "plus": one(text.startswith("+")),
        "paren": one(text.contains("(")),
        "prev": _side(F.substring(before, -1, 1)),
        "next": _side(F.substring(s["after"], 1, 1)),
        "cue": one(before.rlike(CUES)),
    }
    return [values[f].cast("int").alias(f) for f in FEATURES]


#: Columns of a tree as data: its split, then split and leaves of either side.
TREE = ("f", "at", "lf", "lat", "l0", "l1", "rf", "rat", "r0", "r1")


@dataclass(frozen=True)
class Tree:
    """A split, a split on either side, four leaves."""

    feature: str
    at: int
    left: tuple[str, int, float, float]
    right: tuple[str, int, float, float]

    def values(self, x: dict[str, np.ndarray]) -> np.ndarray:
        half = lambda part: np.where(x[part[0]] <= part[1], part[2], part[3])
        return np.where(x[self.feature] <= self.at, half(self.left), half(self.right))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    thresholds: dict[str, float]  # of the generators that may add spans

    def margin(self, x: Column) -> Column:
        """Margin of a candidate; ``x`` is the array of its features.  The trees are data, so the expression stays small."""
        place = lambda part: (FEATURES.index(part[0]) + 1, *part[1:])
        rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(TREE, (FEATURES.index(t.feature) + 1, t.at, *place(t.left), *place(t.right)), strict=True))) for t in self.trees]
        half = lambda t, side: F.when(F.element_at(x, t[f"{side}f"]) <= t[f"{side}at"], t[f"{side}0"]).otherwise(t[f"{side}1"])
        return F.aggregate(F.array(*rows), F.lit(self.start), lambda m, t: m + F.when(F.element_at(x, t["f"]) <= t["at"], half(t, "l")).otherwise(half(t, "r")))

    def chooses(self, s: Column) -> Column:
        """Whether the candidate ``s`` (with features ``x``) reaches its generator's threshold."""
        least = F.lit(None).cast("double")
        for kind, threshold in self.thresholds.items():
            least = F.when(s["kind"] == kind, F.lit(threshold)).otherwise(least)
        return F.coalesce(self.margin(s["x"]) >= least, F.lit(False))


def _split(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, on: np.ndarray, l2: float) -> tuple[float, str, int, float, float]:
    """Best split of the cells ``on``: (gain, feature, at, left leaf, right leaf)."""
    total_g, total_h = g[on].sum(), h[on].sum()
    leaf = lambda a, b: -a / (b + l2)
    best = (0.0, FEATURES[0], 10**6, leaf(total_g, total_h), 0.0)
    for name in FEATURES:
        v = x[name][on]
        if not len(v) or v.min() == v.max():
            continue
        low = int(v.min())
        gs, hs = np.cumsum(np.bincount(v - low, weights=g[on])), np.cumsum(np.bincount(v - low, weights=h[on]))
        gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
        at = int(gain[:-1].argmax())
        if gain[at] > best[0] + 1e-9:
            best = (float(gain[at]), name, at + low, leaf(gs[at], hs[at]), leaf(total_g - gs[at], total_h - hs[at]))
    return best


def boost(x: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 24, rate: float = 0.3, l2: float = 1.0) -> tuple[float, tuple[Tree, ...]]:
    """Gradient boosting of the logistic loss over weighted cells."""
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        everywhere = np.ones(len(y), bool)
        gain, name, at, *_ = _split(x, g, h, everywhere, l2)
        if gain <= 0:
            break
        low = x[name] <= at
        halves = []
        for on in (low, ~low):
            _, f, t, a, b = _split(x, g, h, on, l2)
            halves.append((f, int(t), float(rate * a), float(rate * b)))
        trees.append(Tree(name, int(at), *halves))
        margin = margin + trees[-1].values(x)
    return start, tuple(trees)


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float | None:
    """Least margin whose calibrated precision (pool adjacent violators) reaches ``precision``."""
    pools: list[list[float]] = []
    for m in np.unique(margin):
        at = margin == m
        pools.append([float(m), float((weight * y)[at].sum()), float(weight[at].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return next((m for m, a, b in pools if a >= precision * b), None)


def _candidates(df: DataFrame, text: str, carried: list[Column]) -> DataFrame:
    """``carried`` columns with __p_all: candidates of all generators."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*carried, F.when(body.rlike(ANY), body).otherwise(F.lit("")).alias("__p_text"))
    for kind, pattern in GENERATORS.items():
        df = with_spans(df, "__p_text", f"__p_{kind}", kind, pattern, AROUND)
    two = F.filter(F.col("__p_card"), lambda s: F.length(s["text"]) >= 7)  # short digit groups are nobody's data
    df = df.withColumn("__p_all", F.concat(*(two if k == "card" else F.col(f"__p_{k}") for k in KINDS)))
    return df.drop("__p_text", *(f"__p_{k}" for k in KINDS))


def planted(text: Column) -> Column:
    """Base spans in a form that only the loose generators know, each behind a mark."""
    text = F.regexp_replace(text, r"\+[0-9]{1,3}[\x20-]?(?=\(?[0-9]{2})", PLANTED)
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@(?=[A-Za-z0-9-]+\.)", PLANTED + "$1 (at) ")
    return F.regexp_replace(text, r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])", PLANTED + "$1:$2:$3:$4")


def train(df: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 20_000, max_cells: int = 20_000, precision: float = 0.95) -> Model:
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null")
    sample = rows.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_rows)
    # Two forms of each text: as it is, and with its base spans rewritten.
    forms = F.array(F.struct(F.lit(False).alias("twin"), F.col("t").alias("t")), F.struct(F.lit(True).alias("twin"), planted(F.col("t")).alias("t")))
    rows = rows.join(F.broadcast(sample), "k").where(F.col("t").rlike(ANY)).select("k", F.explode_outer(forms).alias("f"))
    found = _candidates(rows.select("k", "f.twin", F.col("f.t").alias("t")), "t", [F.pmod(F.xxhash64("k"), F.lit(4)).alias("fold"), F.col("twin")])
    good = F.filter("__p_all", passes)
    fair = F.filter(
        "__p_all",
        lambda s: F.when(F.col("twin"), ~s["kind"].isin(*BASE) & s["before"].endswith(PLANTED)).otherwise(
            s["kind"].isin(*BASE) | ~F.exists(F.col("__p_good"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ),
    )
    found = found.withColumn("__p_good", good).withColumn("__p_fair", F.when(F.size("__p_all") > 0, fair).otherwise(empty_spans(AROUND)))
    # The outer form: from a plain explode the optimizer infers filters and pushes them down through all of the steps above,
    # which writes their expressions out again and again.
    each = found.select("fold", "twin", F.explode_outer("__p_fair").alias("s")).where("s is not null")
    cells = each.select((F.col("fold") == 0).alias("held"), (F.col("twin") | passes(F.col("s"))).cast("int").alias("y"), *_features(F.col("s")))
    cells = cells.groupBy("held", "y", *FEATURES).agg(F.count("*").alias("w")).orderBy(F.desc("w"), "held", "y", *FEATURES).limit(max_cells)
    got = cells.collect()
    held = np.array([r["held"] for r in got], bool)
    y, w = np.array([r["y"] for r in got], float), np.array([r["w"] for r in got], float)
    x = {f: np.array([r[f] for r in got], np.int64) for f in FEATURES}
    if not (~held).any() or not held.any():
        return Model(0.0, (), {})
    fit = {f: v[~held] for f, v in x.items()}
    start, trees = boost(fit, y[~held], w[~held])
    seen = {f: v[held] for f, v in x.items()}
    margin = start + sum((t.values(seen) for t in trees), np.zeros(int(held.sum())))
    thresholds = {}
    for number, kind in enumerate(KINDS, 1):
        own = seen["generator"] == number
        if own.any() and (least := calibrate(np.round(margin[own], 9), y[held][own], w[held][own], precision)) is not None:
            thresholds[kind] = float(least) - 1e-9
    return Model(start, trees, thresholds)


def find_pii(df: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: array of (start, end, kind, text): candidates that pass their rule, and those the trees select."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    df = _candidates(df.withColumn("__p_body", F.col(f"`{text}`")), "__p_body", kept)
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))
    df = df.withColumn("__p_good", F.when(F.size("__p_all") > 0, F.filter(F.col("__p_all"), passes)).otherwise(empty_spans(AROUND)))
    if not model.thresholds or not model.trees:
        return df.select(*kept, F.transform("__p_good", plain).alias(out))
    # The others, in order of start, with their margins.
    rest = F.filter(F.col("__p_all"), lambda s: ~passes(s))
    df = df.withColumn("__p_rest", F.when(F.size("__p_all") > F.size("__p_good"), F.array_sort(F.transform(rest, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "text", "before", "after")), F.array(*_features(s)).alias("x"))))))
    chosen = F.filter(F.col("__p_rest"), model.chooses)
    chosen = F.filter(chosen, lambda s: ~F.exists(F.col("__p_good"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.withColumn("__p_more", F.when(F.col("__p_rest").isNotNull(), F.transform(chosen, plain)))
    apart = F.aggregate(
        F.col("__p_more"),
        F.struct(F.lit(0).alias("end"), empty_spans().alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return df.select(*kept, F.concat(F.transform("__p_good", plain), F.when(F.size("__p_more") > 0, apart).otherwise(empty_spans())).alias(out))


#: Texts are cut in blocks of so many code points, so that a piece is taken from the blocks it lies in and not from the whole text.
CUT = 2048


def _merged(spans: Column) -> Column:
    """(start, end, kind): overlapping spans as one, named after the first; by blocks, so results are not copied span by span."""
    kind = "array<struct<start:int,end:int,kind:string>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda k: F.slice(plain, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.expr("cast(null as struct<start:int,end:int,kind:string>)")

    def step(acc: Column, s: Column) -> Column:
        inside = F.coalesce(s["start"] < acc["open"]["end"], F.lit(False))
        wider = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], s["end"]).alias("end"), acc["open"]["kind"].alias("kind"))
        done = F.when(inside | acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        return F.struct(F.when(inside, wider).otherwise(s).alias("open"), done.alias("out"))

    def block(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["open"].alias("open"), F.expr(f"cast(array() as {kind})").alias("out")), step)
        return F.struct(own["open"].alias("open"), F.concat(acc["outs"], F.array(own["out"])).alias("outs"))

    start = F.struct(none.alias("open"), F.expr(f"cast(array() as array<{kind}>)").alias("outs"))
    return F.aggregate(blocks, start, block, lambda acc: F.concat(F.flatten(acc["outs"]), F.array(acc["open"])))


def redact(df: DataFrame, spans: str = "pii", text: str = "text") -> DataFrame:
    """``text`` with every span replaced by ``[kind]``; overlapping spans become one, named after the first.

    The cost follows the length of the text and the number of its spans.
    """
    df = df.withColumn("__r_spans", F.when(F.size(spans) > 0, _merged(F.col(spans))))
    df = df.withColumn("__r_blocks", F.when(F.size(spans) > 0, F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    blocks, cut, n = F.col("__r_blocks"), F.col("__r_spans"), F.size("__r_spans")

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, F.floor(b / CUT).cast("int") - first + 1), ""), a - first * CUT + 1, b - a)

    def replaced(i: Column) -> Column:
        before = F.when(i > 1, F.element_at(cut, F.greatest(i - 1, F.lit(1)))["end"]).otherwise(F.lit(0))
        return F.concat(piece(before, F.element_at(cut, i)["start"]), F.lit("["), F.element_at(cut, i)["kind"], F.lit("]"))

    whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), replaced), ""), piece(F.element_at(cut, -1)["end"], (F.size(blocks) * CUT).cast("int")))
    return df.withColumn(text, F.when(n > 0, whole).otherwise(F.col(f"`{text}`"))).drop("__r_spans", "__r_blocks")


def base_of(spans: Column) -> Column:
    """Base kinds are selected by the trees only under the names of other generators or by failing their rule."""
    return F.filter(spans, passes)


def text_of(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start."""
    return joined(spans, KINDS, by_kind=True)
