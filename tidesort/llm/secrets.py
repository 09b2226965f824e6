"""Secret scans: multipart credential linking with built-in column functions alone.

Strong spans (``assign``, ``access``, ``hex``) are always reported.  Weak candidates (``weak_secret``: mixed-case runs
with digits; ``weak_id``: named identifiers; ``endpoint``: addresses of services) say little alone.  Within a scope (a
block between blank lines) they are joined by interval: a secret to an identifier or endpoint of its scope, an identifier or
endpoint to a secret, at most ``reach`` code points away if a reach is given.  A weak candidate is reported when such a
complement exists.

The interval join is a sweep: the parts of a text lie in one array sorted by start; one pass forward and one
backward carry the nearest part of each role, and a blank line forgets them.  The nearest part decides whether any
part is within reach, so no pairs are made and the cost follows the number of parts.  Nothing is shuffled.

Defined results: a null or empty text has no spans; other columns are carried through, except one named as ``out``;
repeated rows give repeated results; a very long text is searched whole, at a cost in proportion to its length and its spans;
spans that start at one place are listed by kind; of equally near complements any confirms; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesort.llm.spans import SPAN, joined, with_spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of 20 (24) and more; a shorter run fails as a whole, and no part of it could pass.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WEAK_ID = r"""(?i:(?:client|access|account|tenant|user)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
ENDPOINT = r"""(?:https?|wss?|ftp|s3|amqps?|rediss?|mysql|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D"'<>]+"""
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
#: Every span has one of these; texts without them skip the other patterns.
ANY = r"[:=]|[A-Za-z0-9+/_-]{20}"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_secret", "weak_id", "endpoint")
#: Role of each kind in a credential.
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
NEEDS = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}


def _kinds(role: str) -> list[str]:
    return [k for k, r in ROLES.items() if r == role]


def _sweep(parts: Column, forward: bool, reach: int | None) -> Column:
    """For each part in order: whether a complement stands before it (``forward``) or after it, within reach and scope."""
    roles = ("id", "secret", "endpoint")
    state = F.struct(*(F.lit(None).cast("int").alias(r) for r in roles), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        edge, far = (s["start"], s["end"]) if forward else (s["end"], s["start"])
        near = {r: acc[r].isNotNull() if reach is None else F.coalesce((edge - acc[r] if forward else acc[r] - edge) <= reach, F.lit(False)) for r in roles}
        found = F.lit(False)
        for role in roles:
            found = found | (s["kind"].isin(_kinds(role)) & (near[NEEDS[role][0]] | (near[NEEDS[role][1]] if len(NEEDS[role]) > 1 else F.lit(False))))
        # ends may nest: the furthest end (first start on the way back) of a role is its nearest
        best = F.greatest if forward else F.least
        held = [F.when(s["kind"] == "break", F.lit(None)).when(s["kind"].isin(_kinds(r)), best(acc[r], far)).otherwise(acc[r]).alias(r) for r in roles]
        return F.struct(*held, F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", reach: int | None = None) -> DataFrame:
    """Adds ``out``: array of (start, end, kind, text), strong spans and the weak ones that a complement confirms."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select(*kept, F.when(body.rlike(ANY), body).otherwise(F.lit("")).alias("__s_text"))
    names = {}
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("weak_secret", WEAK_SECRET), ("weak_id", WEAK_ID), ("endpoint", ENDPOINT)):
        names[kind] = f"__s_{kind}"
        df = with_spans(df, "__s_text", names[kind], kind, pattern)
    strong = F.filter(F.col(names["assign"]), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    df = df.withColumn("__s_base", F.concat(strong, F.col(names["access"]), F.col(names["hex"])))
    mixed = F.filter(F.col(names["weak_secret"]), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Z]") & s["text"].rlike("[a-z]"))
    weak = F.concat(mixed, F.col(names["weak_id"]), F.col(names["endpoint"]))
    # a weak candidate that touches a strong span adds nothing, nor does a secret that is part of an address
    df = df.withColumn("__s_raw", weak).withColumn("__s_hold", F.concat(F.col("__s_base"), F.col(names["endpoint"])))
    overlaps = lambda w, s: (s["start"] < w["end"]) & (w["start"] < s["end"])
    clear = F.filter(
        F.col("__s_raw"),
        lambda w: ~F.exists(F.when(w["kind"] == "weak_secret", F.col("__s_hold")).otherwise(F.col("__s_base")), lambda s: overlaps(w, s)),
    )
    df = df.withColumn("__s_weak", F.when(F.size("__s_raw") > 0, clear).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))
    df = with_spans(df.withColumn("__s_scope", F.when(F.size("__s_weak") > 0, F.col("__s_text")).otherwise(F.lit(""))), "__s_scope", "__s_break", "break", BREAK)
    df = df.withColumn("__s_parts", F.when(F.size("__s_weak") > 0, F.array_sort(F.concat("__s_base", "__s_weak", "__s_break"))))
    df = df.withColumn("__s_before", F.when(F.size("__s_weak") > 0, _sweep(F.col("__s_parts"), True, reach)))
    df = df.withColumn("__s_after", F.when(F.size("__s_weak") > 0, F.reverse(_sweep(F.reverse("__s_parts"), False, reach))))
    linked = F.zip_with(
        F.col("__s_parts"),
        F.zip_with(F.col("__s_before"), F.col("__s_after"), lambda a, b: a | b),
        lambda s, yes: F.when(yes & s["kind"].isin("weak_secret", "weak_id", "endpoint"), s),
    )
    more = F.filter(linked, lambda s: s.isNotNull())
    return df.select(*kept, F.when(F.size("__s_weak") > 0, F.concat("__s_base", more)).otherwise(F.col("__s_base")).alias(out))


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def text_of(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    return joined(spans, KINDS, by_kind=False)
