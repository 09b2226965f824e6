"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template.

``format_conversations`` gives one row per segment (header, body, footer of each turn) with its place; ``read_back`` takes the
text of the segments in that order, from any table and in any partitions, and parses it by the template's marks alone, which
is how the query proves that nothing is lost.  Both stream over rows sorted by conversation, so memory holds one batch of
rows, or one turn, and not a conversation, however many turns it has.

Defined results: a null text counts as empty, a null role as the role ``""``, which no state accepts; rows with a null
conversation id form one conversation; turns are ordered by turn (nulls first), ties by role and text; repeated rows
stay repeated; a conversation that the machine rejects is formatted all the same, with ``valid`` false; extra columns
are left out; a very long text is one segment; text that does not parse is an error; a role's line
break counts as its end; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles that carry loss, and the machine: state -> roles that may follow."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "START"
    follow: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "START": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    accept: frozenset[str] = frozenset({"assistant"})


CHATML = Template()
SEGMENTS = "conv_id long, turn_no long, place int, part string, text string, loss boolean, state_ok boolean, last boolean"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on: no control mark is left, and it can be undone."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _segments(frames: Iterator[pd.DataFrame], t: Template) -> Iterator[pd.DataFrame]:
    """One row of delay: a turn is emitted when the next row shows whether it was the last of its conversation."""
    held: tuple | None = None
    state, good, count = t.start, True, 0

    def emit(row: tuple, last: bool) -> list[tuple]:
        nonlocal state, good, count
        conv, role, text = row
        good = good and role in t.follow.get(state, ())
        state, loss = role, role in t.loss_roles
        ok = good and (not last or state in t.accept)
        out = [
            (conv, count, 0, "header", t.open + escape(role) + t.after_role, False, ok, False),
            (conv, count, 1, "body", escape(text), loss, ok, False),
            (conv, count, 2, "footer", t.close + t.after_turn, False, ok, last),
        ]
        count += 1
        if last:
            state, good, count = t.start, True, 0
        return out

    columns = [x.split()[0] for x in SEGMENTS.split(", ")]
    for frame in frames:
        rows: list[tuple] = []
        for conv, null, role, text in zip(frame["conv_id"], frame["no_id"], frame["role"], frame["text"], strict=True):
            row = (None if null else int(conv), role, text)
            if held is not None:
                rows += emit(held, held[0] != row[0])
            held = row
        if rows:
            yield _frame(rows, columns)
    if held is not None:
        yield _frame(emit(held, True), columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})


def format_conversations(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of all conversations, in order inside each partition; a conversation lies in one partition."""
    rows = df.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("conv_id").isNull().alias("no_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "no_id", "role", "text")
    return rows.mapInPandas(lambda frames: _segments(frames, template), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def parse_turn(text: str, t: Template) -> tuple[str, str] | None:
    """(role, text) of one formatted turn, still escaped; None where the marks are not in their places."""
    end = t.close + t.after_turn
    cut = text.find(t.after_role, len(t.open))
    if not text.startswith(t.open) or not text.endswith(end) or cut < 0 or cut + len(t.after_role) > len(text) - len(end):
        return None
    role, body = text[len(t.open) : cut], text[cut + len(t.after_role) : len(text) - len(end)]
    return None if "<|" in role or "<|" in body else (role, body)


def _digest(frames: Iterator[pd.DataFrame], t: Template) -> Iterator[pd.DataFrame]:
    """Parses the formatted text turn by turn, with running hashes; of the other columns it uses the loss mask alone."""
    empty = object()
    here: object = empty
    text, masked = [], []  # of the turn that is not complete yet
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = n_loss = n_chars = 0
    state, good = t.start, True

    def result() -> tuple:
        if text:
            raise ValueError(f"conversation {here}: the formatted text ends inside a turn")
        return here, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, good and state in t.accept

    for frame in frames:
        out: list[tuple] = []
        for conv, piece, under in zip(frame["conv_id"], frame["text"], frame["loss"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != here:
                if here is not empty:
                    out.append(result())
                here, state, good = conv, t.start, True
                turns, loss, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            n_chars += len(piece)
            text.append(piece)
            if under:
                masked.append(piece)
            if not piece.endswith(t.close + t.after_turn):
                continue
            found = parse_turn("".join(text), t)
            if found is None:
                raise ValueError(f"conversation {conv}: turn {n_turns} of the formatted text can't be parsed")
            role, plain, learned = unescape(found[0]), unescape(found[1]), unescape("".join(masked))
            text.clear()
            masked.clear()
            turns.update(f"{role}\n{plain}\n".encode())
            loss.update(learned.encode())
            n_turns, n_loss = n_turns + 1, n_loss + len(learned)
            good, state = good and role in t.follow.get(state, ()), role
        if out:
            yield _result(out)
    if here is not empty:
        yield _result([result()])


def _result(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation from the segments of :func:`format_conversations`, in whatever order and partitions they come."""
    rows = segments.select(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("no_id"), "conv_id", "turn_no", "place", "text", "loss")
    rows = rows.repartition("no_id", "id").sortWithinPartitions("no_id", "id", "turn_no", "place").select("conv_id", "text", "loss")
    return rows.mapInPandas(lambda frames: _digest(frames, template), DIGEST)
