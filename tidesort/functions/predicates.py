"""Predicates over records; byte equality, nulls equal to nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: str, b: str, *fields: str) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def has_same_name(a: str, b: str) -> Column:
    return _same(a, b, "name")


def has_same_sequence(a: str, b: str) -> Column:
    return _same(a, b, "sequence")


def has_same_sequence_and_quality(a: str, b: str) -> Column:
    return _same(a, b, "sequence", "quality")


def sequence_len(sequence: str = "sequence") -> Column:
    return F.octet_length(sequence).cast("long")


def is_empty(sequence: str = "sequence") -> Column:
    """A record is empty when its sequence is."""
    return F.octet_length(sequence) == 0
