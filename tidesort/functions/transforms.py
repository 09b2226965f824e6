"""Value transforms that a run format would apply: they are projections here, after ordering and before dedup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commonly published eight-level binning of Phred+33 qualities, (first, last, bin).
QUALITY_BINS = ((0, 1, None), (2, 9, 6), (10, 19, 15), (20, 24, 22), (25, 29, 27), (30, 34, 33), (35, 39, 37), (40, 93, 40))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bin_alphabets() -> tuple[str, str]:
    """(characters, their bins) for ``translate``."""
    pairs = [(chr(33 + q), chr(33 + (q if level is None else level))) for first, last, level in QUALITY_BINS for q in range(first, last + 1)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def by_byte(value: Column | str, change: Callable[[Column], Column], kind: str = "string") -> Column:
    """``change`` on text that has one character for each byte of ``value``; the result has type ``kind``."""
    return F.encode(change(F.decode(_col(value).cast("binary"), "ISO-8859-1")), "ISO-8859-1").cast(kind)


def lossy_n(sequence: Column | str, kind: str = "string") -> Column:
    """Every byte but A, C, G, T (either case) becomes N, so the length stays."""
    return by_byte(sequence, lambda c: F.regexp_replace(c, "[^ACGTacgt]", "N"), kind)


def binned_quality(quality: Column | str, kind: str = "string") -> Column:
    """Other bytes than the binned ones stay as they are."""
    return by_byte(quality, lambda c: F.translate(c, *bin_alphabets()), kind)


def short_name(name: Column | str) -> Column:
    """The identifier: what stands before the first blank."""
    return F.substring_index(_col(name), " ", 1)


def description(name: Column | str) -> Column:
    """What stands behind the first blank; empty without one."""
    n = _col(name)
    at = F.locate(" ", n)
    return F.when(at > 0, F.substring(n, at + 1, F.length(n))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Format:
    """Which fields keep what.  ``exact`` and ``split`` lose nothing and change no value."""

    sequence: str = "raw"  # raw, exact, lossy_n
    quality: str = "raw"  # raw, binned, omit
    name: str = "raw"  # raw, split, omit
    block_records: int = 4096  # accepted; Spark sizes its own blocks

    def __post_init__(self) -> None:
        for value, allowed in ((self.sequence, {"raw", "exact", "lossy_n"}), (self.quality, {"raw", "binned", "omit"}), (self.name, {"raw", "split", "omit"})):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {sorted(allowed)}")

    @property
    def plain(self) -> bool:
        """Whether no value changes."""
        return self.sequence in ("raw", "exact") and self.quality == "raw" and self.name in ("raw", "split")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.sequence == "lossy_n":
            df = df.withColumn("sequence", lossy_n("sequence", df.schema["sequence"].dataType.simpleString()))
        if self.quality != "raw":
            df = df.withColumn("quality", binned_quality("quality", df.schema["quality"].dataType.simpleString()) if self.quality == "binned" else F.lit("").cast(df.schema["quality"].dataType))
        if self.name == "omit":
            df = df.withColumn("name", F.lit("").cast(df.schema["name"].dataType))
        return df


@dataclass(frozen=True)
class UserFormat:
    """A format of the user's own: ``change`` maps ordered rows to what a run of that format gives back.

    It must be a projection or a filter-free narrow function of rows (columns may be of any types, order and number of rows
    stay).  ``plain`` says that it changes no value, so that duplicates may be dropped before it.
    """

    change: Callable[[DataFrame], DataFrame]
    plain: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        return self.change(df)
