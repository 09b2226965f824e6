"""Sort keys and derived keys as column expressions.

A derived key is a fixed-width binary column.  All of them are JVM-side compositions, evaluated inside a projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str | Callable[[DataFrame], Column]

# Widths, in bytes, of the packed keys for short, paired and long reads (four bases fit a byte), width of
# the name key, and the form of the packed key's tag.
ILLUMINA_WIDTH, PAIRED_END_WIDTH, LONG_READ_WIDTH = 38, 64, 128
NAME_WIDTH = 16
PACKED_TAG = "spill:seq2b:{:04d}"


def resolve(key: ColumnLike, df: DataFrame) -> Column:
    """A key may be a column, a column's name, or a function of the DataFrame."""
    if isinstance(key, str):
        return F.col(key)
    return key if isinstance(key, Column) else key(df)


def _text(c: Column | str) -> Column:
    """One character for each byte."""
    return F.decode((F.col(c) if isinstance(c, str) else c).cast("binary"), "ISO-8859-1")


def base_digits(sequence: Column | str, width: int) -> Column:
    """The first ``4 * width`` bases as digits 0 to 3 (A, C, G, T; case folded; anything else 0), padded with 0.

    Where only the order of packed keys is needed this string sorts the same way and is cheaper.
    """
    bases = 4 * width
    padded = 32 * -(-bases // 32)
    clean = F.regexp_replace(F.translate(F.substring(_text(sequence), 1, bases), "acgt", "ACGT"), "[^ACGT]", "A")
    return F.translate(F.rpad(clean, padded, "A"), "ACGT", "0123")


def packed_sequence_key(sequence: Column | str, width: int) -> Column:
    """Two bits a base, first base in the highest bits, ``width`` bytes: 32 digits become one 64-bit number each."""
    digits = base_digits(sequence, width)
    blocks = -(-4 * width // 32)
    words = [F.lpad(F.conv(F.substring(digits, 1 + 32 * i, 32), 4, 16), 16, "0") for i in range(blocks)]
    return F.substring(F.unhex(F.concat(*words)), 1, width)


def name_key(name: Column | str) -> Column:
    """First 16 bytes of a name, zero padded."""
    raw = F.col(name) if isinstance(name, str) else name
    return F.unhex(F.rpad(F.hex(F.substring(raw.cast("binary"), 1, NAME_WIDTH)), 2 * NAME_WIDTH, "0"))


def length_of(sequence: Column | str) -> Column:
    """Length in bytes."""
    return F.octet_length(F.col(sequence) if isinstance(sequence, str) else sequence).cast("long")


def length_key(sequence: Column | str) -> Column:
    """Length as eight bytes, highest first, so that byte order is numeric order."""
    return F.unhex(F.lpad(F.hex(length_of(sequence)), 16, "0"))


@dataclass(frozen=True)
class KeyKind:
    """A derived key with its width and a tag that is stored beside the column."""

    tag: str
    width: int
    derive: Callable[[DataFrame], Column]

    def attach(self, df: DataFrame, name: str = "key") -> DataFrame:
        return df.withColumn(name, self.derive(df)).withMetadata(name, {"key_tag": self.tag, "key_width": self.width})

    def decoded(self, key: Column | str) -> Column:
        """The key bytes again; a value of another width is an error."""
        raw = F.col(key) if isinstance(key, str) else key
        wrong = F.concat(F.lit(f"key {self.tag} must have {self.width} bytes, not "), F.octet_length(raw).cast("string"))
        return F.when(F.octet_length(raw) == self.width, raw).otherwise(F.raise_error(wrong).cast("binary"))


def packed_kind(width: int) -> KeyKind:
    return KeyKind(PACKED_TAG.format(width), width, lambda df: packed_sequence_key("sequence", width))


ILLUMINA_KEY, PAIRED_END_KEY, LONG_READ_KEY = map(packed_kind, (ILLUMINA_WIDTH, PAIRED_END_WIDTH, LONG_READ_WIDTH))
NAME_KEY = KeyKind("tide:name", NAME_WIDTH, lambda df: name_key("name"))
LENGTH_KEY = KeyKind("tide:length", 8, lambda df: length_key("sequence"))
