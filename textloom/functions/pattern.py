"""Byte patterns with wildcards, compiled on the driver to regular expressions over Latin-1."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textloom.functions.scan import col


@dataclass(frozen=True)
class BytePattern:
    values: tuple[int, ...] = ()
    masks: tuple[int, ...] = ()

    @classmethod
    def parse(cls, text: str) -> BytePattern | None:
        """Hex bytes between spaces, two digits at a time; a token with ``?`` is any byte.  None if bad or empty."""
        if re.search(r"[^0-9A-Fa-f? ]", text):
            return None
        tokens = [t[i: i + 2] for t in text.split(" ") for i in range(0, len(t), 2)]
        if not tokens:
            return None
        return cls(tuple(0 if "?" in t else int(t, 16) for t in tokens), tuple(0 if "?" in t else 255 for t in tokens))

    @classmethod
    def from_bytes(cls, b: bytes) -> BytePattern:
        return cls(tuple(b), (255,) * len(b))

    @classmethod
    def from_masked(cls, b: bytes, masks: bytes) -> BytePattern:
        """Lengths that differ give the empty pattern; any mask but zero asks for the exact byte."""
        return cls(tuple(b), tuple(masks)) if len(b) == len(masks) else cls()

    def __len__(self) -> int:
        return len(self.values)

    @property
    def regex(self) -> str:
        return "(?s)" + "".join(f"\\x{v:02x}" if m else "." for v, m in zip(self.values, self.masks, strict=True))


def find_pattern(c, pattern: BytePattern) -> Column:
    """0-based byte offset of the first match, or null."""
    if not len(pattern):
        return F.lit(None).cast("long")
    at = F.regexp_instr(F.decode(col(c).cast("binary"), "ISO-8859-1"), F.lit(pattern.regex))
    return F.nullif(at.cast("long"), F.lit(0).cast("long")) - 1


def offsets_of(b: bytes, pattern: BytePattern | None) -> Iterator[int]:
    """All matches, overlapping ones too, in time linear in the text."""
    if pattern is None or not len(pattern):
        return iter(())
    ahead = re.compile(b"(?=" + b"".join(re.escape(bytes([v])) if m else b"." for v, m in zip(pattern.values, pattern.masks, strict=True)) + b")", re.S)
    return (m.start() for m in ahead.finditer(b))


def find_all_patterns(c, pattern: BytePattern) -> Column:
    """array<long> of the offsets of all matches, overlapping ones too."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else list(offsets_of(bytes(b), pattern)) for b in s], dtype=object)

    return run(col(c).cast("binary"))
