"""Byte scans and substring predicates.  Offsets and counts are bytes, as LongType; null in gives null out."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it (a lambda's variable)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_byte(c, byte: str) -> Column:
    """Occurrences of one ASCII character."""
    c = col(c)
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(byte), F.lit("")))).cast("long")


def count_newlines(c) -> Column:
    return count_byte(c, "\n")


def contains(c, needle: str) -> Column:
    return col(c).contains(needle)


def contains_char(c, char: str) -> Column:
    return col(c).contains(char)


def find_byte(c, byte: str) -> Column:
    """0-based byte offset of the first occurrence, or the length in bytes."""
    c = col(c)
    at = F.instr(c, byte)
    return F.when(at == 0, F.octet_length(c)).otherwise(F.octet_length(F.substring(c, F.lit(1), at - 1))).cast("long")


def starts_with(c, prefix: str) -> Column:
    return col(c).startswith(prefix)


def ends_with(c, suffix: str) -> Column:
    return col(c).endswith(suffix)
