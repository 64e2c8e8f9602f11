"""ASCII checks, case and trimming.  Only A-Z and a-z change case; other characters stay."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.scan import col

LOW, UP = string.ascii_lowercase, string.ascii_uppercase


def is_ascii(c) -> Column:
    """For valid UTF-8 strings: one byte per character."""
    return F.octet_length(col(c)) == F.char_length(col(c))


def is_ascii_bytes(c) -> Column:
    """For binary columns."""
    return ~F.decode(col(c), "ISO-8859-1").rlike(r"[^\x00-\x7F]")


def lowercase_ascii(c) -> Column:
    return F.translate(col(c), UP, LOW)


def uppercase_ascii(c) -> Column:
    return F.translate(col(c), LOW, UP)


def trim_ascii(c) -> Column:
    """Without leading and trailing space, tab, CR and LF."""
    return F.trim(col(c), F.lit(" \t\r\n"))
