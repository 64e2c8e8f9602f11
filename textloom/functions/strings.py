"""Lines, splitting, trimming and replacing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.scan import col

SPACE = " \t\n\r\f\x0b"


def _quoted(d: str) -> str:
    return "".join(f"\\{x}" if not x.isalnum() and x.isascii() and x.isprintable() else x for x in d)


def split_vec(c, delimiter: str) -> Column:
    """All segments, empty ones too; the empty string has one."""
    return F.split(col(c), _quoted(delimiter), -1)


def split_view(c, delimiter: str) -> Column:
    """Segments without the empty one after a final delimiter; the empty string has none."""
    c = col(c)
    s = split_vec(c, delimiter)
    return F.when(c == "", F.array().cast("array<string>")).when(c.endswith(delimiter), F.slice(s, 1, F.size(s) - 1)).otherwise(s)


def lines(c) -> Column:
    """Lines ended by LF; CR stays."""
    return split_view(c, "\n")


def split_into(c, delimiter: str, capacity: int) -> Column:
    """The first segments; what is beyond the capacity is left out."""
    return F.slice(split_vec(c, delimiter), 1, capacity)


def fields(c) -> Column:
    """Runs of characters other than the six ASCII white-space ones."""
    return F.filter(F.split(col(c), "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")


def trim_left(c) -> Column:
    return F.ltrim(col(c), F.lit(SPACE))


def trim_right(c) -> Column:
    return F.rtrim(col(c), F.lit(SPACE))


def trim_ws(c) -> Column:
    return F.trim(col(c), F.lit(SPACE))


def replace_char(c, old: str, new: str) -> Column:
    return F.translate(col(c), old, new)


def replace_substr(c, old: str, new: str) -> Column:
    """Left to right, without overlaps; an empty ``old`` changes nothing."""
    return F.replace(col(c), F.lit(old), F.lit(new))
