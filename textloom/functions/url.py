"""Percent coding and query strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.scan import col
from textloom.functions.strings import split_view


def url_encode(c) -> Column:
    """Letters, digits and ``-._~`` stay, other bytes become %XX."""
    out = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_decode(c) -> Column:
    """%XX and + are decoded; a malformed % stays.  Bytes that are no UTF-8 become U+FFFD."""
    return F.url_decode(F.regexp_replace(col(c), "%(?![0-9A-Fa-f]{2})", "%25"))


def url_decode_bytes(c) -> Column:
    """The same as binary, so that escapes which are no UTF-8 survive."""
    parts = F.regexp_extract_all(col(c), F.lit("%[0-9A-Fa-f]{2}|[^%+]+|[%+]"), F.lit(0))
    digits = F.transform(parts, lambda x: F.when(x == "+", "20").when(x.startswith("%") & (x != "%"), F.substring(x, 2, 2)).otherwise(F.hex(x)))
    return F.unhex(F.array_join(digits, ""))


def query_pairs(c) -> Column:
    """array<struct<key, value>> in order: keys as they are, values decoded; without '=' the value is empty."""
    c = F.when(col(c).startswith("?"), F.substring(col(c), 2, 1 << 30)).otherwise(col(c))

    def pair(x):
        at = F.instr(x, "=")
        return F.struct(F.when(at == 0, x).otherwise(F.substring(x, F.lit(1), at - 1)).alias("key"),
                        F.when(at == 0, "").otherwise(url_decode(F.substring(x, at + 1, F.char_length(x)))).alias("value"))

    return F.transform(split_view(c, "&"), pair)


def parse_query(c) -> Column:
    """map<key, value>; of a repeated key the last value holds."""
    p = F.reverse(query_pairs(c))
    keys = F.array_distinct(F.transform(p, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(p, lambda x: x["key"] == k), 1)["value"]))
