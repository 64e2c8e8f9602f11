"""Hex and Base64.  Plain decoders give null on bad input; the ``_result`` forms say what and where."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.scan import col, let


def hex_encode(c) -> Column:
    return F.lower(F.hex(col(c).cast("binary")))


def hex_decode(c) -> Column:
    c = col(c)
    return F.when(F.octet_length(c) % 2 == 0, F.unhex(c))  # null where a digit is none


DIGITS = "^[0123456789ABCDEFabcdef]*+"  # single characters: Java looks these up in a table, unlike ranges


def hex_decode_result(c) -> Column:
    """struct(bytes, error, error_offset): InvalidLength before InvalidChar; the offset is that of the first bad digit."""

    def result(x: Column) -> Column:
        odd, size = F.octet_length(x["c"]) % 2 != 0, F.octet_length(x["c"])
        bad = ~odd & (x["good"] < size)
        error = F.when(odd, "InvalidLength").when(bad, "InvalidChar").otherwise("Ok")
        return F.struct(F.when(error == "Ok", F.unhex(x["c"])).alias("bytes"), error.alias("error"), F.when(bad, x["good"]).otherwise(0).cast("long").alias("error_offset"))

    good = lambda t: F.octet_length(F.regexp_extract(t, DIGITS, 0))
    return let(col(c), lambda t: let(F.struct(t.alias("c"), good(t).alias("good")), lambda x: F.when(x["c"].isNotNull(), result(x))))


def hex_val(c) -> Column:
    """Value of one hex digit, or -1."""
    c = col(c)
    return F.when((F.char_length(c) == 1) & c.rlike("^[0-9A-Fa-f]$"), F.conv(c, 16, 10).cast("int")).otherwise(F.when(c.isNotNull(), -1))


def base64_encode(c) -> Column:
    """RFC 4648 with padding, in one line."""
    return F.replace(F.base64(col(c).cast("binary")), F.lit("\r\n"), F.lit(""))


GOOD64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\\z"


def base64_decode(c) -> Column:
    c = col(c)
    return F.when(c.rlike(GOOD64), F.unbase64(c))  # Spark's own parser skips what is no digit


def base64_decode_result(c) -> Column:
    """struct(bytes, error, error_offset): the offset is that of the first character that breaks the form."""

    def result(x: Column) -> Column:
        odd, bad = F.octet_length(x["c"]) % 4 != 0, ~x["fits"]
        error = F.when(odd, "InvalidLength").when(bad, "InvalidChar").otherwise("Ok")
        good = F.regexp_extract(x["c"], "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{0,3})", 0)
        off = F.when(~odd & bad, F.octet_length(good)).otherwise(0).cast("long")
        return F.struct(F.when(~bad, F.unbase64(x["c"])).alias("bytes"), error.alias("error"), off.alias("error_offset"))

    return let(col(c), lambda t: let(F.struct(t.alias("c"), t.rlike(GOOD64).alias("fits")), lambda x: F.when(x["c"].isNotNull(), result(x))))
