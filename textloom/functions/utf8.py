"""UTF-8 validation and length."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from textloom.functions.scan import col

DETAIL = StructType().add("valid", BooleanType()).add("error_offset", LongType()).add("error_byte", IntegerType()).add("error_desc", StringType())


def valid_utf8(c) -> Column:
    """Binary or string; overlong forms, surrogates, values above U+10FFFF and cut sequences are invalid."""
    return F.is_valid_utf8(col(c).cast("string"))


def count_code_points(c) -> Column:
    return F.char_length(col(c)).cast("long")


def first_error(b: bytes) -> tuple[int, int, str] | None:
    """(offset, byte, description) of the first error in b."""
    i, n = 0, len(b)
    while i < n:
        lead = b[i]
        if lead < 0x80:
            i += 1
            continue
        size = 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        if not size:
            return i, lead, "unexpected continuation byte" if lead < 0xC0 else "byte exceeds U+10FFFF" if lead >= 0xF5 else "invalid UTF-8 lead byte"
        if i + size > n:
            return i, lead, "incomplete multi-byte sequence"
        point = lead & (0x7F >> size)
        for j in range(i + 1, i + size):
            if b[j] >> 6 != 2:
                return j, b[j], "expected continuation byte"
            point = point << 6 | b[j] & 0x3F
        if point < (0, 0, 0x80, 0x800, 0x10000)[size]:
            return i, lead, f"overlong {size}-byte sequence"
        if 0xD800 <= point <= 0xDFFF:
            return i, lead, "UTF-8 encoded surrogate"
        if point > 0x10FFFF:
            return i, lead, "codepoint exceeds U+10FFFF"
        i += size
    return None


@F.pandas_udf(DETAIL)
def detail_udf(s: pd.Series) -> pd.DataFrame:
    rows = []
    for b in s:
        e = first_error(bytes(b)) if b is not None else None
        rows.append((e is None, *(e or (0, 0, ""))))
    return pd.DataFrame(rows, columns=["valid", "error_offset", "error_byte", "error_desc"])


def validate_utf8_detailed(c) -> Column:
    """struct(valid, error_offset, error_byte, error_desc); only bytes of invalid rows go to Python."""
    b = col(c).cast("binary")
    good = valid_utf8(b)
    d = detail_udf(F.when(~good, b))
    return F.when(col(c).isNotNull(), F.struct(good.alias("valid"), *[d[k].alias(k) for k in ("error_offset", "error_byte", "error_desc")]))
