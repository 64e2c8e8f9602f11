"""The functions under SQL names, for ``spark.sql``.

Names are ``tl_`` and the function's; the Catalyst ones become SQL functions with a body and stay inside code generation,
the others are Arrow UDFs.  ``LET`` binds a value to a name: a lambda over an array of one.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from textloom.functions import hashing, utf8
from textloom.functions.encode import GOOD64
from textloom.functions.pattern import BytePattern, offsets_of
from textloom.operators import diff, parsers


def text(s: str) -> str:
    """A SQL literal."""
    return "'" + "".join(f"\\u{ord(x):04x}" if not x.isprintable() or x in "\\'" else x for x in s) + "'"


def let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = text(" \t\n\r\f\x0b")
SPLIT = r"split(t, concat('\\Q', d, '\\E'), -1)"
VIEW = "CASE WHEN t = '' THEN CAST(array() AS ARRAY<STRING>) WHEN endswith(t, {d}) THEN slice({s}, 1, size({s}) - 1) ELSE {s} END"
URL_DECODE = "url_decode(regexp_replace({0}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"
RESULT = "RETURNS STRUCT<bytes: BINARY, error: STRING, error_offset: BIGINT>"
PLACES = "transform(array({0}), w -> {1})".format(", ".join(map(text, parsers.KEYWORDS)), let(
    "instr(body, w)", "i", "CASE WHEN i > 0 AND (i = 1 OR substring(body, i - 1, 1) IN (' ', '\\t')) AND substring(body, i + char_length(w), 1) IN ('', ' ', ':') THEN i END"))
FOUND = ("CASE WHEN startswith(body, '[') THEN named_struct('stamp', substring(body, 2, instr(body, ']') - 2), 'at', CASE WHEN instr(body, ']') > 0 THEN instr(body, ']') + 1 END) ELSE "
         + let(f"array_min({PLACES})", "p", "named_struct('stamp', trim(TRAILING ' \\t' FROM substring(body, 1, p - 1)), 'at', p)") + " END")
SPLIT_LINE = let("trim(LEADING ' ' FROM substring(body, x.at))", "r", let(
    "regexp_extract(r, '^[^ :]*', 0)", "v", "named_struct('timestamp', x.stamp, 'level', v, 'message', trim(LEADING ' :\\t' FROM substring(r, char_length(v) + 1)))"))
LOG_LINE = let("trim(LEADING ' \\t' FROM t)", "body", let(FOUND, "x", f"CASE WHEN x.at IS NULL THEN named_struct('timestamp', '', 'level', '', 'message', t) ELSE {SPLIT_LINE} END"))
JSON_ESCAPES = " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in ((r"\b", "\b"), (r"\f", "\f"), (r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t")))
PAIRS = (r"transform(split(regexp_replace(t, '^\\?|&$', ''), '&', -1), x -> CASE WHEN instr(x, '=') = 0 THEN named_struct('key', x, 'value', '') "
         f"ELSE named_struct('key', substring(x, 1, instr(x, '=') - 1), 'value', {URL_DECODE.format("substring(x, instr(x, '=') + 1)")}) END)")
BODIES = {
    "count_byte(t STRING, b STRING) RETURNS BIGINT": "CAST(octet_length(t) - octet_length(replace(t, b, '')) AS BIGINT)",
    "count_newlines(t STRING) RETURNS BIGINT": "CAST(octet_length(t) - octet_length(replace(t, char(10), '')) AS BIGINT)",
    "contains(t STRING, n STRING) RETURNS BOOLEAN": "contains(t, n)",
    "contains_char(t STRING, n STRING) RETURNS BOOLEAN": "contains(t, n)",
    "starts_with(t STRING, n STRING) RETURNS BOOLEAN": "startswith(t, n)",
    "ends_with(t STRING, n STRING) RETURNS BOOLEAN": "endswith(t, n)",
    "find_byte(t STRING, b STRING) RETURNS BIGINT": "CAST(CASE WHEN instr(t, b) = 0 THEN octet_length(t) ELSE octet_length(substring(t, 1, instr(t, b) - 1)) END AS BIGINT)",
    "is_ascii(t STRING) RETURNS BOOLEAN": "octet_length(t) = char_length(t)",
    "lowercase_ascii(t STRING) RETURNS STRING": f"translate(t, '{UPPER}', '{LOWER}')",
    "uppercase_ascii(t STRING) RETURNS STRING": f"translate(t, '{LOWER}', '{UPPER}')",
    "trim_ascii(t STRING) RETURNS STRING": "trim(BOTH concat(' ', char(9), char(13), char(10)) FROM t)",
    "trim_left(t STRING) RETURNS STRING": f"trim(LEADING {SPACE} FROM t)",
    "trim_right(t STRING) RETURNS STRING": f"trim(TRAILING {SPACE} FROM t)",
    "trim_ws(t STRING) RETURNS STRING": f"trim(BOTH {SPACE} FROM t)",
    "lines(t STRING) RETURNS ARRAY<STRING>": VIEW.format(d="char(10)", s="split(t, char(10), -1)"),
    "split_vec(t STRING, d STRING) RETURNS ARRAY<STRING>": SPLIT,
    "split_view(t STRING, d STRING) RETURNS ARRAY<STRING>": VIEW.format(d="d", s=SPLIT),
    "split_into(t STRING, d STRING, n INT) RETURNS ARRAY<STRING>": f"slice({SPLIT}, 1, n)",
    "fields(t STRING) RETURNS ARRAY<STRING>": r"filter(split(t, '[ \\t\\n\\r\\f\\x0B]+'), x -> x <> '')",
    "replace_char(t STRING, a STRING, b STRING) RETURNS STRING": "translate(t, a, b)",
    "replace_substr(t STRING, a STRING, b STRING) RETURNS STRING": "replace(t, a, b)",
    "valid_utf8(t STRING) RETURNS BOOLEAN": "is_valid_utf8(t)",
    "count_code_points(t STRING) RETURNS BIGINT": "CAST(char_length(t) AS BIGINT)",
    "hex_encode(b BINARY) RETURNS STRING": "lower(hex(b))",
    "hex_decode(t STRING) RETURNS BINARY": "CASE WHEN octet_length(t) % 2 = 0 AND NOT t RLIKE '[^0-9A-Fa-f]' THEN unhex(t) END",
    f"hex_decode_result(t STRING) {RESULT}": "CASE WHEN octet_length(t) % 2 <> 0 THEN named_struct('bytes', CAST(NULL AS BINARY), 'error', 'InvalidLength', 'error_offset', 0L) WHEN t RLIKE '[^0-9A-Fa-f]' THEN "
    "named_struct('bytes', CAST(NULL AS BINARY), 'error', 'InvalidChar', 'error_offset', CAST(octet_length(regexp_extract(t, '^[0-9A-Fa-f]*', 0)) AS BIGINT)) "
    "WHEN t IS NOT NULL THEN named_struct('bytes', unhex(t), 'error', 'Ok', 'error_offset', 0L) END",
    "hex_val(t STRING) RETURNS INT": "CASE WHEN char_length(t) = 1 AND t RLIKE '^[0-9A-Fa-f]$' THEN CAST(conv(t, 16, 10) AS INT) WHEN t IS NOT NULL THEN -1 END",
    "base64_encode(b BINARY) RETURNS STRING": "replace(base64(b), concat(char(13), char(10)), '')",
    "base64_decode(t STRING) RETURNS BINARY": f"CASE WHEN t RLIKE {text(GOOD64)} THEN unbase64(t) END",
    f"base64_decode_result(t STRING) {RESULT}": f"CASE WHEN octet_length(t) % 4 <> 0 THEN named_struct('bytes', CAST(NULL AS BINARY), 'error', 'InvalidLength', 'error_offset', 0L) WHEN NOT t RLIKE {text(GOOD64)} THEN "
    "named_struct('bytes', CAST(NULL AS BINARY), 'error', 'InvalidChar', 'error_offset', CAST(octet_length(regexp_extract(t, '^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{0,3})', 0)) AS BIGINT)) "
    "WHEN t IS NOT NULL THEN named_struct('bytes', unbase64(t), 'error', 'Ok', 'error_offset', 0L) END",
    "url_encode(t STRING) RETURNS STRING": "replace(replace(replace(url_encode(t), '+', '%20'), '*', '%2A'), '%7E', '~')",
    "url_decode(t STRING) RETURNS STRING": URL_DECODE.format("t"),
    "parse_query(t STRING) RETURNS MAP<STRING, STRING>": f"CASE WHEN t IN ('', '?') THEN CAST(map() AS MAP<STRING, STRING>) ELSE aggregate({PAIRS}, CAST(map() AS MAP<STRING, STRING>), (m, e) -> map_concat(map_filter(m, (k, v) -> k <> e.key), map(e.key, e.value))) END",
    "crc32(b BINARY) RETURNS BIGINT": "crc32(b)",
    "looks_like_json(t STRING) RETURNS BOOLEAN": r"t RLIKE '^[ \\t\\n\\r]*[{\\[]'",
    "looks_like_xml(t STRING) RETURNS BOOLEAN": r"t RLIKE '^[ \\t\\n\\r]*<'",
    "is_json_number(t STRING) RETURNS BOOLEAN": f"t RLIKE {text('^' + parsers.JSON_NUMBER + chr(92) + 'z')}",
    "json_unescape(t STRING) RETURNS STRING": r"array_join(transform(regexp_extract_all(t, '(?s)\\\\.|[^\\\\]+|\\\\', 0), x -> CASE WHEN NOT startswith(x, '\\') OR x IN ('\\', '\\u') THEN x ELSE CASE x "
    + JSON_ESCAPES + " ELSE substring(x, 2) END END), '')",
    "xml_escape(t STRING) RETURNS STRING": "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&apos;')",
    "parse_log_level(t STRING) RETURNS STRING": "CASE WHEN t IS NULL THEN NULL WHEN t IN ('WARNING', 'warning') THEN 'WARN' WHEN t IN ({0}) OR t IN ({1}) THEN upper(t) ELSE 'UNKNOWN' END".format(
        *(", ".join(map(text, x)) for x in (parsers.LEVELS, [w.lower() for w in parsers.LEVELS]))),
    "parse_log_line(t STRING) RETURNS STRUCT<timestamp: STRING, level: STRING, message: STRING>": f"CASE WHEN t IS NOT NULL THEN {LOG_LINE} END",
    "text_equal(a STRING, b STRING) RETURNS BOOLEAN": "a = b",
}


@cache
def _pattern_udfs() -> dict:
    """Patterns as a column of texts; a bad pattern finds nothing."""

    @F.pandas_udf(LongType())
    def first(data: pd.Series, pattern: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or p is None else next(offsets_of(bytes(b), BytePattern.parse(p)), None) for b, p in zip(data, pattern, strict=True)], dtype="Int64")

    @F.pandas_udf(ArrayType(LongType()))
    def every(data: pd.Series, pattern: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or p is None else list(offsets_of(bytes(b), BytePattern.parse(p))) for b, p in zip(data, pattern, strict=True)], dtype=object)

    return {"find_pattern": first, "find_all_patterns": every}


@cache
def _csv_udf():
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else list(parsers.csv_records(t)) for t in s], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """Registers all for the session and gives their names."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tl_{head} RETURN {body}")
    prefix, suffix = diff.common_udfs()
    arrow = {**hashing.UDFS, "validate_utf8_detailed": utf8.detail_udf, "line_diff": diff.diff_udf(), "count_diff_lines": diff.count_udf(), "common_prefix_length": prefix, "common_suffix_length": suffix,
             "json_tokens": parsers.json_tokens_udf, "xml_tokens": parsers.xml_tokens_udf, "markdown_tokens": parsers.markdown_udf, "config_entries": parsers.config_udf, "csv_rows": _csv_udf(), **_pattern_udfs()}
    for name, udf in arrow.items():
        spark.udf.register(f"tl_{name}", udf)
    return [f"tl_{n}" for n in (*(h.split("(")[0] for h in BODIES), *arrow)]
