"""Row generators for structured text: JSON, XML, Markdown, CSV, INI and log lines.

JSON, XML and CSV need a cursor for their error rules, Markdown and INI carry a state from line to line: these run as
Arrow-batched functions that return one array per row, so nothing is shuffled and rows with equal or null keys stay apart.
Log lines are expressions.  Null text gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from textloom.functions.batches import each
from textloom.functions.scan import col, let
from textloom.functions.strings import SPACE, lines

TOKENS = ArrayType(StructType().add("seq", LongType()).add("type", StringType()).add("value", StringType()).add("offset", LongType()))
NUMBER = re.compile(rb"-?[0-9]+")
JSON_NUMBER = r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
JSON_STRING = re.compile(rb'"(?:\\.|[^"\\])*"', re.S)
PUNCT = {0x7B: "ObjectOpen", 0x7D: "ObjectClose", 0x5B: "ArrayOpen", 0x5D: "ArrayClose", 0x3A: "Colon", 0x2C: "Comma"}
WORDS = ((b"true", "True"), (b"false", "False"), (b"null", "Null"))
BLANK = re.compile(rb"[ \t\n\r]*")
FRACTION, EXPONENT = re.compile(rb"\.[0-9]*"), re.compile(rb"[eE][+-]?[0-9]*")


def json_scan(b: bytes) -> list[tuple[str, bytes, int]]:
    """(type, slice, offset) of the lexer's tokens, without the end."""
    out, at, n = [], 0, len(b)
    while (at := BLANK.match(b, at).end()) < n:
        start, c = at, b[at]
        if c in PUNCT:
            at += 1
            out.append((PUNCT[c], b[start:at], start))
        elif c == 0x22:
            m = JSON_STRING.match(b, at)
            at = m.end() if m else n
            out.append(("String" if m else "Error", b[start:at], start))
        elif c in b"tfn":
            word, name = next(w for w in WORDS if w[0][0] == c)
            if b.startswith(word, at):
                at += len(word)
                out.append((name, word, start))
            else:
                at += 1
                out.append(("Error", b[start:], start))
        elif m := NUMBER.match(b, at):
            at, bad = m.end(), False
            for part in (FRACTION, EXPONENT):
                if not bad and (m := part.match(b, at)):
                    bad = not m[0][-1:].isdigit()
                    at = m.end()
            out.append(("Error", b[start:], start) if bad else ("Number", b[start:at], start))
        else:
            at += 1
            out.append(("Error", b[start:] if c == 0x2D else b[start:at], start))
    return out


def xml_scan(b: bytes) -> list[tuple[str, bytes, int]]:
    out, at, n = [], 0, len(b)

    def until(stop: bytes, frm: int) -> int:
        i = b.find(stop, frm)
        return i if i >= 0 else max(frm, n - len(stop) + 1)

    while (at := BLANK.match(b, at).end()) < n:
        start = at
        if b[at] != 0x3C:
            at = until(b"<", at)
            out.append(("Text", b[start:at], start))
        elif at + 1 >= n:
            out.append(("Error", b[start:], start))
            at = n
        elif b.startswith(b"<!--", at):
            end = until(b"-->", at + 4)
            out.append(("Comment", b[at + 4: end], start))
            at = end + 3
        elif b.startswith(b"<![CDATA[", at):
            end = until(b"]]>", at + 9)
            out.append(("CData", b[at + 9: end], start))
            at = end + 3
        elif b[at + 1] == 0x3F:
            name = re.compile(rb"[^ ?]*").match(b, at + 2)
            out.append(("Declaration", name[0], start))
            at = until(b"?>", name.end()) + 2
        elif b[at + 1] == 0x2F:
            name = re.compile(rb"[^> ]*").match(b, at + 2)
            out.append(("CloseTag", name[0], start))
            at = until(b">", name.end()) + 1
        else:
            name = re.compile(rb"[^> /\t\n]*").match(b, at + 1)
            at = until(b">", name.end()) + 1
            own = at <= n and b[at - 1: at] == b">" and at - 2 >= name.end() and b[at - 2] == 0x2F
            out.append(("SelfClose" if own else "OpenTag", name[0], start))
    return out


def _tokens(scan):
    def one(t: str) -> list[dict]:
        return [{"seq": i, "type": k, "value": v.decode(errors="replace"), "offset": o} for i, (k, v, o) in enumerate(scan(t.encode()))]

    @F.pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return each(batches, one)

    return run


json_tokens_udf, xml_tokens_udf = _tokens(json_scan), _tokens(xml_scan)


def json_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.inline(json_tokens_udf(text)))


def xml_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.inline(xml_tokens_udf(text)))


def looks_like_json(c) -> Column:
    return col(c).rlike(r"^[ \t\n\r]*[{\[]")


def looks_like_xml(c) -> Column:
    return col(c).rlike(r"^[ \t\n\r]*<")


def is_json_number(c) -> Column:
    return col(c).rlike(rf"^{JSON_NUMBER}\z")


def json_unescape(c) -> Column:
    r"""Escapes become characters, \uXXXX stays, an unknown escape loses its backslash, a final backslash stays."""
    parts = F.regexp_extract_all(col(c), F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    plain = {r"\b": "\b", r"\f": "\f", r"\n": "\n", r"\r": "\r", r"\t": "\t"}

    def one(x):
        out = F.when(~x.startswith("\\") | (x == "\\") | (x == "\\u"), x)
        for a, b in plain.items():
            out = out.when(x == a, b)
        return out.otherwise(F.substring(x, 2, 2))

    return F.array_join(F.transform(parts, one), "")


def xml_escape(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _csv_piece(delimiter: str, quote: str) -> re.Pattern:
    """A run of plain text and what ends it: a delimiter, a line end, the end, or a quoted value with what follows that."""
    d, q = re.escape(delimiter), re.escape(quote)
    plain, end = rf"(?:[^{d}{q}\r\n]|\r(?!\n))*+", rf"{d}|\r?\n|\Z"
    return re.compile(rf"{plain}(?:(?P<end>{end})|{q}(?P<value>(?:[^{q}]|{q}{q})*+)(?P<closed>{q}(?P<after>{end})?)?)")


def csv_records(s: str, delimiter: str = ",", quote: str = '"') -> Iterator[list[str]]:
    """Rows of fields, as the text is read.

    Fixed semantics: doubled quotes stay doubled, plain text before a quoted value is dropped, and text between a closing
    quote and the next delimiter makes a field of its own that begins with the quoted value.
    """
    piece, row, at, more, kept = _csv_piece(delimiter, quote), [], 0, False, None  # the re module keeps compiled patterns
    while more or at < len(s):
        m = piece.match(s, at)
        at = m.end()
        if m["value"] is None:
            ended = m["end"]
            row.append(s[m.start() if kept is None else kept: m.start("end")])
        else:
            ended = m["after"] if m["closed"] else ""
            row.append(m["value"])
        kept = m.start("value") if ended is None else None
        more = ended is None or ended == delimiter
        if not more:
            yield row
            row = []


def csv_rows(df: DataFrame, key: str, text: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """(key, row, col, value); rows count from 1, columns from 0."""

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return each(batches, lambda t: list(csv_records(t, delimiter, quote)))

    rows = df.select(key, F.posexplode(run(text)).alias("row", "_f"))
    return rows.select(key, (F.col("row") + 1).cast("long").alias("row"), F.posexplode("_f").alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def parse_csv_row(c, delimiter: str = ",", quote: str = '"') -> Column:
    """array<string>: the fields of the first row.  Only rows that hold a quote reach Python."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else next(csv_records(t, delimiter, quote), []) for t in s], dtype=object)

    quoted = F.contains(col(c), F.lit(quote))
    first = F.regexp_extract(col(c), r"^(?:[^\r\n]|\r(?!\n))*", 0)
    plain = F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(first, re.escape(delimiter), -1))
    return F.when(quoted, run(F.when(quoted, col(c)))).otherwise(plain)


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number from 1, line)."""
    return df.select(key, F.posexplode(lines(text)).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_number"), "line")


RULE, HASHES, ORDERED = re.compile(r"(?:-{3,}|\*{3,}|_{3,}) *\Z"), re.compile("(#+) *"), re.compile("[0-9][.]")
MARKDOWN = ArrayType(StructType().add("seq", LongType()).add("type", StringType()).add("text", StringType()).add("content", StringType()).add("level", LongType()).add("offset", LongType()))
ENTRIES = ArrayType(StructType().add("section", StringType()).add("name", StringType()).add("value", StringType()).add("line", LongType()))


def markdown_line(t: str) -> tuple[str, str, int]:
    """(type, content, level) of a line outside of a fence, without its leading blanks."""
    if m := HASHES.match(t):
        return "Heading", t[m.end():], min(6, len(m[1]))
    if RULE.match(t):
        return "HorizontalRule", "", 0
    if t.startswith(">"):
        return "Blockquote", t[2:] if t.startswith("> ") else t[1:], 0
    if t.startswith(("- ", "* ")):
        return "ListItem", t[2:], 0
    if ORDERED.match(t):
        return "ListItem", t[2:], 1
    return "Paragraph", t, 0


def markdown_scan(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(type, raw line with its end, content, level, byte offset) of each line; inside a fence every line is a CodeBlock."""
    inside, offset = False, 0
    for raw in text.split("\n"):
        last = offset + len(raw) >= len(text)  # characters here, bytes in what is yielded
        if last and not raw:
            return
        t = raw.lstrip(" \t")
        if t.startswith("```"):
            kind = "CodeBlock", "" if inside else t[3:], 0
            inside = not inside
        else:
            kind = ("CodeBlock", t, 0) if inside else markdown_line(t)
        yield kind[0], raw if last else raw + "\n", kind[1], kind[2], offset
        offset += len(raw) + 1


def ini_scan(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(section, name, value, line number) of each entry."""
    section = ""
    for number, raw in enumerate(text.split("\n"), 1):
        t = raw.strip(SPACE)
        if not t or t[0] in "#;":
            continue
        if t[0] == "[" and t[-1] == "]":
            section = t[1:-1]
        elif "=" in t:
            name, value = (x.strip(SPACE) for x in t.split("=", 1))
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
            yield section, name, value[1:-1] if quoted else value, number


def _byte_offsets(text: str, at: list[int]) -> list[int]:
    """Offsets in UTF-8 of ascending offsets in characters."""
    if text.isascii():
        return at
    out, before, size = [], 0, 0
    for x in at:
        size += len(text[before:x].encode())
        before = x
        out.append(size)
    return out


@F.pandas_udf(MARKDOWN)
def markdown_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t: str) -> list[dict]:
        got = list(markdown_scan(t))
        return [{"seq": i, "type": k, "text": raw, "content": c, "level": n, "offset": o}
                for i, ((k, raw, c, n, _), o) in enumerate(zip(got, _byte_offsets(t, [x[4] for x in got]), strict=True))]

    return each(batches, one)


@F.pandas_udf(ENTRIES)
def config_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("section", "name", "value", "line")
    return each(batches, lambda t: [dict(zip(names, x, strict=True)) for x in ini_scan(t)])


def markdown_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, type, text, content, level, offset) of each line of each row; ``text`` is the raw line."""
    return df.select(key, F.inline(markdown_udf(text)))


def config_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, name, value, line) of each row's INI text."""
    return df.select(key, F.inline(config_udf(text)))


def config_get(entries: DataFrame, key: str, section: str, name: str, default: str = "") -> DataFrame:
    """(key, value): the first entry of that section and name, else the default."""
    mine = (F.col("section") == section) & (F.col("name") == name)
    return entries.groupBy(key).agg(F.coalesce(F.min_by(F.when(mine, F.col("value")), F.when(mine, F.col("line"))), F.lit(default)).alias("value"))


LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
KEYWORDS = [x for w in ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL") for x in (w, w.lower())]

ALONE = rf"(?<![^ \t])(?:{'|'.join(KEYWORDS)})(?![^ :])"


def parse_log_level(c) -> Column:
    """One of the six levels or UNKNOWN: names in capitals or small letters only."""
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for w in LEVELS:
        out = out.when(col(c).isin(w, w.lower(), *(("WARNING", "warning") if w == "WARN" else ())), w)
    return out.otherwise("UNKNOWN")


def level_rank(c) -> Column:
    out = F.when(col(c) == LEVELS[0], 0)
    for i, w in enumerate(LEVELS[1:], 1):
        out = out.when(col(c) == w, i)
    return out.otherwise(6)


def _first_keyword(body: Column) -> Column:
    """Position of the earliest keyword whose first occurrence stands alone, or null.

    One search finds the earliest that stands alone.  Where that is its word's first occurrence, it is the one; else each
    word is looked at.
    """

    def alone(word: Column, at: Column) -> Column:
        before, after = F.substring(body, at - 1, F.lit(1)), F.substring(body, at + F.char_length(word), F.lit(1))
        return (at > 0) & ((at == 1) | before.isin(" ", "\t")) & after.isin("", " ", ":")

    places = F.transform(F.array(*map(F.lit, KEYWORDS)), lambda w: let(F.instr(body, w), lambda at: F.when(alone(w, at), at)))
    earliest = F.regexp_extract(body, ALONE, 0)
    return let(earliest, lambda w: F.when(w != "", let(F.instr(body, w), lambda at: F.when(alone(w, at), at).otherwise(F.array_min(places)))))


def parse_log_line(c) -> Column:
    """struct(timestamp, level, message).

    ``[time] LEVEL: message``, or the earliest keyword whose first occurrence stands alone; else all is message.
    """
    line = col(c)

    def split(x: Column) -> Column:
        rest = F.ltrim(F.substring(x["body"], x["at"], F.char_length(x["body"])), F.lit(" "))
        return let(F.struct(x["stamp"].alias("stamp"), rest.alias("rest"), F.regexp_extract(rest, "^[^ :]*", 0).alias("level")), lambda y: F.struct(
            y["stamp"].alias("timestamp"), y["level"].alias("level"),
            F.ltrim(F.substring(y["rest"], F.char_length(y["level"]) + 1, F.char_length(y["rest"])), F.lit(" :\t")).alias("message")))

    def find(body: Column) -> Column:
        bracket = F.instr(body, "]")
        in_brackets = F.struct(body.alias("body"), F.substring(body, F.lit(2), bracket - 2).alias("stamp"), F.when(bracket > 0, bracket + 1).alias("at"))
        by_word = let(_first_keyword(body), lambda at: F.struct(body.alias("body"), F.rtrim(F.substring(body, F.lit(1), at - 1), F.lit(" \t")).alias("stamp"), at.alias("at")))
        return F.when(body.startswith("["), in_brackets).otherwise(by_word)

    whole = F.struct(F.lit("").alias("timestamp"), F.lit("").alias("level"), line.alias("message"))
    found = let(F.ltrim(line, F.lit(" \t")), lambda body: let(find(body), lambda x: F.when(x["at"].isNull(), whole).otherwise(split(x))))
    return F.when(line.isNotNull(), found)


@F.pandas_udf(ArrayType(LongType()))
def line_offsets_udf(s: pd.Series) -> pd.Series:
    def one(t: str) -> list[int]:
        x = t.encode().split(b"\n")
        return list(itertools.accumulate((len(y) + 1 for y in x[:-2 if x[-1] == b"" else -1]), initial=0)) if t else []

    return pd.Series([None if t is None else one(t) for t in s], dtype=object)


def log_lines(df: DataFrame, key: str, text: str, offsets: bool = False) -> DataFrame:
    """(key, line_number, line, timestamp, level, message, rank) and, with ``offsets``, byte_offset of the line in its text."""
    if offsets:
        rows = df.select(key, F.posexplode(F.arrays_zip(lines(text).alias("line"), line_offsets_udf(text).alias("byte_offset"))).alias("p", "x"))
        rows = rows.select(key, (F.col("p") + 1).cast("long").alias("line_number"), "x.line", "x.byte_offset")
    else:
        rows = numbered_lines(df, key, text)
    rows = rows.withColumn("e", parse_log_line("line"))
    # the level is named once: a filter on the rank is pushed to the lines with what it names written out
    return rows.select(key, "line_number", "line", "e.*", *(["byte_offset"] if offsets else [])).withColumn("rank", let(F.col("level"), lambda x: let(parse_log_level(x), level_rank)))


def count_log_levels(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = log_lines(df, key, text)
    names = [*(w.lower() for w in LEVELS), "unknown"]
    return rows.groupBy(key).agg(*[F.count_if(F.col("rank") == i).alias(f"n_{w}") for i, w in enumerate(names)], F.count("*").alias("n_total"))


def filter_log_lines(df: DataFrame, key: str, text: str, least: str) -> DataFrame:
    """Lines of at least that level; lines without a known level pass."""
    rank = [*LEVELS, "UNKNOWN"].index(least)
    return log_lines(df, key, text).where(F.col("rank") >= rank).select(key, "line_number", "line")
