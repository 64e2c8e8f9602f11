"""File sources and the commands over them.

Lines end at LF only.  A missing path is read like an empty file: length 0, no lines.  Files are listed by Spark's readers,
which leave empty ones out; these are added from a listing of names and sizes, so no content passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ascii as ascii_
from textloom.functions import utf8


def _listed(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """(has a file with content?, the empty files) of a path, a folder or a glob; without any file the path itself."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    full, empty = False, []
    for status in fs.globStatus(where) or ():
        for x in fs.listStatus(status.getPath()) if status.isDirectory() else (status,):
            if x.isDirectory() or x.getPath().getName()[0] in "._":
                continue
            if x.getLen():
                full = True
            else:
                empty.append(x.getPath().toString())
    return full, empty if full or empty else [path]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content)."""
    full, empty = _listed(spark, path)
    none = spark.createDataFrame([(x, 0, b"") for x in empty], "path string, length long, content binary")
    if not full:
        return none
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.unionAll(none) if empty else files


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): each line of the files."""
    if not _listed(spark, path)[0]:
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, lineSep="\n")


def grep_lines(spark: SparkSession, path: str, needle: str) -> DataFrame:
    return text_lines(spark, path).where(F.col("value").contains(needle))


def count_matching_lines(spark: SparkSession, path: str, needle: str) -> DataFrame:
    return text_lines(spark, path).agg(F.count_if(F.col("value").contains(needle)).alias("n"))


def _newlines() -> Column:
    latin = F.decode("content", "ISO-8859-1")
    return (F.char_length(latin) - F.char_length(F.replace(latin, F.lit("\n"), F.lit("")))).cast("long")


def file_count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): LF bytes per file, which is not the number of lines if the last one is unterminated."""
    return whole_files(spark, path).select("path", _newlines().alias("n"))


def file_stats(spark: SparkSession, path: str, needle: str | None = None) -> DataFrame:
    """(path, size, lines, is_ascii, valid_utf8) of each file, in one pass; with a needle also ``matching``, the lines that hold it."""
    parts = F.split(F.decode("content", "ISO-8859-1"), "\n", -1)
    held = F.lit((needle or "").encode().decode("latin-1"))
    more = [F.size(F.filter(parts, lambda x: F.contains(x, held))).cast("long").alias("matching")] if needle else []
    return whole_files(spark, path).select(
        "path", F.col("length").alias("size"), _newlines().alias("lines"), ascii_.is_ascii_bytes("content").alias("is_ascii"), utf8.valid_utf8("content").alias("valid_utf8"), *more)


def write_text(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """One text column as lines; with ``by`` in a folder per value, as Spark's partitioned tables are."""
    out = df.select(F.col(column).cast("string").alias("value"), *([by] if by else [])).write
    (out.partitionBy(by) if by else out).text(path)
