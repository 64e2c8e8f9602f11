"""Whole-column reductions, combined per task before the exchange, and chunk iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import ascii as ascii_
from textloom.functions import scan, utf8


def agg_count_byte(c, byte: str) -> Column:
    return F.coalesce(F.sum(scan.count_byte(c, byte)), F.lit(0)).cast("long")


def agg_count_newlines(c) -> Column:
    return agg_count_byte(c, "\n")


def agg_is_ascii(c) -> Column:
    return F.coalesce(F.bool_and(ascii_.is_ascii(c)), F.lit(True))


def agg_valid_utf8(c) -> Column:
    return F.coalesce(F.bool_and(utf8.valid_utf8(c)), F.lit(True))


def agg_find_byte(c, byte: str) -> Column:
    """The smallest offset of the byte in any row that has it; null if none has."""
    return F.min(F.when(scan.contains_char(c, byte), scan.find_byte(c, byte)))


def for_each_chunk(df: DataFrame, key: str, content: str, size: int, f: Callable[[bytes, int], object], kind: str) -> DataFrame:
    """(key, offset, result) of f over each run of ``size`` bytes, offsets from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(k, o, f(bytes(b[o: o + size]), o)) for k, b in zip(p["_k"], p["_b"], strict=True) if b is not None for o in range(0, len(b), size)]
            yield pd.DataFrame(rows, columns=["_k", "offset", "result"])

    t = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("_k"), F.col(content).cast("binary").alias("_b")).mapInPandas(run, f"_k {t}, offset long, result {kind}")
    return out.withColumnRenamed("_k", key)
