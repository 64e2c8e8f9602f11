"""The corpus pipeline: stages over ``documents``, each reading what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from textloom.llm.common import Workspace, scratch, table

ORACLE_SQL = None  # a learned score and packing can't be put in SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text that stays."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_neardup", drop_copies), ("decontaminate", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.  What a stage wrote on its way goes as soon as its result is written."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for _, stage in STAGES:
        with scratch():
            docs = ws.write(stage(spark, docs, sf_dir))
    return docs
