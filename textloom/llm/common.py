"""Shared pieces: table access, connected components, and the written tables of ``sources.staging``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.staging import Workspace, scratch, shared_dir

__all__ = ["Workspace", "clean_name", "components", "scratch", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    names = {c.lower() for c in df.columns}
    while base.lower() in names:
        base = "_" + base
    return base


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b: long) by alternating large and small stars.

    Returns (node, comp) with comp the smallest node reachable; nodes without an edge to another node are absent.
    Minima are pre-aggregated per task, and the joins can be split by AQE where a node has very many links.  Each
    round is a written table.  Null ends are ignored; repeated edges and loops do no harm.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, last = ws.write(e), None
    while True:  # each round but the last lowers some minimum; chains halve, so rounds grow with the log of the longest
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = big.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = ws.write(small.select("x.u", "x.v").where("u <> v").distinct())
        state = nxt.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) % 1000000007")), F.sum(F.expr("u % 1000000007"))).first()
        ws.drop(cur)
        cur = nxt
        if state == last:
            break
        last = state
    leaves = cur.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    return leaves.union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
