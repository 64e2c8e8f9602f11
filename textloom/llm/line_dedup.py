"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on its host when the share of the host's documents that contain it exceeds ``ratio`` and at
least ``min_docs`` of them do.  Counts cover all documents; a document counts once however often it repeats a line.

The wide pass groups by (host, 64-bit hash of the line), so text is not shuffled and counts are combined before the
exchange.  Hash groups over the ratio are few: their sum over a host is at most (mean distinct lines)/ratio.  A second
pass over the lines with those hashes counts by the line itself, so a hash collision cannot drop a line.  The resulting
lists per host are broadcast if their measured size is below ``broadcast_bytes`` and otherwise joined on the host with
the strategy AQE picks, which can split a hot host.

Defined results: null text gives null text and zero lines; null host is a host of its own; blank lines are layout and
are always kept; repeated rows are separate documents; an empty table gives an empty result; other columns pass
through, and working columns take free names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, clean_name


def boilerplate_lines(ws: Workspace, docs: DataFrame, host: str, text: str, ratio: float, min_docs: int) -> DataFrame:
    """(host, line, n_docs, host_docs) of the lines over the ratio; host is coalesced to '' with a flag for null."""
    h = F.struct(F.col(host).isNull().alias("no"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    base = docs.select(h.alias("h"), F.col(text).alias("t"))
    totals = base.groupBy("h").agg(F.count("*").alias("host_docs"))
    lines = base.select("h", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line")).where("trim(line) <> ''")
    counted = lines.groupBy("h", F.xxhash64("line").alias("k")).agg(F.count("*").alias("n"))
    few = ws.write(counted.where(F.col("n") >= min_docs).join(totals, "h")
                   .where(F.col("n") > ratio * F.col("host_docs")).select("h", "k", "host_docs"))
    exact = lines.withColumn("k", F.xxhash64("line")).join(few, ["h", "k"]).groupBy("h", "line").agg(
        F.count("*").alias("n_docs"), F.first("host_docs").alias("host_docs"))
    return exact.where((F.col("n_docs") >= min_docs) & (F.col("n_docs") > ratio * F.col("host_docs")))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_docs: int = 3,
               broadcast_bytes: int = 8 << 20) -> DataFrame:
    """docs with ``text`` rid of its host's boilerplate lines, plus n_lines and n_removed (long)."""
    ws = Workspace(docs.sparkSession, "line_dedup")
    bad = ws.write(boilerplate_lines(ws, docs, host, text, ratio, min_docs))
    lists = bad.groupBy("h").agg(F.collect_list("line").alias("_bad"))
    size = bad.agg(F.coalesce(F.sum(F.octet_length("line") + 32), F.lit(0))).first()[0]
    key, lst = clean_name(docs, "_host"), clean_name(docs, "_bad")
    lists = lists.select(F.col("h").alias(key), F.col("_bad").alias(lst))
    if size <= broadcast_bytes:
        lists = F.broadcast(lists)
    h = F.struct(F.col(host).isNull().alias("no"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    lines = clean_name(docs, "_lines")
    joined = docs.withColumn(key, h).join(lists, key, "left").withColumn(lines, F.split(text, "\n", -1))
    kept = F.when(F.col(lst).isNull(), F.col(lines)).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(lst), x), F.lit(False))))
    out = joined.withColumn(lst, kept)
    n0 = F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n1 = F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(lst)).cast("long")
    rest = [F.col(c) for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    return out.select(*rest, F.when(F.col(lines).isNull(), F.lit(None).cast("string")).otherwise(
        F.array_join(lst, "\n")).alias(text), n0.alias("n_lines"), n1.alias("n_removed"))


def op1_line_dedup(spark, sf_dir):
    from textloom.llm.common import table

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "n_lines", "n_removed", "text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT source, unnest(list_distinct(ls)) AS line FROM d),
b AS (SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
      WHERE trim(l.line) <> '' GROUP BY l.source, l.line, t.n HAVING count(*) >= 3 AND count(*) > 0.1 * t.n),
g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT d.doc_id, d.text, d.ls,
        list_filter(d.ls, lambda x: NOT list_contains(coalesce(g.bad, []), x)) AS kept
      FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k
"""
