"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``capacity`` tokens (whitespace words).  Full pieces fill a bin alone; the rest
is packed by best-fit decreasing: bins are ordered by residual capacity, each carries a bitmap of the sources and one of
the duplicate clusters it holds, and a successor search from the piece's length walks up the residuals until the
tightest bin without a conflict is found.  A bin never holds two documents of one source or of one duplicate cluster.

Documents are dealt to shards by a hash of their content and id, about ``shard_docs`` to a shard whatever the input's
size, so a hot source or a large group of copies spreads over all shards, and a shard's pieces (numbers, not texts) fit
in memory; a task packs one shard after the other.  The shard count follows from a count of all rows.

Defined results: null or empty texts give one piece of 0 tokens, packed like any other; null source is a source of its
own; the default cluster is the text with case and white space folded, so repeated rows never share a bin (the query takes
components of near copies instead); a null
doc_id is kept; ties go by length, doc_id and text hash; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, piece int, n_tokens long, shard int, bin int, start long, source string"


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) for each (tokens, source, cluster) with tokens below capacity, in the given order."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    with_source: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    out = []
    for tokens, source, cluster in pieces:
        s, c, hit = 1 << source, 1 << cluster_bit.setdefault(cluster, len(cluster_bit)), -1
        if with_source.get(source, 0) < len(used):  # else every bin has this source
            for i in range(bisect.bisect_left(order, (tokens, -1)), len(order)):
                b = order[i][1]
                if not sources[b] & s and not clusters[b] & c:
                    hit = i
                    break
        if hit >= 0:
            room, b = order.pop(hit)
        else:
            room, b = capacity, len(used)
            sources.append(0)
            clusters.append(0)
            used.append(0)
        out.append((b, used[b]))
        sources[b] |= s
        clusters[b] |= c
        used[b] += tokens
        with_source[source] = with_source.get(source, 0) + 1
        bisect.insort(order, (room - tokens, b))
    return out


def source_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("source")


def words_of() -> Column:
    return F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).cast("long").alias("n")


def sizes_of(docs: DataFrame, cluster: Column | None = None) -> DataFrame:
    """(doc_id, source, n, cl) of (doc_id, source, text): what packing needs of a document, without its text."""
    same = F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of(), words_of(), F.xxhash64((same if cluster is None else cluster).cast("string")).alias("cl"))


def best_fit(docs: DataFrame, capacity: int = 4096, shard_docs: int = 2000, cluster: str | None = None) -> DataFrame:
    """SCHEMA's rows, one for each piece of each document of (doc_id, source, text[, cluster])."""
    return pack_sizes(sizes_of(docs, F.col(cluster) if cluster else None), docs.count(), capacity, shard_docs)


def pack_sizes(small: DataFrame, n: int, capacity: int = 4096, shard_docs: int = 2000) -> DataFrame:
    """SCHEMA's rows for n documents given as (doc_id, source, n, cl)."""
    shards = max(1, -(-n // shard_docs))
    small = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cl", "n"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "cl", "source"], ascending=[False, True, True, True], na_position="first")
        src = {s: i for i, s in enumerate(sorted(set(pdf["source"])))}
        rows, rest = [], []
        full = 0
        for doc, source, n, c in zip(pdf["doc_id"], pdf["source"], pdf["n"], pdf["cl"], strict=True):
            k = int(n) // capacity
            for p in range(k):
                rows.append((doc, p, capacity, full, 0, source))
                full += 1
            if n % capacity or not k:
                rest.append((int(n) % capacity, src[source], int(c), doc, k, source))
        rest.sort(key=lambda x: -x[0])
        for (b, start), (t, _, _, doc, p, source) in zip(pack([x[:3] for x in rest], capacity), rest, strict=True):
            rows.append((doc, p, t, full + b, start, source))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens", "bin", "start", "source"])
        out["shard"] = pdf["shard"].iloc[0]
        out["source"] = out["source"].replace("\0null", None)
        return out[["doc_id", "piece", "n_tokens", "shard", "bin", "start", "source"]].astype({"doc_id": "Int64"})

    return small.repartition(min(shards, 10_000), "shard").groupBy("shard").applyInPandas(run, SCHEMA)


def op8_best_fit_packing(spark, sf_dir):
    """Clusters are the components of SimHash fingerprints, so near copies keep apart as exact ones do."""
    from textloom.llm.common import Workspace, table
    from textloom.llm.simhash import simhash_components

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", source_of(), words_of())
    ws = Workspace(spark, "packing")
    got = ws.write(simhash_components(docs, keep=("source", "n"), ws=ws).select("doc_id", "source", "n", F.xxhash64("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).alias("cl")))
    return pack_sizes(got, got.count())
