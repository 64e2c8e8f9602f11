"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared with case folded and white space runs as one space.  A test item of L characters may occur with up
to k = floor(error_rate * L) edits.  It is split into k + 1 pieces; an occurrence with at most k edits leaves one piece
untouched, so an Aho-Corasick automaton over all pieces finds every candidate place, and Myers' bit-parallel algorithm
finds the smallest edit distance of the whole item to a substring of the window around it.

A benchmark of at most ``automaton_bytes`` of text (measured) travels with the function: its automaton is built in the
workers and all documents pass it in a narrow stage without a shuffle.  A larger one stays distributed: the hash of each
piece's first characters goes into a bit table of at most 32 MB, all documents pass that table once, and the places that it
lets through are joined with the pieces by hash.  Candidates of a document meet its text once, for verification.  Both ways
find the same: a piece hit is a place of its first characters, and the distance decides.

Defined results: null or empty documents match nothing; null or blank items match nothing; items with k = 0 must occur
exactly; repeated documents are matched each; repeated item rows count once per item_id with the smallest distance;
null ids are carried; an empty table on either side gives no match; extra columns pass through ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from textloom.llm.common import Workspace, clean_name

HITS = "array<struct<item_id:long,distance:long>>"


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 (offset, piece), as even as can be; pieces are never empty since k < len(item)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, masks: dict[str, int], window: str, limit: int) -> int:
    """Smallest edit distance of pattern to any substring of window, or limit + 1 if it is larger than limit."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, limit + 1
    for ch in window:
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # no carry in: a match may start anywhere
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def nearest(text: str, item: str, masks: dict[str, int], k: int, starts: Iterable[int]) -> int:
    """Smallest distance of the item to a substring about one of the places where it would start, or k + 1."""
    spans: list[list[int]] = []
    for at in sorted(starts):
        a, b = at - k, at + len(item) + k
        if spans and a <= spans[-1][1]:  # overlapping windows are read once
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return min((myers(item, masks, text[max(0, a): b], k) for a, b in spans), default=k + 1)


def in_order(best: dict[int | None, int]) -> list[tuple[int | None, int]]:
    return sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        import ahocorasick

        at: dict[str, list[tuple[int, int]]] = {}
        self.items = []
        for item_id, text in items:
            if not (t := fold(text)):
                continue
            k = int(error_rate * len(t))
            for off, piece in pieces(t, k):
                at.setdefault(piece, []).append((len(self.items), off))
            self.items.append((item_id, t, k, masks_of(t)))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int | None, int]]:
        t = fold(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.auto.iter(t):
            for i, off in where:
                starts.setdefault(i, set()).add(end + 1 - n - off)
        best: dict[int | None, int] = {}
        for i, places in starts.items():
            item_id, item, k, masks = self.items[i]
            if (d := nearest(t, item, masks, k, places)) <= k:
                best[item_id] = min(d, best.get(item_id, d))
        return in_order(best)


def _match(items: list[tuple[int | None, str]], error_rate: float):
    @F.pandas_udf(HITS)
    def match(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(items, error_rate)
        for s in texts:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in m(t)] for t in s], index=s.index, dtype=object)

    return match


HEAD, PROBES, MOST_BITS = 12, 3, 1 << 28
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def heads(text: str, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hash of the q characters at each place) for the sizes, at most HEAD."""
    x = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(x), np.uint64)
    for q in range(1, max(sizes) + 1):
        if q > len(x):
            return
        h = h[: len(x) - q + 1] * STEP + x[q - 1:]
        if q in sizes:
            yield q, _mix(h + np.uint64(q))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = _mix(h ^ STEP) | np.uint64(1)
    return [h + np.uint64(j) * step & np.uint64(bits - 1) for j in range(PROBES)]


def _prepared(error_rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            folded = [fold(t) for t in p["text"]]
            yield pd.DataFrame({"item_id": p["item_id"], "t": folded, "k": [int(error_rate * len(t)) for t in folded]}).query("t != ''").astype({"item_id": "Int64"})

    return run


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for iid, t, k in zip(p["iid"], p["t"], p["k"], strict=True):
            for off, piece in pieces(t, int(k)):
                (q, h), = heads(piece[:HEAD], {min(len(piece), HEAD)})
                rows.append((int(h.view(np.int64)[0]), q, iid, off))
        yield pd.DataFrame(rows, columns=["seed", "q", "iid", "off"])


def _bits(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at = np.unique(np.concatenate(probes(p["seed"].to_numpy().view(np.uint64), bits)))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


def _places(table: np.ndarray, sizes: set[int], bits: int, rid: str, text: str):
    """(rid, seed, q, pos) of the places that the bit table lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i, t in zip(p[rid], p[text], strict=True):
                for q, h in heads(fold(t), sizes):
                    ok = np.ones(len(h), bool)
                    for at in probes(h, bits):
                        ok &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                    if len(pos := np.flatnonzero(ok)):
                        yield pd.DataFrame({"rid": i, "seed": h[pos].view(np.int64), "q": q, "pos": pos})

    return run


@F.pandas_udf(ArrayType(StructType().add("item_id", LongType()).add("distance", LongType())))
def _verified(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    out = []
    for text, want in zip(texts, wanted, strict=True):
        t, best = fold(text), {}
        for w in want:
            item_id = None if w["item_id"] is None else int(w["item_id"])
            if (d := nearest(t, w["t"], masks_of(w["t"]), w["k"], w["starts"])) <= w["k"]:
                best[item_id] = min(d, best.get(item_id, d))
        out.append([{"item_id": i, "distance": d} for i, d in in_order(best)])
    return pd.Series(out, index=texts.index, dtype=object)


def _joined(docs: DataFrame, items: DataFrame, out: str, text: str, error_rate: float) -> DataFrame:
    ws, rid = Workspace(docs.sparkSession, "decontaminate"), clean_name(docs, "_rid")
    base = ws.write(docs.withColumn(rid, F.monotonically_increasing_id()))
    ready = ws.write(items.mapInPandas(_prepared(error_rate), "item_id long, t string, k int").distinct().withColumn("iid", F.monotonically_increasing_id()))
    seeds = ws.write(ready.select("iid", "t", "k").mapInPandas(_seeds, "seed long, q int, iid long, off int"))
    sizes = {r[0] for r in seeds.select("q").distinct().collect()}  # at most HEAD
    if not sizes:
        return base.select(*docs.columns, F.array().cast(HITS).alias(out))
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * seeds.count()).bit_length()))
    got = seeds.select("seed").distinct().mapInPandas(_bits(bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most MOST_BITS / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    places = base.select(rid, text).mapInPandas(_places(table, sizes, bits, rid, text), "rid long, seed long, q int, pos int")
    starts = places.join(seeds, ["seed", "q"]).groupBy("rid", "iid").agg(F.collect_set(F.col("pos") - F.col("off")).alias("starts"))
    want = starts.join(ready, "iid").groupBy("rid").agg(F.collect_list(F.struct("item_id", "t", "k", "starts")).alias("want"))
    texts = base.select(F.col(rid).alias("rid"), F.col(text).alias("text"))
    found = ws.write(texts.join(want, "rid").select("rid", _verified("text", "want").alias("hits")).where(F.size("hits") > 0))
    found = found.select(F.col("rid").alias(rid), F.col("hits").alias(clean_name(docs, "_hits")))
    return base.join(found, rid, "left").select(*docs.columns, F.coalesce(F.col(clean_name(docs, "_hits")), F.array().cast(HITS)).alias(out))


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", error_rate: float = 0.07, automaton_bytes: int = 2 << 20) -> DataFrame:
    """docs with ``out``: the items found in each text and their distances."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > automaton_bytes:
        return _joined(docs, items, out, text, error_rate)
    return docs.withColumn(out, _match([tuple(r) for r in items.collect()], error_rate)(F.col(text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those in whose text an item occurs."""
    hits = clean_name(docs, "_hits")
    return with_matches(docs, benchmark, hits, **options).where(F.size(hits) == 0).drop(hits)


def op2_benchmark_decontamination(spark, sf_dir):
    from textloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_matches(docs, table(spark, sf_dir, "benchmark"), "hits").select("doc_id", F.explode("hits").alias("h"))
    return got.select("doc_id", "h.item_id", "h.distance")
