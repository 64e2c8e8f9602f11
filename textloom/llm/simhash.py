"""SimHash near-dedup with pivot distance tables.

A fingerprint is linked to another if their Hamming distance is in bounds.  Pairs are only looked at inside blocks
(below); there a table of distances to many reference fingerprints (pivots) is computed once per fingerprint, a pair
whose coordinates differ by more than the allowed distance anywhere is discarded (triangle inequality, so no link is
lost), and survivors are verified bit by bit.

Words.  Fingerprints of 64 bits take words as their contract says, with punctuation.  Near copies compare runs of letters
and digits in small letters, as texts that differ in case or punctuation only are copies of each other.

Similarity.  A wide fingerprint's distance only rejects: its bound lies ``SIGMAS`` standard deviations above the distance
expected of the least similar pair that counts.  Components of what is left are blocks of a second pass, in which pairs
are verified on their sets of 64-bit shingle hashes.  A pair that is already joined through others needs no verification.

Blocks.  For 64 bits and at most d differing bits, m bit ranges of which m - d must agree: a key for each choice of m - d
ranges, exact.  m is the smallest with blocks of about 64 unrelated fingerprints or fewer at the measured number of
fingerprints (3 ranges up to 10^8, 4 up to 10^11), so pairs looked at grow with the input and not with its square.  For wide
fingerprints of shingle sets at Jaccard similarity s, eight pairs of shingle minima, one of which agrees with
probability 1 - (1 - s^2)^8 (0.9997 at 0.8).  Equal fingerprints (texts) are collapsed first, so copies cost one row.
A block of more than ``cap`` distinct rows (or 2,048 ``cap`` shingles, where sets are sent) is dealt into chunks and every
pair of chunks is its own group: exact, and a task holds one group and a batch.  A group emits at most one edge per row (to the smallest row of its local component),
never all pairs; components are then found by alternating stars.

Defined results: null and empty texts have fingerprint zero; null doc_ids are kept and never name a component unless all
of it is null; repeated rows and ties are linked like any copies; an empty table gives no rows; extra columns do no harm.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, clean_name, components

PLAIN = re.compile(r"[^\W_]+")
PIVOTS = 24
SIGMAS = 5


def raw_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z folded."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in small letters."""
    return [w.encode("utf-8", "surrogatepass") for w in PLAIN.findall((text or "").lower())]


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the words, repeats included, as uint64."""
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    n = max(1, len(w) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(w)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """Column sums of the bits of an (n, w) uint64 array: (w, 64), bit 0 first."""
    n, w = words.shape
    if n < 64:
        return np.unpackbits(words.view(np.uint8).reshape(n, w, 8), axis=2, bitorder="little").sum(0, dtype=np.int64).reshape(w, 64)

    def add(x: np.ndarray, group: int) -> np.ndarray:  # sums of rows, group by group
        if short := -len(x) % group:
            x = np.concatenate((x, np.zeros((short, w), np.uint64)))
        return x.reshape(-1, group, w).sum(1, dtype=np.uint64)

    fields, width = [words], 1
    for group in (3, 5, 17):  # sums of 3, 15, 255 bits in fields of 2, 4, 8 bits
        mask = np.uint64(sum((1 << width) - 1 << i for i in range(0, 64, 2 * width)))
        fields = [add(x >> np.uint64(s) & mask, group) for x in fields for s in (0, width)]
        width *= 2
    out = np.zeros((w, 8, 8), np.int64)  # word, byte, bit
    for i, x in enumerate(fields):
        out[:, :, (i >> 2 & 1) + 2 * (i >> 1 & 1) + 4 * (i & 1)] = x.view(np.uint8).reshape(len(x), w, 8).sum(0, dtype=np.int64)
    return out.reshape(w, 64)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little").view(np.uint64)[..., 0]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    h = shingle_hashes(raw_words(text), words)
    return int(pack_bits(bit_counts(h[:, None])[0] * 2 > len(h))) if len(h) else 0


def mix(h: np.ndarray, w: int) -> np.ndarray:
    """(n, w) well-mixed words for n hashes."""
    x = h[:, None] + np.arange(1, w + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide(text: list[bytes], words: int = 5, w: int = 16) -> tuple[bytes, int, list[int]]:
    """(64 w-bit fingerprint of the set of shingles of a text's words, its size, w/2 block keys)."""
    h = np.unique(shingle_hashes(text, words))
    if not len(h):
        return bytes(8 * w), 0, [0] * (w // 2)
    x = mix(h, w)
    low = x.min(0)
    keys = (low[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ low[1::2]).view(np.int64)
    return pack_bits(bit_counts(x) * 2 > len(h)).tobytes(), len(h), keys.tolist()


def distance_bound(bits: int, min_jaccard: float) -> int:
    """The distance that sets of at least this similarity exceed with a probability of about 3e-7.

    Bits differ independently of each other, with the probability that the majorities of two overlapping sets of fair
    coins differ; it is largest for small sets, where ties count, and tends to arccos(2 s / (1 + s)) / pi.
    """
    top = np.arccos(2 * min_jaccard / (1 + min_jaccard)) / np.pi
    coins = [np.ones(1)]
    for _ in range(32):
        coins.append(np.convolve(coins[-1], [0.5, 0.5]))

    def majority(n: int, c: int) -> np.ndarray:  # by the number of heads among the c common coins
        return np.array([coins[n - c][max(0, n // 2 - k + 1):].sum() for k in range(c + 1)])

    for n in range(1, 33):
        for m in range(n, 33):
            for c in range(n, 0, -1):
                if c / (n + m - c) < min_jaccard:
                    break
                x, y = majority(n, c), majority(m, c)
                top = max(top, float((coins[c] * (x * (1 - y) + y * (1 - x))).sum()))
    return int(bits * top + SIGMAS * np.sqrt(bits * top * (1 - top))) + 1


def similarity(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of a to the others, all sorted sets that are not empty."""
    sizes = np.array([len(x) for x in others])
    items = np.concatenate(others)
    hit = a[np.minimum(np.searchsorted(a, items), len(a) - 1)] == items
    common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return common / (len(a) + sizes - common)


def verified(link: np.ndarray, sets: list[np.ndarray], min_jaccard: float) -> np.ndarray:
    """The smallest row of each row's component by those of the (m, m) links whose sets are similar."""
    label, free = np.arange(len(sets), dtype=np.int32), np.ones(len(sets), bool)
    for first in range(len(sets)):
        todo = [first] if free[first] else []
        free[first] = False
        while todo:
            i = todo.pop()
            j = np.flatnonzero(link[i] & free)
            if len(j):
                j = j[similarity(sets[i], [sets[k] for k in j]) >= min_jaccard]
                free[j], label[j] = False, first
                todo += j.tolist()
    return label


def local_links(fp: np.ndarray, size: np.ndarray, max_distance: int, min_jaccard: float, sets: list[np.ndarray] | None = None, step: int = 256) -> np.ndarray:
    """For the rows of (m, w) fingerprints: the smallest row of each row's component by verified links.

    With min_jaccard sizes must allow the similarity, and with sets these must have it.
    """
    m, w = fp.shape
    pivots = mix(np.arange(PIVOTS, dtype=np.uint64), w)
    table = np.stack([np.bitwise_count(fp ^ p).sum(1, dtype=np.int32) for p in pivots], 1)
    link = np.eye(m, dtype=bool)
    for a in range(0, m, step):
        rows = slice(a, min(a + step, m))
        ok = np.arange(m)[None, :] < np.arange(rows.start, rows.stop)[:, None]
        for p in range(PIVOTS):  # the maximum coordinate difference, one coordinate at a time
            ok &= np.abs(table[rows, p][:, None] - table[None, :, p]) <= max_distance
        x, y = np.nonzero(ok)
        x += a
        for k in range(0, len(x), 1 << 17):
            i, j = x[k: k + (1 << 17)], y[k: k + (1 << 17)]
            d = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int32)
            good = d <= max_distance
            if min_jaccard:
                good &= np.minimum(size[i], size[j]) / np.maximum(size[i], size[j]) >= min_jaccard
            link[i[good], j[good]] = link[j[good], i[good]] = True
    if sets:
        return verified(link, sets, min_jaccard)
    label = np.arange(m, dtype=np.int32)
    while True:
        new = label.copy()
        for a in range(0, m, step):
            new[a: a + step] = np.where(link[a: a + step], label[None, :], m).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by g, cut anew so that no group is spread over two."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        g = b["g"].to_numpy()
        if held and held[-1]["g"].iloc[-1] != g[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield pd.concat([*held, b[:cut]], ignore_index=True)
            held = []
        held.append(b[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def block_edges(ws: Workspace, items: DataFrame, keyed: DataFrame, max_distance: int, min_jaccard: float = 0.0, cap: int = 2048) -> DataFrame:
    """(a, b) edges that join linked items.  items: node, fp binary, n int, and the set where similarity is to be verified; keyed: t, k, node, and n with sets, without repeats."""
    sets = ["set"] if "set" in items.columns else []
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("c"), (F.sum("n") if sets else F.lit(0)).alias("total")).where("c > 1")
    chunks = F.least("c", F.ceil(F.greatest(F.col("c") / cap, F.col("total") / (2048 * cap)))).cast("int")
    rows = keyed.select("t", "k", "node").join(sizes, ["t", "k"]).withColumn("s", chunks).withColumn("i", F.pmod(F.xxhash64("node", "t"), F.col("s")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.expr("CASE WHEN s = 1 THEN array(0) ELSE sequence(0, s - 1) END"))).select(
        "node", F.xxhash64("t", "k", F.least("i", "j"), F.greatest("i", "j")).alias("g"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            g, node, size = pdf["g"].to_numpy(), pdf["node"].to_numpy(), pdf["n"].to_numpy()
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
            held = [np.frombuffer(x, np.uint64) for x in pdf["set"]] if sets else None
            cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    to = local_links(fp[a:b], size[a:b], max_distance, min_jaccard, held and held[a:b])
                    own = np.flatnonzero(to != np.arange(b - a))
                    if len(own):
                        yield pd.DataFrame({"a": node[a:b][own], "b": node[a:b][to[own]]})

    rows = rows.join(items, "node").repartition("g").sortWithinPartitions("g", "node")
    return rows.select("g", "node", "fp", "n", *sets).mapInPandas(link, "a long, b long")


def block_masks(n: int, max_distance: int, room: int = 64) -> list[int]:
    """Masks of 64 bits such that two words of at most max_distance differing bits agree under one of them."""
    for m in range(max_distance + 1, 65):
        cuts = [64 * i // m for i in range(m + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(x) for x in itertools.combinations(parts, m - max_distance)]
        if n <= room << min(x.bit_count() for x in masks) or m == 64:
            return masks
    raise ValueError("max_distance is at most 63")


def simhash_components(docs: DataFrame, words: int = 3, max_distance: int = 2, ws: Workspace | None = None, keep: tuple[str, ...] = (), room: int = 64) -> DataFrame:
    """(doc_id, fp long, component_id) and the columns in ``keep``: fingerprints of at most max_distance differing bits are linked."""
    ws = ws or Workspace(docs.sparkSession, "simhash")

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    fps = ws.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), udf("text").alias("fp"), *keep))
    own = ws.write(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [F.col("fp").bitwiseAND(F.lit(signed(m))) for m in block_masks(own.count(), max_distance, room)]
    keyed = own.select(F.col("fp").alias("node"), F.posexplode(F.array(*masks)).alias("t", "k"))
    items = own.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.lit(1).alias("n"))
    edges = ws.write(block_edges(ws, items, keyed, max_distance))
    of = components(ws, edges).join(own.withColumnRenamed("fp", "node"), "node")
    of = ws.write(of)
    least = of.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = of.join(least, "comp").select(F.col("node").alias("fp"), "component_id")
    named = own.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", *keep)


def op9_simhash_neardup(spark, sf_dir):
    from textloom.llm.common import table

    got = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, min_jaccard: float = 0.8, w: int = 16) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id (nulls last).

    Similarity is the Jaccard similarity of the sets of word shingles, candidates by the distance of 64 w-bit fingerprints;
    words are runs of letters and digits in small letters.  Texts without words are copies of each other.
    """
    ws = Workspace(docs.sparkSession, "near_copies")
    rid, sig = clean_name(docs, "_rid"), clean_name(docs, "_sig")

    @F.pandas_udf("fp binary, n int, keys array<long>, c1 long, c2 long")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            plain = plain_words(t)
            fp, n, keys = wide(plain, words, w)
            c = xxhash.xxh3_128_digest(b" ".join(plain))
            c1, c2 = np.frombuffer(c, np.int64)
            rows.append((fp, n, keys, c1, c2))
        return pd.DataFrame(rows, columns=["fp", "n", "keys", "c1", "c2"])

    base = ws.write(docs.withColumn(rid, F.monotonically_increasing_id()))
    sigs = ws.write(base.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), udf("text").alias("sig")).select("rid", "doc_id", "sig.*"))
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    ids = ws.write(sigs.groupBy("c1", "c2").agg(F.min(rank).alias("best"), F.count("*").alias("copies")))
    ids = ids.select("c1", "c2", "copies", "best", F.col("best.rid").alias("node"))
    items = ws.write(sigs.join(ids.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "fp", "n", "keys"))
    keyed = items.where("n > 0").select("node", F.posexplode("keys").alias("t", "k"))
    bound = distance_bound(64 * w, min_jaccard)
    rough = ws.write(components(ws, block_edges(ws, items.drop("keys"), keyed, bound, min_jaccard)))

    @F.pandas_udf("binary")
    def shingle_set(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(plain_words(t), words)).tobytes() for t in texts])

    sets = base.select(F.col(rid).alias("node"), "text").join(rough.select("node"), "node").select("node", shingle_set("text").alias("set"))
    near = ws.write(items.drop("keys").join(sets, "node"))
    keyed = rough.join(items.select("node", "n"), "node").select("node", "n", F.lit(0).alias("t"), F.col("comp").alias("k"))
    of = ws.write(components(ws, block_edges(ws, near, keyed, bound, min_jaccard)))
    best = ids.select("node", "best").join(of, "node").groupBy("comp").agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.rid").alias("rid"))
    lost = of.select(F.col("node").alias("rid")).join(keep, "rid", "left_anti")  # classes whose group keeps another row
    copies = sigs.join(ids.where("copies > 1").select("c1", "c2", "node"), ["c1", "c2"]).where("rid <> node").select("rid")
    gone = ws.write(lost.union(copies)).select(F.col("rid").alias(rid))
    return base.join(gone, rid, "left_anti").select(*docs.columns)
