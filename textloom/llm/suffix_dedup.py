"""Removal of long repeated byte strings, by suffix arrays over anchored segments.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.  A corpus does not fit one
suffix array, so equal strings must meet in one task without moving every suffix:

1. Each window of ``length`` bytes has an anchor, its leftmost k-gram of the smallest hash; equal windows have equal
   anchors at equal offsets.  Consecutive windows with one anchor form a segment (about one per 85 bytes).
2. Anchors and segments are counted by hash.  Anchors seen once hold no repeat; segments that are equal are one row with
   a count.  Only the distinct segments of repeated anchors are read again, as bytes, and dealt by anchor.
3. A task codes its segments as 40-byte symbols aligned at the anchor, builds a suffix array over all of them (module
   ``suffix_array``: linear grouping) and reads off the suffixes that share all whole symbols of a window.  Inside such
   a run the 40 bytes around the symbols are compared, so that windows are told apart to the byte.
4. Repeated windows go back to their documents and are united into spans there.

An anchor with more than ``hot`` distinct segments (a frequent line in ever new surroundings) would fill one task.  Its
segments are cut into pieces of ``WIDTH`` window starts, and a piece is dealt by the bytes that all windows of its range
share (its core, about 180 of 200): equal windows have equal cores, so step 3 runs on each core's pieces.  A core that
still has more than ``hot`` distinct pieces is dealt by the whole window, whose core it is itself: its groups hold one
string each, so counting them (with map-side combination) is all that is left to sort.  Each step is exact.

Memory: a task holds one chunk of ``chunk_bytes`` and the pieces of one group, at most ``hot`` of them; texts are read in
parts of 64 KB and what is cut from them is passed on by bytes.

Hashes are 64 bits of segment content below a 64-bit anchor hash.  Rows are told apart by (doc_id, hash of the text):
rows equal in both are copies and get the same answer.

Defined results: null text is empty; texts shorter than ``length`` keep everything; null doc_ids, repeated rows, ties
and extra columns do no harm; an empty table gives no rows; very long texts are read in overlapping parts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace
from textloom.llm.suffix_array import suffix_array

KGRAM, PART, LOW = 32, 1 << 16, 20
WIDTH = 20
SYMBOL = 40
BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if len(POWERS.get(base, ())) <= n:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return POWERS[base]


class Hashes:
    """Polynomial hashes of all substrings of a buffer."""

    def __init__(self, buf: np.ndarray, byte: np.ndarray = BYTE, base: int = BASE):
        n = len(buf)
        size = 1 << max(10, n.bit_length())
        self.back = _powers(size, pow(base, -1, 1 << 64))[: n + 1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[buf] * _powers(size, base)[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a])

    def sliding(self, w: int) -> np.ndarray:
        """Those of each w consecutive bytes."""
        return _mix((self.sums[w:] - self.sums[:-w]) * self.back[:-w])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    done = 1
    while 2 * done <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (w - done)], x[w - done:])


def segments(buf: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Of a buffer of texts that end at ``ends``: text, anchor, first and last window start, anchor and content hash."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "a", "p0", "p1", "h", "sid")}
    n = len(buf)
    if n < length:
        return none
    hs = Hashes(buf)
    gram = hs.sliding(KGRAM)
    low = np.uint64((1 << LOW) - 1)
    a = (window_min(gram & ~low | np.arange(len(gram), dtype=np.uint64), length - KGRAM + 1) & low).astype(np.int64)
    good = np.ones(n - length + 1, bool)  # windows inside one text
    for e in ends[:-1].tolist():
        good[max(0, e - length + 1): e] = False
    new = np.ones(len(good), bool)
    new[1:] = a[1:] != a[:-1]
    new[1:] |= ~good[:-1]
    last = np.ones(len(good), bool)
    last[:-1] = new[1:]
    last[:-1] |= ~good[1:]
    p0, p1 = np.flatnonzero(new & good), np.flatnonzero(last & good)
    if not len(p0):
        return none
    a = a[p0]
    sid = _mix(hs.of(p0, p1 + length) + (a - p0).astype(np.uint64) * np.uint64(BASE))
    return {"text": np.searchsorted(ends, p0, side="right"), "a": a, "p0": p0, "p1": p1, "h": gram[a].view(np.int64), "sid": sid.view(np.int64)}


def texts_in_parts(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most about PART bytes: (bytes, part ends, text of each part, offset of each part in its text)."""
    held: list[bytes] = []
    of: list[int] = []
    off: list[int] = []
    size = 0

    def flush():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(of), np.array(off)

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), PART - length + 1):
            piece = t[s: s + PART]
            if size and size + len(piece) > PART:
                yield flush()
                held, of, off, size = [], [], [], 0
            held.append(piece)
            of.append(i)
            off.append(s)
            size += len(piece)
    if held:
        yield flush()


def repeated_windows(rows: list[tuple[int, int, int, bytes]], length: int) -> list[np.ndarray]:
    """rows: (anchor group, count, lo, bytes): a segment's bytes, whose windows start lo bytes before the anchor and on.

    For each row a boolean per window: does the window start more than once among the rows, counts included?
    """
    b = SYMBOL
    full = length // b - 1
    m = len(rows)
    groups = np.array([r[0] for r in rows])
    count = np.array([r[1] for r in rows])
    lo = np.array([r[2] for r in rows])
    size = np.array([len(r[3]) for r in rows])
    n_win = size - length + 1
    skip = lo % b  # bytes before the first boundary aligned at the anchor
    n_sym = (size - skip) // b
    hs = Hashes(np.frombuffer(b"".join(r[3] for r in rows), np.uint8))
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    row = np.repeat(np.arange(m), n_sym)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n_sym) - n_sym, n_sym)
    pos = (at + skip)[row] + k * b  # of each symbol in the bytes
    names = np.unique(hs.of(pos, pos + b), return_inverse=True)[1]
    # rows one after another, each closed by a separator of its own that is smaller than all symbols
    n = len(row) + m
    seq = np.empty(n, np.int64)
    where = np.arange(len(row)) + row  # of each symbol in seq
    seq[where] = names + m
    seq[np.cumsum(n_sym + 1) - 1] = np.arange(m)
    sa = suffix_array(seq)
    padded = np.concatenate((seq, np.full(full, -1)))
    differ = np.zeros(n - 1, bool)
    for d in range(full):
        differ |= padded[sa[1:] + d] != padded[sa[:-1] + d]
    run = np.empty(n, np.int64)
    run[sa] = np.cumsum(np.concatenate(([False], differ)))
    run = run[where]
    good = k + full <= n_sym[row]  # suffixes of enough whole symbols
    row, k, pos, run = row[good], k[good], pos[good], run[good]
    out = [np.zeros(w, bool) for w in n_win]
    if not len(row):
        return out
    # the anchor and the offset from it must agree as well: equal windows have both
    rel = skip[row] + k * b - lo[row]
    order = np.lexsort((row, rel, groups[row], run))
    row, k, pos, run, rel = row[order], k[order], pos[order], run[order], rel[order]
    g = groups[row]
    same = (run[1:] == run[:-1]) & (rel[1:] == rel[:-1]) & (g[1:] == g[:-1])
    run = np.cumsum(np.concatenate(([True], ~same)))
    flat = np.concatenate(([0], np.cumsum(n_win)[:-1]))
    hit = np.zeros(int(n_win.sum()), bool)
    weight = np.bincount(run, weights=count[row]).astype(np.int64)
    alone = weight[run] < 2
    row, k, pos, run = row[~alone], k[~alone], pos[~alone], run[~alone]
    for t in range(b):
        # the window starts t bytes before the boundary: t bytes, the whole symbols, and the rest
        start = skip[row] + k * b - t
        ok = (start >= 0) & (start < n_win[row])
        r, ps, rn, st = row[ok], pos[ok], run[ok], start[ok]
        if not len(r):
            continue
        key = hs.of(ps - t, ps) * np.uint64(BASE) + hs.of(ps + full * b, ps + length - t)
        order = np.lexsort((key, rn))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (rn[order][1:] != rn[order][:-1])))
        ident = np.empty(len(r), np.int64)
        ident[order] = np.cumsum(new) - 1
        total = np.bincount(ident, weights=count[r])
        hit[(flat[r] + st)[total[ident] >= 2]] = True
    return [hit[f: f + w] for f, w in zip(flat, n_win, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


SEG = "did long, tid long, h array<long>, sid array<long>, a array<int>, lo array<int>, hi array<int>"
RUNS = "h long, sid long, s int, e int"


def _encode(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _segments_of(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            did, tid = p["did"].to_numpy(), p["tid"].to_numpy()
            parts = texts_in_parts((_encode(t) for t in p["text"]), length)
            while some := [_per_text(part, length) for part in itertools.islice(parts, 16)]:
                got = pd.concat(some)
                if len(got):
                    yield pd.DataFrame({"did": did[got["i"]], "tid": tid[got["i"]]} | {c: got[c].to_numpy() for c in ("h", "sid", "a", "lo", "hi")})

    return run


def _per_text(part, length: int) -> pd.DataFrame:
    buf, ends, of, off = part
    s = segments(buf, ends, length)
    begin = ends - np.diff(np.concatenate(([0], ends)))
    shift = off[s["text"]] - begin[s["text"]] if len(s["text"]) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], s["text"][1:] != s["text"][:-1]))) if len(s["text"]) else np.zeros(0, int)
    bounds = [*cut.tolist(), len(s["text"])]
    rows = []
    for x, y in zip(bounds, bounds[1:], strict=False):
        a = s["a"][x:y]
        rows.append((int(of[s["text"][x]]), s["h"][x:y], s["sid"][x:y], (a + shift[x:y]).astype(np.int32), (a - s["p0"][x:y]).astype(np.int32), (a - s["p1"][x:y]).astype(np.int32)))
    return pd.DataFrame(rows, columns=["i", "h", "sid", "a", "lo", "hi"])


CUT = "h long, sid long, n long, lo int, seg binary, core long, piece long"
LEAP = 4 << 20  # bytes that a task passes on at once


def _in_steps(rows: Iterable[tuple], columns: list[str], size_of) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += size_of(r) + 200
        if size > LEAP:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _digest64(*parts: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(b"".join(parts)), "little", signed=True)


def pieces_of(h: int, lo: int, hi: int, seg: bytes, length: int, width: int = WIDTH) -> Iterator[tuple[int, int, int, bytes]]:
    """(core, piece, lo, bytes) of a segment whose windows start lo to hi bytes before its anchor.

    A piece holds the windows that start in one range of ``width`` bytes; its core hashes the bytes that all windows of
    the whole range share, and the range itself.
    """
    for c in range(hi // width, lo // width + 1):
        top, low = min(lo, c * width + width - 1), max(hi, c * width)
        at = lo - top
        body = seg[at: lo - low + length]
        core = seg[lo - c * width: lo - (c * width + width - 1) + length]
        yield _digest64(h.to_bytes(8, "little", signed=True), c.to_bytes(4, "little"), core), _digest64(top.to_bytes(4, "little"), body), top, body


def _cut_segments(length: int):
    """Bytes of the wanted segments; those of hot anchors in pieces."""

    def rows(p: pd.DataFrame) -> Iterator[tuple]:
        for text, want in zip(p["text"], p["want"], strict=True):
            t = _encode(text)
            for w in want:
                lo, hi = w["lo"], w["hi"]
                seg = t[w["a"] - lo: w["a"] - hi + length]
                if not w["hot"]:
                    yield w["h"], w["sid"], w["n"], lo, seg, None, None
                    continue
                for core, piece, top, body in pieces_of(w["h"], lo, hi, seg, length):
                    yield w["h"], w["sid"], w["n"], top, body, core, piece

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for out in _in_steps(rows(p), ["h", "sid", "n", "lo", "seg", "core", "piece"], lambda r: len(r[4])):
                yield out.astype({"core": "Int64", "piece": "Int64"})

    return run


def _windows(length: int):
    """Each window of a piece by a 128-bit hash."""

    def rows(p: pd.DataFrame) -> Iterator[tuple]:
        for core, piece, n, lo, seg in zip(p["h"], p["sid"], p["n"], p["lo"], p["seg"], strict=True):
            for i in range(len(seg) - length + 1):
                w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(seg[i: i + length]), "<i8").tolist()
                yield core, piece, n, i - lo, w1, w2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield from _in_steps(rows(p), ["h", "sid", "n", "s", "w1", "w2"], lambda r: 0)

    return run


def _sort_segments(length: int, chunk_bytes: int):
    """Rows come sorted by group (an anchor or a core); whole groups are taken together until a chunk is full."""

    def solve(held: list[tuple]) -> pd.DataFrame | None:
        got = repeated_windows([(r[0], r[2], r[3], r[4]) for r in held], length)
        out = []
        for r, flags in zip(held, got, strict=True):
            for s, e in zip(*runs(flags), strict=True):
                out.append((r[0], r[1], int(s) - r[3], int(e) - r[3]))
        return pd.DataFrame(out, columns=["h", "sid", "s", "e"]) if out else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for p in batches:
            for r in zip(p["h"], p["sid"], p["n"], p["lo"], p["seg"], strict=True):
                if size > chunk_bytes and r[0] != held[-1][0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _sorted_runs(rows: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """RUNS of repeated windows among the rows (h, sid, n, lo, seg) of each h."""
    dealt = rows.select("h", "sid", "n", "lo", "seg").repartition("h").sortWithinPartitions("h", "sid")
    return dealt.mapInPandas(_unique_rows(_sort_segments(length, chunk_bytes)), RUNS)


def _hot(kinds: DataFrame, hot: int) -> DataFrame:
    """(h, hot) of the groups that hold more than one window start."""
    return kinds.groupBy("h").agg(F.sum("n").alias("total"), (F.count("*") > hot).alias("hot")).where("total > 1").select("h", "hot")


def _runs_of_pieces(ws: Workspace, pieces: DataFrame, length: int, hot: int, chunk_bytes: int) -> DataFrame:
    """RUNS of the segments that were cut into pieces."""
    own = pieces.repartition("core", "piece").groupBy("core", "piece", "h", "sid").agg(*[F.first(c).alias(c) for c in ("n", "lo", "seg")])  # a repeated row's only once
    own = own.groupBy(F.col("core").alias("h"), F.col("piece").alias("sid")).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("lo", "seg")])
    kinds = ws.write(own)
    dealt = kinds.join(_hot(kinds, hot), "h")
    windows = ws.write(dealt.where("hot").select("h", "sid", "n", "lo", "seg").mapInPandas(_windows(length), "h long, sid long, n long, s int, w1 long, w2 long"))
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("c")).where("c > 1")
    singles = windows.join(twice, ["w1", "w2"]).select("h", "sid", "s", (F.col("s") + 1).alias("e"))
    found = _sorted_runs(dealt.where("NOT hot"), length, chunk_bytes).union(singles)
    found = found.groupBy("h", "sid").agg(F.collect_list(F.struct("s", "e")).alias("r")).select(F.col("h").alias("core"), F.col("sid").alias("piece"), "r")
    return pieces.select("h", "sid", "core", "piece").distinct().join(found, ["core", "piece"]).select("h", "sid", F.inline("r"))


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = 2000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(did, tid, starts): runs [s, e) of the window starts that are repeated, for the texts that have any."""
    ws = Workspace(docs.sparkSession, "suffix_dedup")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("did"), F.xxhash64("text").alias("tid"), "text")
    segs = ws.write(keyed.mapInPandas(_segments_of(length), SEG))
    flat = segs.select("did", "tid", F.expr("inline(arrays_zip(h, sid, a, lo, hi))"))
    rep = F.min(F.struct("did", "tid", "a", "lo", "hi")).alias("rep")
    kinds = ws.write(flat.groupBy("h", "sid").agg(F.count("*").alias("n"), rep))
    wanted = kinds.join(_hot(kinds, hot), "h").select("rep.did", "rep.tid", F.struct("h", "sid", F.col("n").cast("long").alias("n"), F.col("rep.a").alias("a"), F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"), "hot").alias("w"))
    wanted = wanted.groupBy("did", "tid").agg(F.collect_list("w").alias("want"))
    one_each = keyed.join(wanted, ["did", "tid"])  # repeated rows give repeated segments, which the next step tells apart by (h, sid)
    cut = ws.write(one_each.select("text", "want").mapInPandas(_cut_segments(length), CUT))
    ws.drop(kinds)
    found = _sorted_runs(cut.where("core is null"), length, chunk_bytes)
    found = found.union(_runs_of_pieces(ws, cut.where("core is not null"), length, hot, chunk_bytes))
    found = ws.write(found.groupBy("h", "sid").agg(F.collect_list(F.struct("s", "e")).alias("r")))
    ws.drop(cut)
    back = flat.select("h", "sid", "did", "tid", "a").join(found, ["h", "sid"])
    back = back.select("did", "tid", F.transform("r", lambda x: F.struct((x["s"] + F.col("a")).alias("s"), (x["e"] + F.col("a")).alias("e"))).alias("r"))
    out = ws.write(back.groupBy("did", "tid").agg(F.flatten(F.collect_list("r")).alias("starts")))
    ws.drop(segs)
    ws.drop(found)
    return out


def _unique_rows(then):
    """Rows are sorted; a segment that copies of a row brought twice is taken once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def once():
            last = None
            for p in batches:
                keep = ~p.duplicated(["h", "sid"])
                if last is not None and len(p):
                    keep &= ~((p["h"] == last[0]) & (p["sid"] == last[1]))
                if len(p):
                    last = (p["h"].iloc[-1], p["sid"].iloc[-1])
                yield p[keep]

        return then(once())

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """(doc_id, text, spans): the maximal removed byte runs [start, end) of each row's UTF-8 text."""
    spans = repeated_spans(docs, length, **options)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("did"), F.xxhash64("text").alias("tid"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def unite(starts: pd.Series) -> pd.Series:
        out = []
        for x in starts:
            got: list[dict[str, int]] = []
            for s, e in sorted((int(y["s"]), int(y["e"])) for y in (x if x is not None else ())):
                if got and s <= got[-1]["end"]:
                    got[-1]["end"] = max(got[-1]["end"], e - 1 + length)
                else:
                    got.append({"start": s, "end": e - 1 + length})
            out.append(got)
        return pd.Series(out, dtype=object)

    return keyed.join(spans, ["did", "tid"], "left").select("doc_id", "text", unite("starts").alias("spans"))


def op3_suffix_dedup(spark, sf_dir):
    from textloom.llm.common import table

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for i, text, spans in zip(p["doc_id"], p["text"], p["spans"], strict=True):
                t = _encode(text)
                h, at, gone = hashlib.sha256(), 0, 0
                for x in spans:
                    h.update(t[at: x["start"]])
                    at = x["end"]
                    gone += x["end"] - x["start"]
                h.update(t[at:])
                rows.append((i, len(t), gone, len(spans), h.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInPandas(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
