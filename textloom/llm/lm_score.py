"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Tokens are 64-bit hashes of words (A-Z folded) and one end per text, after two starts.  With c the counts in the training
texts and T the number of distinct words that follow,

    p(w | t u) = max(c(tuw) - D, 0) / c(tu) + D T(tu) / c(tu) p(w | u)
    p(w | u)   = max(c(uw) - D, 0) / c(u) + D T(u) / c(u) p1(w),        p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

and the shorter context alone where the longer one was never seen.

Training and scoring share one exchange, since nearly every n-gram that is counted is asked for as well:

1. Texts are written as blocks of ``block_bytes``; a longer text is spread over several.
2. A block's distinct trigrams, with their counts in its training texts, go to buckets by a hash of their first word,
   in packs of words, successors and their successors.  A bucket covers about ``bucket_bytes`` of text.
3. A bucket's task counts the trigrams of its packs and codes them as a trie: level 1 holds the first words, Elias-Fano
   coded in the order of their hashes; monotone Elias-Fano pointers lead to level 2, the words after each, and from there to
   level 3, as 32-bit hashes behind the number of their context.  Levels 2 and 3 carry quantised discounted probabilities
   and back-off weights (16 bits).  The trie is memory-mapped from a file of the task, and each pack of the bucket is answered by
   successor search within its contexts.
4. Answers go back to the blocks, whose texts are scored.  A word's own totals come from the bucket of its pairs.

Skew.  A word that makes about a bucket's share of all tokens is dealt by its pairs, and a pair that does by its third words
as well; the totals of such words and pairs are summed apart.  Both lists follow from counts of all texts and hold fewer than
2 / hot_share entries, so they go to all tasks.  No context, however frequent, fills one task, and a task holds one bucket
or one block.  Rows of the first exchange are blocks
times buckets, at most one for each distinct trigram of a block.  Counts are 64-bit.

Strings are told apart by 64 bits, words behind a known context by 32.  Defined results: null and empty texts are one end
token; null doc_ids are carried; null held_out is false; repeated rows are scored and counted each; without training texts
c, N and V are 0; extra columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace
from textloom.llm.elias_fano import EliasFano, dump, loaded, mapped

BASE = 0x9E3779B97F4A7C15
START, END, PAD = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547))
SHORT, MASK21, TOP = np.uint64(32), np.uint64((1 << 21) - 1), 1 << 21
DISCOUNT = 0.75
GRID, NONE = 4096, 65535
WHITE = re.compile(rb"[\x20\x09-\x0D]")
IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _words_in(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = IS_WHITE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    power = np.full(int(size.max()), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    first = np.cumsum(size) - size
    h = BYTE[b[~white]]
    h *= power[np.arange(len(h)) - np.repeat(first, size)]
    return start, mix(np.add.reduceat(h, first) + size.astype(np.uint64) * np.uint64(BASE))


def words_of(raw: bytes, slice_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word between ASCII white space, A-Z folded."""
    b, at, got = np.frombuffer(raw.lower(), np.uint8), 0, []
    while at < len(b) or not got:
        end = WHITE.search(raw, at + slice_bytes) if at + slice_bytes < len(b) else None
        end = end.start() if end else len(b)
        start, h = _words_in(b[at:end])
        got.append((start + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _parts(raw: bytes, limit: int) -> Iterator[tuple[bytes, bool, bool, tuple[int, int]]]:
    """(bytes, first?, last?, the two tokens before) of a text, cut at white space about every ``limit`` bytes."""
    at, before = 0, (START, START)
    while True:
        end = WHITE.search(raw, at + limit) if at + limit < len(raw) else None
        piece = raw[at: end.start()] if end else raw[at:]
        yield piece, at == 0, end is None, before
        if end is None:
            return
        at = end.end()
        before = (*before, *words_of(piece)[1][-2:])[-2:]


def frequent(keys: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """(key, count) of the keys that occur that often."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    count = np.diff(np.concatenate((new, [len(keys)])))
    often = count >= least
    return keys[new][often].view(np.int64).tolist(), count[often].tolist()


def _blocks(block_bytes: int, hot_share: float):
    """Rows as blocks, with the hashes and counts of the pairs of words that are frequent in each."""

    def flush(held: list[tuple]) -> pd.DataFrame:
        ids, held_out, rid, raw, first, last, before = zip(*held, strict=True)
        null = np.array([i is None for i in ids])
        arrays = {"raw": np.frombuffer(b"\n".join(raw), np.uint8), "size": np.array([len(x) for x in raw]), "id": np.array([i or 0 for i in ids], np.int64), "null": null, "held": np.array(held_out),
                  "rid": np.array(rid, np.int64), "last": np.array(last), "before": np.array(before, np.uint64).ravel()}
        s = sequence(arrays)
        a, b = s.seq[s.gram - 2], s.seq[s.gram - 1] >> SHORT
        often = [[(level, k, n) for k, n in zip(*frequent(keys, max(8.0, hot_share / 2 * len(a))), strict=True)] for level, keys in ((1, a), (2, pair_key(a, b)))]
        return pd.DataFrame({"block": [uuid.uuid4().int >> 66], "x": [dump(arrays)], "grams": [len(a)], "often": [[dict(zip(("level", "k", "n"), x, strict=True)) for y in often for x in y]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for p in batches:
            for i, h, t in zip(p["doc_id"], p["held_out"], p["text"], strict=True):  # ids as text: pandas has no integer column with nulls
                raw = (t or "").encode("utf-8", "surrogatepass")
                rid = uuid.uuid4().int >> 66 if len(raw) > block_bytes else 0
                for piece, first, last, before in _parts(raw, block_bytes):
                    if held and size + len(piece) > block_bytes:
                        yield flush(held)
                        held, size = [], 0
                    held.append((None if i is None else int(i), bool(h), rid, piece, first, last, before))
                    size += len(piece) + 1
        if held:
            yield flush(held)

    return run


@dataclass
class Sequence:
    """The tokens of a block's parts one after the other, each part behind its two tokens of context."""

    seq: np.ndarray  # 64-bit hashes
    gram: np.ndarray  # positions that end a trigram: tokens and, after each part's last ones, pads, so that each word is a first one
    of: np.ndarray  # the part of each of these
    pad: np.ndarray  # is it a pad?
    real: np.ndarray  # is it to be counted?  All but the pads of parts that their text goes on after


def sequence(x: dict[str, np.ndarray]) -> Sequence:
    start, h = words_of(x["raw"].tobytes())
    size, last = x["size"].astype(np.int64), x["last"].astype(np.int64)
    of = np.searchsorted(np.cumsum(size + 1), start, side="right")
    n = np.bincount(of, minlength=len(size))
    length = 4 + n
    at = np.cumsum(length) - length
    seq = np.empty(int(length.sum()), np.uint64)
    seq[at], seq[at + 1] = x["before"][0::2], x["before"][1::2]
    seq[at[of] + 2 + np.arange(len(h)) - (np.cumsum(n) - n)[of]] = h
    seq[at + 2 + n], seq[at + 3 + n] = np.where(last > 0, END, PAD), PAD
    is_gram, is_pad = np.ones(len(seq), bool), np.zeros(len(seq), bool)
    is_gram[at] = is_gram[at + 1] = False
    is_pad[at + 3 + n] = True
    is_pad[at + 2 + n] = last == 0
    gram = np.flatnonzero(is_gram)
    of, is_pad = np.repeat(np.arange(len(size)), length)[gram], is_pad[gram]
    return Sequence(seq, gram, of, is_pad, ~is_pad | (last[of] > 0))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of first words and the short hashes of the second ones."""
    return mix(a * np.uint64(BASE) + b)


@dataclass
class Hot:
    """Words dealt by their pairs, and split pairs with the number of buckets that each is dealt over; sorted keys."""

    words: np.ndarray
    keys: np.ndarray
    ways: np.ndarray

    @classmethod
    def none(cls) -> Hot:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def number_in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key among the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, i, -1)


@dataclass
class Grams:
    """A block's distinct words, pairs and trigrams, in the order of the packs that are sent to the buckets."""

    words: np.ndarray
    a: np.ndarray  # of each pair its words' numbers
    b: np.ndarray
    hot: np.ndarray  # and its number among the split pairs, or -1
    entry_of: np.ndarray  # and where it is asked (one of the places, if it is split)
    bucket: np.ndarray  # of each entry (a pair in a bucket)
    pair: np.ndarray
    fan: np.ndarray  # its trigrams
    ctx: np.ndarray  # of each trigram its pairs: the context, and the last two words (any for a pad)
    tail: np.ndarray
    c: np.ndarray  # and its last word
    count: np.ndarray  # and its count in the training texts
    number: np.ndarray  # of each position of the sequence its trigram


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def grams(s: Sequence, learn: np.ndarray, buckets: int, hot: Hot) -> Grams:
    words, ids = np.unique(s.seq, return_inverse=True)
    if len(words) >= TOP:
        raise ValueError("a block holds more than 2^21 words: block_bytes is too large")
    ids = ids.astype(np.uint64)
    key = ids[s.gram - 2] << np.uint64(42) | ids[s.gram - 1] << np.uint64(21) | ids[s.gram]
    order = np.argsort(key)
    key = key[order]
    new = changes(key)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    key = key[new]
    count = np.bincount(number, weights=learn[s.of] & s.real, minlength=len(key)).astype(np.int64)
    pairs = key >> np.uint64(21)
    new = changes(pairs)
    ctx, pairs = np.cumsum(new) - 1, pairs[new]
    tail = np.zeros(len(key), np.int64)
    tail[number[:-1]] = ctx[number[1:]]  # the last two words of a position are the context of the next one
    a, b, c = (pairs >> np.uint64(21)).astype(np.int64), (pairs & MASK21).astype(np.int64), (key & MASK21).astype(np.int64)
    pk = pair_key(words[a], words[b] >> SHORT)
    is_hot = number_in(hot.keys, pk)
    own = np.where(number_in(hot.words, words)[a] >= 0, pk, mix(words)[a]) % np.uint64(buckets)
    bucket = own[ctx]
    if len(split := np.flatnonzero(is_hot[ctx] >= 0)):
        ways = hot.ways[is_hot[ctx[split]]].astype(np.uint64)
        bucket[split] = (bucket[split] + mix(words[c[split]] >> SHORT) % ways) % np.uint64(buckets)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, ctx, tail, c, count = bucket[order], ctx[order], tail[order], c[order], count[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    head = np.flatnonzero(changes(bucket, ctx))
    entry_of = np.zeros(len(pairs), np.int64)
    entry_of[ctx[head]] = np.arange(len(head))
    return Grams(words, a, b, is_hot, entry_of, bucket[head].astype(np.int64), ctx[head], np.diff(np.concatenate((head, [len(order)]))), ctx, tail, c, count, place[number])


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers as bytes; 255 stands for one of the 8-byte integers behind them."""
    return np.concatenate((np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype("<i8").view(np.uint8)))


def unsmall(x: np.ndarray, n: int) -> np.ndarray:
    out = x[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(x[n:].tobytes(), "<i8")
    return out


def short(x: np.ndarray) -> np.ndarray:
    return (x >> SHORT).astype("<u4")


def packs(g: Grams) -> Iterator[tuple[int, bytes]]:
    """(bucket, pack): sizes, first words, entries of each, second words, trigrams of each, third words, counts."""
    bucket, a = g.bucket, g.a[g.pair]
    head = np.flatnonzero(changes(bucket, a))
    first = g.words[a[head]].astype("<u8")
    fan = np.diff(np.concatenate((head, [len(bucket)])))
    b, c = short(g.words[g.b[g.pair]]), short(g.words[g.c])
    cut = np.flatnonzero(changes(bucket))
    tri = np.concatenate(([0], np.cumsum(g.fan)))
    cuts = [*cut.tolist(), len(bucket)]
    heads = np.searchsorted(head, cuts).tolist()
    for k, (e0, e1) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        h0, h1, t0, t1 = heads[k], heads[k + 1], tri[e0], tri[e1]
        parts = [small(fan[h0:h1]), small(g.fan[e0:e1]), small(g.count[t0:t1])]
        sizes = np.array([h1 - h0, e1 - e0, t1 - t0, len(parts[0]), len(parts[1])], "<u4")
        yield int(bucket[e0]), b"".join((sizes.tobytes(), first[h0:h1].tobytes(), b[e0:e1].tobytes(), c[t0:t1].tobytes(), *(x.tobytes() for x in parts)))


def unpacked(x: bytes) -> tuple[np.ndarray, ...]:
    """(first words, entries of each, second word of each entry, its trigrams, third word and count of each trigram)."""
    n_a, n_e, n_t, f_a, f_e = np.frombuffer(x, "<u4", 5).tolist()
    y, at = np.frombuffer(x, np.uint8), 20
    cut = []
    for n in (8 * n_a, 4 * n_e, 4 * n_t, f_a, f_e):
        cut.append(y[at: at + n])
        at += n
    whole = lambda z, kind: np.frombuffer(z.tobytes(), kind).astype(np.uint64)
    return whole(cut[0], "<u8"), unsmall(cut[3], n_a), whole(cut[1], "<u4"), unsmall(cut[4], n_e), whole(cut[2], "<u4"), unsmall(y[at:], n_t)


def share_code(p: np.ndarray) -> np.ndarray:
    """16-bit code of a number in (0, 1]."""
    return np.minimum(np.rint(-np.log10(p) * GRID), NONE - 1).astype(np.uint16)


def amount_code(x: np.ndarray) -> np.ndarray:
    """16-bit code of a number from 0.1 to 10^15."""
    return np.minimum(np.rint((np.log10(x) + 1) * GRID), NONE - 1).astype(np.uint16)


SHARE, AMOUNT = 10.0 ** (-np.arange(1 << 16) / GRID), 10.0 ** (np.arange(1 << 16) / GRID - 1)
SHARE[NONE] = AMOUNT[NONE] = 0.0


def behind(ctx: np.ndarray, x: np.ndarray, contexts: int) -> tuple[np.ndarray, int]:
    """(a 32-bit hash behind the number of its context, the bits that are left for it)."""
    width = min(32, 63 - max(1, contexts).bit_length())
    return (ctx.astype(np.uint64) << np.uint64(width)) | x >> np.uint64(32 - width), width


def build_trie(a: np.ndarray, fan_a: np.ndarray, b: np.ndarray, fan_b: np.ndarray, c: np.ndarray, count: np.ndarray, hot: Hot) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(the trie's arrays, totals) of packed trigrams, in any order and with repeats; those with count 0 stay out.

    Totals: sums of the first words that are dealt by pairs (split pairs left out) and of the split pairs, tokens, texts and
    the other first words.
    """
    seen = count > 0
    tri = np.repeat(np.arange(len(b)), fan_b)[seen]  # the entry of each counted trigram
    c, count = c[seen], count[seen]
    used = np.zeros(len(b), bool)
    used[tri] = True
    word = np.repeat(np.arange(len(a)), fan_a)
    top = np.unique(a[np.unique(word[used])])
    rank = np.searchsorted(top, a)[word]  # of each entry its first word's number; only those of used entries matter
    key, width2 = behind(rank, b, len(top))
    second, of = np.unique(key[used], return_inverse=True)
    number = np.zeros(len(b), np.int64)
    number[used] = of
    first_of = np.zeros(len(second), np.int64)
    first_of[of] = np.flatnonzero(used)  # an entry for each pair
    key, width3 = behind(number[tri], c, len(second))
    order = np.argsort(key)
    third, count, c = key[order], count[order], c[order]
    head = np.flatnonzero(changes(third))
    third, c, count = third[head], c[head], np.add.reduceat(count, head) if len(head) else count
    pair_of = (third >> np.uint64(width3)).astype(np.int64)
    word_of = (second >> np.uint64(width2)).astype(np.int64)
    mid = np.searchsorted(pair_of, np.arange(len(second)))
    total = np.add.reduceat(count, mid) if len(mid) else count
    fan = np.diff(np.concatenate((mid, [len(third)])))
    pair_a, pair_b = top[word_of], b[first_of]
    split = number_in(hot.keys, pair_key(pair_a, pair_b))
    own = split < 0
    prob = np.where(own[pair_of], share_code((count - DISCOUNT) / total[pair_of]), amount_code(count - DISCOUNT)) if len(c) else np.zeros(0, np.uint16)
    first = np.searchsorted(word_of, np.arange(len(top)))
    trie = {"pair": amount_code(total - DISCOUNT), "rest": share_code(np.minimum(1.0, DISCOUNT * fan / total)), "prob": prob.astype(np.uint16), "width": np.array([width2, width3]),
            **EliasFano.encode(top, 1 << 64).parts("words"), **EliasFano.encode(second, max(1, len(top)) << width2).parts("second"), **EliasFano.encode(third, max(1, len(second)) << width3).parts("third"),
            **EliasFano.encode(np.concatenate((first, [len(second)])), len(second) + 1).parts("to_second"), **EliasFano.encode(np.concatenate((mid, [len(third)])), len(third) + 1).parts("to_third")}
    real = own & ~((pair_a == START) & (pair_b == START >> SHORT))  # nothing precedes a text's first word
    pads = c == PAD >> SHORT
    sums, fans = np.bincount(word_of[real], weights=total[real], minlength=len(top)).astype(np.int64), np.bincount(word_of[real], minlength=len(top))
    trie |= {"count": sums, "back": share_code(np.minimum(1.0, np.maximum(DISCOUNT * fans, 1e-9) / np.maximum(sums, 1)))}
    spread = number_in(hot.words, top) >= 0
    totals = {"word": top[spread], "count": sums[spread], "fan": fans[spread], "hot": hot.keys[split[~own]], "hot_word": pair_a[~own], "hot_count": total[~own], "hot_fan": fan[~own],
              "tokens": np.array([count[~pads].sum(), count[pads].sum(), (~spread & (sums > 0) & (top != START)).sum()])}
    return trie, totals


class Trie:
    """Successor search in a memory-mapped trie.  The places of zeros and the pointers are unpacked for a batch of questions."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.words, self.second, self.third = (EliasFano.load(arrays, k).unpack_zeros() for k in ("words", "second", "third"))
        self.to_second, self.to_third = (EliasFano.load(arrays, k).values().astype(np.int64) for k in ("to_second", "to_third"))
        self.width = arrays["width"].tolist()

    def _under(self, ctx: np.ndarray, x: np.ndarray, level: EliasFano, to: np.ndarray, width: int) -> np.ndarray:
        """Of each word behind its context (numbers, -1: unknown) the number on the next level, or -1."""
        out = np.full(len(ctx), -1)
        known = np.flatnonzero(ctx >= 0)
        own = ctx[known]
        i, hit = level.find((own.astype(np.uint64) << np.uint64(width)) | x[known] >> np.uint64(32 - width))
        hit &= (i >= to[own]) & (i < to[own + 1])
        out[known[hit]] = i[hit]
        return out

    def ask(self, a: np.ndarray, fan_a: np.ndarray, b: np.ndarray, fan_b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count and code of the back-off weight of each first word, codes of each entry's discounted count and back-off weight, and of each trigram's probability."""
        i, hit = self.words.find(a)
        pair = self._under(np.repeat(np.where(hit, i, -1), fan_a), b, self.second, self.to_second, self.width[0])
        tri = self._under(np.repeat(pair, fan_b), c, self.third, self.to_third, self.width[1])
        pick = lambda codes, k: np.where(k >= 0, codes[np.maximum(k, 0)] if len(codes) else NONE, NONE).astype(np.uint16)
        word = np.where(hit, i, -1)
        count = np.where(hit, self.arrays["count"][np.where(hit, i, 0)], 0) if hit.any() else np.zeros(len(a), np.int64)
        return count, pick(self.arrays["back"], word), pick(self.arrays["pair"], pair), pick(self.arrays["rest"], pair), pick(self.arrays["prob"], tri)


SENT = "bucket int, block long, x binary"
ANSWERS = "kind int, block long, part int, x binary"
CODES, SPLIT, SUMS = range(3)


def _ask(buckets: int, hot: Hot):
    """Packs for the buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for block, x in zip(p["block"], p["x"], strict=True):
                arrays = loaded(x)
                g = grams(sequence(arrays), ~arrays["held"], buckets, hot)
                yield pd.DataFrame([(b, block, y) for b, y in packs(g)], columns=["bucket", "block", "x"])

    return run


def _answer(hot: Hot):
    """Rows come sorted by bucket: its packs are counted, coded and answered."""

    def solve(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
        parts = list(zip(*(unpacked(x) for _, x in rows), strict=True))
        sizes = [[len(x) for x in parts[k]] for k in (0, 2, 4)]
        *packed, count = (np.concatenate(x) for x in parts)
        arrays, totals = build_trie(*packed, count, hot)
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            path = os.path.join(folder, "levels")
            with open(path, "wb") as f:
                f.write(dump(arrays))
            n, back, pair, rest, prob = Trie(mapped(path)).ask(*packed)
        out, a, e, t = [], 0, 0, 0
        for (block, _), i, j, k in zip(rows, *sizes, strict=True):
            out.append((CODES, block, b"".join(x.tobytes() for x in (pair[e: e + j], rest[e: e + j], prob[t: t + k], back[a: a + i], small(n[a: a + i])))))
            a, e, t = a + i, e + j, t + k
        if len(totals["word"]):
            out.append((SPLIT, 0, dump({k: totals[k] for k in ("word", "count", "fan", "hot", "hot_word", "hot_count", "hot_fan")})))
        out.append((SUMS, 0, dump({"tokens": totals["tokens"]})))
        return pd.DataFrame(out, columns=["kind", "block", "x"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for p in batches:
            for bucket, block, x in zip(p["bucket"], p["block"], p["x"], strict=True):
                if bucket != at and held:
                    yield solve(held).assign(part=at)[["kind", "block", "part", "x"]]
                    held = []
                at = bucket
                held.append((block, x))
        if held:
            yield solve(held).assign(part=at)[["kind", "block", "part", "x"]]

    return run


@dataclass
class Sums:
    """Totals of the words and pairs that were dealt over several buckets, in the order of ``Hot``."""

    word_count: np.ndarray
    word_fan: np.ndarray
    pair_count: np.ndarray
    pair_fan: np.ndarray


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(buckets: int, hot: Hot, sums: Sums, texts: int, scale: float):
    """Rows come sorted by (block, kind, part): the texts, then the buckets' answers."""

    def solve(arrays: dict[str, np.ndarray], answers: list[bytes]) -> pd.DataFrame:
        s = sequence(arrays)
        g = grams(s, ~arrays["held"], buckets, hot)
        cut = np.concatenate((np.flatnonzero(changes(g.bucket)), [len(g.bucket)]))
        tri = np.concatenate(([0], np.cumsum(g.fan)))[cut]
        a = g.a[g.pair]
        head = np.flatnonzero(changes(g.bucket, a))
        got = []
        for x, j, k, i in zip(answers, np.diff(cut).tolist(), np.diff(tri).tolist(), np.diff(np.searchsorted(head, cut)).tolist(), strict=True):
            codes = np.frombuffer(x, np.uint16, 2 * j + k + i)
            got.append((*np.split(codes, (j, 2 * j, 2 * j + k)), unsmall(np.frombuffer(x, np.uint8)[2 * len(codes):], i)))
        pair, rest, prob, back_code, n = (np.concatenate(x) for x in zip(*got, strict=True))
        count, back = np.zeros(len(g.words)), np.zeros(len(g.words))
        count[a[head]], back[a[head]] = n, SHARE[back_code]
        spread = number_in(hot.words, g.words)
        if len(w := np.flatnonzero(spread >= 0)):
            c, f = sums.word_count[spread[w]], sums.word_fan[spread[w]]
            count[w], back[w] = c, DISCOUNT * f / np.maximum(c, 1)
        context, end = count.copy(), np.searchsorted(g.words, END)
        if end < len(g.words) and g.words[end] == END:
            count[end] = texts
        p1 = (count + 0.5) / scale
        # of each pair its discounted count, its count and its back-off weight
        is_hot, entry = g.hot >= 0, g.entry_of
        kept = np.where(is_hot, 0.0, AMOUNT[pair[entry]])
        weight, known = SHARE[rest[entry]], rest[entry] != NONE
        if is_hot.any():
            i = g.hot[is_hot]
            c, f = sums.pair_count[i], sums.pair_fan[i]
            kept[is_hot], weight[is_hot], known[is_hot] = np.maximum(c - DISCOUNT, 0), DISCOUNT * f / np.maximum(c, 1), c > 0
        seen = context[g.a] > 0
        p2 = np.where(seen, kept / np.maximum(context[g.a], 1) + back[g.a] * p1[g.b], p1[g.b])
        share = SHARE[prob]
        if len(i := np.flatnonzero(is_hot[g.ctx])):
            share[i] = AMOUNT[prob[i]] / np.maximum(sums.pair_count[g.hot[g.ctx[i]]], 1)
        p3 = np.where(known[g.ctx], share + weight[g.ctx] * p2[g.tail], p2[g.tail])
        token = ~s.pad
        at, of, n = g.number[token], s.of[token], len(arrays["size"])
        total = lambda x: np.bincount(of, weights=x[at], minlength=n)
        return pd.DataFrame({"rid": arrays["rid"], "doc_id": pd.array(np.where(arrays["null"], 0, arrays["id"]), "Int64"), "null": arrays["null"].astype(bool), "held_out": arrays["held"].astype(bool),
                             "n_tokens": np.bincount(of, minlength=n), "n_known": total((count[g.c] > 0).astype(float)).astype(np.int64), "base_score": total(np.log10(p1[g.c])), "score": total(np.log10(p3))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, answers = None, None, []
        for p in batches:
            for block, kind, x in zip(p["block"], p["kind"], p["x"], strict=True):
                if block != at:
                    if at is not None:
                        yield solve(held, answers)
                    at, answers = block, []
                if kind < 0:
                    held = loaded(x)
                else:
                    answers.append(x)
        if at is not None:
            yield solve(held, answers)

    return run


@dataclass
class Scored:
    rows: DataFrame  # OUT
    tokens: int  # of the training texts
    words: int  # distinct ones, with the end
    hot_pairs: int


def lm_score(docs: DataFrame, bucket_bytes: int = 4 << 20, block_bytes: int = 4 << 20, hot_share: float = 2e-5) -> Scored:
    """Scores all rows of (doc_id, held_out, text) by the model of those that are not held out."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out"), "text")
    blocks = ws.write(docs.mapInPandas(_blocks(block_bytes, hot_share), "block long, x binary, grams long, often array<struct<level:int,k:long,n:long>>"))
    size, total = blocks.agg(F.coalesce(F.sum(F.length("x").cast("long")), F.lit(0)), F.coalesce(F.sum("grams"), F.lit(0))).first()
    buckets = max(16, -(-size // bucket_bytes))
    often = blocks.select(F.inline("often")).groupBy("level", "k").agg(F.sum("n").alias("n")).where(F.col("n") > max(hot_share, min(hot_share * 1000, 1 / buckets)) / 2 * total)
    often = sorted((r["level"], r["k"] % (1 << 64), r["n"]) for r in often.collect())  # fewer than 2 / hot_share rows of each level
    pairs = [(k, n) for level, k, n in often if level == 2]
    ways = [min(buckets, 1 + -(-4 * n * buckets // max(1, total))) for _, n in pairs]
    hot = Hot(np.array([k for level, k, _ in often if level == 1], np.uint64), np.array([k for k, _ in pairs], np.uint64), np.array(ways, np.int64))
    sent = blocks.select("block", "x").mapInPandas(_ask(buckets, hot), SENT)
    sent = sent.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket", "block")
    answers = ws.write(sent.mapInPandas(_answer(hot), ANSWERS), batch_rows=4)
    sums = _sums(answers, hot)
    tokens = texts = v = 0
    for r in answers.where(F.col("kind") == SUMS).select("x").mapInPandas(_token_sums, "tokens long, texts long, words long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "texts", "words")]).collect():
        tokens, texts, v = r
    v += int(((sums.word_count > 0) & (hot.words != START)).sum()) + (texts > 0)
    back = blocks.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "x").union(answers.where(F.col("kind") == CODES).select("block", F.lit(0), "part", "x"))
    back = back.repartition("block").sortWithinPartitions("block", "kind", "part").select("block", "kind", "x")
    rows = ws.write(back.mapInPandas(_finish(buckets, hot, sums, texts, tokens + 0.5 * (v + 1)), f"rid long, {OUT.replace('held', 'null boolean, held', 1)}"), batch_rows=4)
    for x in (blocks, answers):
        ws.drop(x)
    one = rows.where("rid = 0")
    many = rows.where("rid <> 0").groupBy("rid", "doc_id", "null", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    out = one.unionByName(many).select(F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", "base_score", "score")
    return Scored(out, tokens, v, len(pairs))


def _split_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        for x in map(loaded, p["x"]):
            yield pd.DataFrame({"level": 1, "k": x["word"].view(np.int64), "word": 0, "n": x["count"], "fan": x["fan"]})
            yield pd.DataFrame({"level": 2, "k": x["hot"].view(np.int64), "word": x["hot_word"].view(np.int64), "n": x["hot_count"], "fan": x["hot_fan"]})


def _sums(answers: DataFrame, hot: Hot) -> Sums:
    """Sums over the buckets, of fewer than 2 / hot_share words and as many pairs."""
    out = Sums(*(np.zeros(n, np.int64) for n in (len(hot.words), len(hot.words), len(hot.keys), len(hot.keys))))
    if not len(hot.words):
        return out
    split = answers.where(F.col("kind") == SPLIT).select("x").mapInPandas(_split_sums, "level int, k long, word long, n long, fan long")
    got = split.groupBy("level", "k").agg(F.min("word").alias("word"), F.sum("n").alias("n"), F.sum("fan").alias("fan")).toPandas()
    starts = pair_key(np.array([START]), np.array([START >> SHORT]))[0]
    words, pairs = got[got["level"] == 1], got[got["level"] == 2]
    i = number_in(hot.words, words["k"].to_numpy(np.int64).view(np.uint64))
    out.word_count[i], out.word_fan[i] = words["n"], words["fan"]
    key = pairs["k"].to_numpy(np.int64).view(np.uint64)
    i = number_in(hot.keys, key)
    out.pair_count[i], out.pair_fan[i] = pairs["n"], pairs["fan"]
    real = (pairs["n"].to_numpy() > 0) & (key != starts)  # two starts are no pair of a text
    of = number_in(hot.words, pairs["word"].to_numpy(np.int64).view(np.uint64))[real]
    np.add.at(out.word_count, of, pairs["n"].to_numpy(np.int64)[real])
    np.add.at(out.word_fan, of, 1)
    return out


def _token_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        got = np.sum([loaded(x)["tokens"] for x in p["x"]], axis=0, dtype=np.int64)
        yield pd.DataFrame({"tokens": [got[0]], "texts": [got[1]], "words": [got[2]]})


def op10_lm_score(spark, sf_dir):
    from textloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    got = lm_score(docs)
    return got.rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(got.tokens).cast("long").alias("train_tokens"), "base_score", "score")
