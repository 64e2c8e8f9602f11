"""Hashes.  64-bit values are 16 lowercase hex digits, 32-bit ones LongType.

FNV-1a and CRC-32C run over many texts at a time: step k folds the k-th byte of every text that has one.  CRC-32C takes
1,024 bytes of a text as a text of its own and then joins them, so that long texts take no more steps.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType

from textloom.functions.batches import pieces
from textloom.functions.scan import col

MASK = (1 << 64) - 1


def crc32(c) -> Column:
    return F.crc32(col(c))


def _fold(texts: list[bytes], start: int, dtype, step) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    return _fold_at(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, np.full(len(texts), start, dtype), step)


def _fold_at(data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, step) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    begin, state, longest = begin[order], state[order], size[order]
    live = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), side="right")
    for k, n in enumerate(live.tolist()):
        state[:n] = step(state[:n], data[begin[:n] + k])
    out = np.empty_like(state)
    out[order] = state
    return out


def fnv1a_batch(texts: list[bytes]) -> np.ndarray:
    prime = np.uint64(0x100000001B3)
    return _fold(texts, 0xCBF29CE484222325, np.uint64, lambda h, b: (h ^ b) * prime)


def _castagnoli() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


CHUNK = 1024


def crc32c_batch(texts: list[bytes]) -> np.ndarray:
    """A text is a first chunk of at most 1,024 bytes and full ones.  The state behind two strings is that behind the first
    and 1,024 zeros, by exclusive or with that behind the second from state 0: the register is linear.
    """
    table = _castagnoli()
    step = lambda h, b: table[(h ^ b) & 0xFF] ^ h >> np.uint32(8)
    zeros = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]  # each byte of a state
    for _ in range(CHUNK):
        zeros = step(zeros, np.uint32(0))
    size = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(1, -(-size // CHUNK))
    first = np.cumsum(chunks) - chunks
    length = np.full(int(chunks.sum()), CHUNK, np.int64)
    length[first] = size - (chunks - 1) * CHUNK
    start = np.zeros(len(length), np.uint32)
    start[first] = 0xFFFFFFFF
    part = _fold_at(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length, start, step)
    state = part[first]
    order = np.argsort(-chunks, kind="stable")
    live = np.searchsorted(-chunks[order], -np.arange(2, (int(chunks.max()) if len(chunks) else 0) + 1), side="right")
    for k, n in enumerate(live.tolist(), 1):
        at = order[:n]
        h = state[at]
        state[at] = zeros[0, h & 0xFF] ^ zeros[1, h >> 8 & 0xFF] ^ zeros[2, h >> 16 & 0xFF] ^ zeros[3, h >> 24] ^ part[first[at] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def _mum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit products, folded by exclusive or."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b, c, d = x >> half, x & low, y >> half, y & low
    bd, ad, bc = b * d, a * d, b * c
    mid = (bd >> half) + (ad & low) + (bc & low)
    return (mid << half | bd & low) ^ (a * c + (ad >> half) + (bc >> half) + (mid >> half))


def wyhash_batch(texts: list[bytes]) -> np.ndarray:
    """The seedless variant: 48-byte rounds on three lanes, 16-byte rounds on one, then the last 16 bytes.

    Round k runs over all texts at once that are long enough for it.
    """
    k0, k1, k2 = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBD8583D0F5D0CD))  # fixed values
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], begin[order]

    def word(at: np.ndarray, width: int = 8) -> np.ndarray:
        return sum((data[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(width)), np.uint64(0))

    def longer(n: int) -> int:
        return int(np.searchsorted(-size, -n, side="left"))

    lanes = np.zeros((3, len(texts)), np.uint64)
    at = begin.copy()
    while n := int(np.searchsorted(-(size - (at - begin)), -48, side="left")):
        p = at[:n]
        for lane, k, o in ((0, k0, 0), (1, k1, 16), (2, k2, 32)):
            lanes[lane, :n] = _mum(word(p + o) ^ k, word(p + o + 8) ^ lanes[lane, :n])
        at[:n] += 48
    seed = lanes[0] ^ lanes[1] ^ lanes[2]
    while len(left := np.flatnonzero(begin + size - at > 16)):
        seed[left] = _mum(word(at[left]) ^ k0, word(at[left] + 8) ^ seed[left])
        at[left] += 16
    a, b = np.zeros((2, len(texts)), np.uint64)
    end = begin + size
    n = longer(16)
    a[:n], b[:n] = word(end[:n] - 16), word(end[:n] - 8)
    m = longer(3)
    few = slice(n, m)  # 4 to 16 bytes
    mid = size[few] >> 3 << 2
    half = np.uint64(32)
    a[few] = word(begin[few], 4) << half | word(begin[few] + mid, 4)
    b[few] = word(end[few] - 4, 4) << half | word(end[few] - 4 - mid, 4)
    one = slice(m, longer(0))  # 1 to 3 bytes
    a[one] = word(begin[one], 1) << np.uint64(16) | word(begin[one] + (size[one] >> 1), 1) << np.uint64(8) | word(end[one] - 1, 1)
    out = np.empty(len(texts), np.uint64)
    out[order] = _mum(k2 ^ size.astype(np.uint64), _mum(a ^ k0, b ^ k1 ^ seed))
    return out


def in_pieces(s: pd.Series, f, limit: int) -> pd.Series:
    """``f`` of the texts, the longest ones first, ``limit`` bytes at a time: few steps are taken for a long text alone."""
    size = np.array([0 if x is None else len(x) for x in s], np.int64)
    order = np.argsort(-size, kind="stable")
    texts, out = s.array, np.empty(len(s), object)
    for first, last in pieces(size[order], limit):
        at = order[first:last]
        out[at] = f([b"" if texts[i] is None else bytes(texts[i]) for i in at.tolist()])
    return pd.Series(out, index=s.index)


UDFS: dict = {}


def _udf(name: str, kind: DataType, f, limit: int = 4 << 20):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return in_pieces(s, f, limit)

    UDFS[name] = run

    def wrap(c) -> Column:
        b = col(c).cast("binary")
        return F.when(b.isNotNull(), run(b))

    return wrap


fnv1a = _udf("fnv1a", StringType(), lambda t: [f"{x:016x}" for x in fnv1a_batch(t).tolist()])
crc32c = _udf("crc32c", LongType(), lambda t: crc32c_batch(t).astype(np.int64))
_xxhash64_arrow = _udf("xxhash64", StringType(), lambda t: [xxhash.xxh64_hexdigest(x, seed=0) for x in t])
wyhash = _udf("wyhash", StringType(), lambda t: [f"{x:016x}" for x in wyhash_batch(t).tolist()])


def xxhash64(c) -> Column:
    """XXH64 with seed 0: Spark's own expression with another seed, inside code generation.

    A session without a JVM at hand (Connect) takes the Arrow function; both give the same.
    """
    b = col(c).cast("binary")
    sc = SparkContext._active_spark_context
    if sc is None:
        return _xxhash64_arrow(c)
    jvm = sc._jvm
    to_expr = jvm.org.apache.spark.sql.classic.ExpressionUtils
    args = jvm.PythonUtils.toSeq([to_expr.expression(b._jc)])
    value = Column(to_expr.column(getattr(jvm.org.apache.spark.sql.catalyst.expressions, "XxHash64")(args, 0)))
    return F.when(b.isNotNull(), F.lower(F.lpad(F.hex(value), 16, "0")))
