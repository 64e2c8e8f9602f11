"""Elias-Fano coding of ascending integers, with vectorised successor search over memory-mapped arrays."""

from __future__ import annotations

import json
import mmap

import numpy as np

ONE = np.uint64(1)


class EliasFano:
    """n ascending values below a universe: l low bits packed, high bits in unary, zeros counted per 64-bit word."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):  # noqa: E741
        self.n, self.l, self.low, self.high, self.zeros = n, l, low, high, zeros
        self.zero_at: np.ndarray | None = None

    def unpack_zeros(self) -> EliasFano:
        """Keeps the places of all zeros of the high bits at hand, 4 bytes each: for many searches one after the other."""
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little") == 0)
        self.zero_at = at.astype(np.uint32) if len(self.high) < 1 << 26 else at
        return self

    def values(self) -> np.ndarray:
        """All values, decoded."""
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)) | self.low_bits(np.arange(self.n))

    @classmethod
    def encode(cls, x: np.ndarray, universe: int) -> EliasFano:
        x = x.astype(np.uint64)
        n = len(x)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)  # noqa: E741
        words = np.zeros(n * l // 64 + 2, np.uint64)
        if l and n:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(l)
            value, at, shift = x & np.uint64((1 << l) - 1), (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(words, at, value << shift)
            over = shift + np.uint64(l) > 64
            np.bitwise_or.at(words, at[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        top = (x >> np.uint64(l)).astype(np.int64) if l < 64 else np.zeros(n, np.int64)
        size = n + (universe - 1 >> l) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))))
        return cls(n, l, words, high, zeros.astype(np.uint32) if zeros[-1] < 1 << 32 else zeros)

    def _zero(self, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th zeros (from 0)."""
        if self.zero_at is not None:
            return self.zero_at[j].astype(np.int64)
        w = np.searchsorted(self.zeros, j.astype(self.zeros.dtype), side="right") - 1
        left = j - self.zeros[w].astype(np.int64)
        word = ~self.high[w]
        at = np.zeros(len(j), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = word >> at.astype(np.uint64) & np.uint64((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            go = c <= left
            left -= np.where(go, c, 0)
            at += np.where(go, half, 0)
        return w * 64 + at

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.l)
        at, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        two = np.where(shift > 0, self.low[at + 1] << (np.uint64(64) - np.maximum(shift, ONE)), 0).astype(np.uint64)
        return (self.low[at] >> shift | two) & np.uint64((1 << self.l) - 1)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of its successor (the first value >= x; n if none) and whether they are equal."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = (x >> np.uint64(self.l)).astype(np.int64)
        low = x & np.uint64((1 << self.l) - 1)
        a = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1 - top, 0)
        end = self._zero(top) - top
        b = end.copy()
        while (go := np.flatnonzero(a < b)).size:  # binary search among the values with these high bits
            mid = (a[go] + b[go]) // 2
            less = self.low_bits(mid) < low[go]
            a[go] = np.where(less, mid + 1, a[go])
            b[go] = np.where(less, b[go], mid)
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        hit[inside] = self.low_bits(a[inside]) == low[inside]
        return a, hit

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values, for pointers: select by binary search over the counts of ones."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        w = np.searchsorted(ones, i, side="right") - 1
        left, at, word = i - ones[w], np.zeros(len(i), np.int64), self.high[w]
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word >> at.astype(np.uint64) & np.uint64((1 << half) - 1)).astype(np.int64)
            go = c <= left
            left -= np.where(go, c, 0)
            at += np.where(go, half, 0)
        return ((w * 64 + at - i).astype(np.uint64) << np.uint64(self.l)) | self.low_bits(i)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros, f"{name}.size": np.array([self.n, self.l])}

    @classmethod
    def load(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, l = arrays[f"{name}.size"].tolist()  # noqa: E741
        return cls(n, l, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """One block: length of the index, index, arrays at multiples of 8."""
    index, at, body = {}, 0, []
    for k, v in arrays.items():
        raw = np.ascontiguousarray(v).tobytes()
        raw += bytes(-len(raw) % 8)
        index[k] = (at, v.dtype.str, len(v))
        at += len(raw)
        body.append(raw)
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def loaded(m) -> dict[str, np.ndarray]:
    """The arrays of a block, as views of its bytes."""
    head = int.from_bytes(m[:8], "little")
    return {k: np.frombuffer(m, np.dtype(d), n, 8 + head + at) for k, (at, d, n) in json.loads(bytes(m[8: 8 + head])).items()}


def mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        return loaded(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
