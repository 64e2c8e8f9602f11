"""Pieces of Arrow batches, so that a Python task holds the results of a few megabytes and not of a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

PIECE = 1 << 20


def pieces(sizes: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``limit`` in all, or of one larger row; there is one at least."""
    ends, first = np.cumsum(sizes), 0
    while True:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, min(last, len(sizes))
        first = last
        if first >= len(sizes):
            return


def each(batches: Iterator[pd.Series], f: Callable, limit: int = PIECE) -> Iterator[pd.Series]:
    """``f`` of each value, null for null, in pieces of a batch of ``limit`` characters."""
    for s in batches:
        for first, last in pieces(np.array([0 if x is None else len(x) for x in s], np.int64), limit):
            yield pd.Series([None if x is None else f(x) for x in s.iloc[first:last]], dtype=object)
