"""Linear-time suffix sorting by grouping, without recursion.

Phase 1 refines groups of suffixes by their Lyndon prefixes: groups are visited in descending order; each member's
previous-smaller pointer names the suffix whose Lyndon prefix it extends, and the suffixes so extended are split off
above the rest of their own group, those extended more often first.  Phase 2 emits each group's order: suffixes leave in
ascending order, and a suffix places the ones whose Lyndon prefix ends where it begins at the front of their groups.
No names are recomputed and nothing is sorted but the initial symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of non-negative integers (a shorter suffix precedes those it begins)."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    first = np.argsort(symbols, kind="stable")
    ordered = symbols[first]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.flatnonzero(new)
    group_at = np.zeros(n, np.int64)
    group_at[first] = starts[np.cumsum(new) - 1]
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    ends = np.zeros(n + 1, np.int64)
    ends[starts] = np.concatenate((starts[1:], [n]))
    sa, at, group, end = first.tolist(), place.tolist(), group_at.tolist(), ends.tolist()
    smaller = [-1] * n

    hi = n
    while hi > 0:
        lo = group[sa[hi - 1]]
        if hi - lo == 1:
            i = sa[lo]
            p = i - 1
            while p >= 0 and group[p] >= lo:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                g = group[p]
                e = end[g] - 1
                if e > g:  # a group of its own, above the rest of the old one
                    a, other = at[p], sa[e]
                    sa[a], sa[e] = other, p
                    at[other], at[p] = a, e
                    end[g], end[e] = e, e + 1
                    group[p] = e
            hi = lo
            continue
        count: dict[int, int] = {}
        for i in sorted(sa[lo:hi]):
            p = i - 1
            while p >= 0 and group[p] >= lo:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by: dict[int, list[int]] = {}
        for p, c in count.items():
            by.setdefault(c, []).append(p)
        for c in sorted(by, reverse=True):
            moved: dict[int, int] = {}
            for p in by[c]:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                e = end[g] - m
                a, other = at[p], sa[e]
                sa[a], sa[e] = other, p
                at[other], at[p] = a, e
            for g, m in moved.items():
                e = end[g]
                s = e - m
                if s > g:
                    end[g], end[s] = s, e
                    for x in range(s, e):
                        group[sa[x]] = s
        hi = lo

    out, front = [0] * n, list(range(n))
    placed = bytearray(n)
    p = n - 1
    while p >= 0:
        g = group[p]
        out[front[g]] = p
        front[g] += 1
        placed[p] = 1
        p = smaller[p]
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = 1
            p = smaller[p]
    return np.array(out)
