"""Suffix arrays against sorting, and the removal against a table of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm.suffix_array import suffix_array
from textloom.llm.suffix_dedup import suffix_dedup


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [*range(12), 50, 300]:
        s = [rng.randrange(letters) for _ in range(n)]
        if n > 40:
            s[20:35] = s[5:20]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i: i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((d, t, tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(((r["doc_id"], r["text"], tuple((x["start"], x["end"]) for x in r["spans"])) for r in suffix_dedup(df, **options).collect()), key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "delta", "x", "é", "zeta\n"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))

    passages = [text(length // 3) for _ in range(4)]
    rows = [(i, text(rng.randrange(5, 60)) + (rng.choice(passages) if rng.random() < 0.6 else "") + text(rng.randrange(0, 30))) for i in range(40)]
    rows += [rows[3], (77, rows[4][1]), (78, None), (79, ""), (None, text(40)), (80, "a" * 3 * length), (81, "ab" * 2 * length), (82, passages[0] + passages[0][:-1])]
    rows += [(90 + i, "common line that starts every page " * 7 + text(30)) for i in range(20)]
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_equals_brute_force(docs_of, hot):
    rows = corpus(hot, 200)
    want = brute(rows, 200)
    assert sum(len(w[2]) for w in want) > 30
    assert got(docs_of(rows, extra=True), hot=hot) == want


def test_texts_longer_than_a_part(docs_of, monkeypatch):
    from textloom.llm import suffix_dedup as m

    monkeypatch.setattr(m, "PART", 700)
    rows = corpus(9, 200) + [(200, "q".join(str(i * i) for i in range(3000)))]
    assert got(docs_of(rows)) == brute(rows, 200)


def test_empty(docs_of):
    assert got(docs_of([(1, "a")]).where("false")) == []
    assert got(docs_of([(1, "a" * 199), (2, "a" * 199)])) == [(1, "a" * 199, ()), (2, "a" * 199, ())]
