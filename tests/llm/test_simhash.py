"""Fingerprints from their definition, links and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from textloom.llm.simhash import bit_counts, block_masks, drop_near_copies, fingerprint, simhash_components


def plain_fingerprint(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i: i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def texts(seed=1, n=150):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "ÄÖ", "gamma x", "d", "ee", " ", "zeta"] + [f"w{i}" for i in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 120) if i % 3 else rng.randrange(400, 600))) for i in range(n)]
    out = list(base)
    for t in base[:60]:
        w = t.split(" ")
        if len(w) > 3:
            for _ in range(rng.choice([1, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out + [None, "", " \t\n", "A b", "a  B", base[0], base[0]]


def test_fingerprint_follows_its_definition():
    for t in texts():
        assert fingerprint(t) == plain_fingerprint(t)


def test_bit_counts():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        x = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2), dtype=np.uint64)
        want = [[int((x[:, w] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for w in range(2)]
        assert bit_counts(x).tolist() == want


@pytest.mark.parametrize(("n", "ranges", "masks"), [(0, 21, 3), (1 << 27, 21, 3), (1 << 28, 32, 6), (1 << 39, 38, 10), (1 << 45, 42, 15)])
def test_blocks_follow_the_number_of_fingerprints_and_lose_no_pair(n, ranges, masks):
    rng = random.Random(n)
    got = block_masks(n, 2)
    assert len(got) == masks and min(m.bit_count() for m in got) >= ranges and len(set(got)) == masks
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for _ in range(2):
            y ^= 1 << rng.randrange(64)
        assert any(x & m == y & m for m in got)


def test_case_and_punctuation_do_not_tell_near_copies_apart(docs_of):
    w = [f"word{i}" for i in range(12)]
    rows = [(1, " ".join(w)), (2, ", ".join(w).title() + "."), (3, "--- ... !"), (4, ""), (5, " ".join(w[:11]) + " other"), (6, "ÄÖ straße " * 3), (7, "äö (STRASSE) " * 3), (8, "äö-straße " * 3)]
    assert sorted(r["doc_id"] for r in drop_near_copies(docs_of(rows)).collect()) == [1, 3, 5, 6, 7]


@pytest.mark.parametrize("cap", [2048, 4])
def test_components_equal_all_pairs(spark, docs_of, cap, monkeypatch):
    import functools

    from textloom.llm import simhash as m

    monkeypatch.setattr(m, "block_edges", functools.partial(m.block_edges, cap=cap))
    t = texts(cap)
    rows = list(enumerate(t)) + [(5, t[5]), (None, t[6])]
    f = [plain_fingerprint(x[1]) for x in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = sorted(((r[0], f[i], low[find(i)]) for i, r in enumerate(rows)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_components(docs_of(rows, extra=True)).collect()), key=str)
    assert got == want and len({w[2] for w in want}) < len(rows) - 15
    assert simhash_components(docs_of(rows).where("false")).count() == 0


def test_near_copies_leave_one_row_of_each_group(docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        v = list(w)
        v[rng.randrange(200)] = "changed"  # at most 5 of 196 shingles: similarity 0.95
        rows.append((100 + i, " ".join(v)))
        v = [x if rng.random() < 0.9 else "other" + str(rng.random()) for x in w]  # about 0.4
        rows.append((200 + i, " ".join(v)))
        rows.append((300 + i, "  ".join(w).upper()))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two"), (1004, "one three"), (None, rows[0][1]), (5, rows[5][1])]
    df = docs_of(rows, extra=True)
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30), *range(200, 230), 1000, 1002, 1004]
    assert drop_near_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("cap", [2048, 4])
def test_near_copies_equal_brute_force_about_the_bound(docs_of, cap, monkeypatch):
    import functools

    from textloom.llm import simhash as m

    monkeypatch.setattr(m, "block_edges", functools.partial(m.block_edges, cap=cap))
    rng = random.Random(5)
    rows, want = [], []

    def shingles(w):
        return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))}

    for i in range(240):
        n = rng.choice([5, 9, 14, 40, 300, 600])
        w = [f"{i}x{k}" for k in range(n + 4)]
        s = rng.uniform(0.78, 0.86)
        k = max(1, round(n * (1 - s) / (1 + s)))  # the last k of n shingles differ
        v = w[: len(w) - k] + [f"{i}y{j}" for j in range(k)] if i % 2 else w[: len(w) - k]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = shingles(w), shingles(v)
        want += [2 * i] if len(a & b) / len(a | b) >= 0.8 else [2 * i, 2 * i + 1]
    w = [f"chain{k}" for k in range(400)]
    chain = [w[j * 25: j * 25 + 204] for j in range(7)]  # 200 shingles, neighbours share 175 (0.78)
    rows += [(10000 + j, " ".join(x)) for j, x in enumerate(chain)]
    want += [10000 + j for j in range(7)]
    close = [w[j * 20: j * 20 + 204] for j in range(7)]  # neighbours share 180 (0.82): one group
    rows += [(20000 + j, " ".join(x).replace("chain", "close")) for j, x in enumerate(close)]
    want += [20000]
    assert 40 < len(want) - 240 < 200
    assert sorted(r["doc_id"] for r in drop_near_copies(docs_of(rows)).collect()) == sorted(want)
