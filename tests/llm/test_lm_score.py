"""Elias-Fano coding, the trie against a dictionary, and what the scores say."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm.elias_fano import EliasFano, dump, loaded
from textloom.llm.lm_score import AMOUNT, NONE, SHARE, Hot, Trie, behind, build_trie, lm_score, small, unsmall, words_of


@pytest.mark.parametrize("universe", [10, 1000, 1 << 40, 1 << 64])
def test_elias_fano(universe):
    rng = random.Random(universe)
    for n in (0, 1, 2, 7, 8, 500):
        x = sorted(rng.randrange(universe) for _ in range(n))
        ef = EliasFano.encode(np.array(x, np.uint64), universe)
        q = x + [rng.randrange(universe) for _ in range(50)]
        i, hit = ef.find(np.array(q, np.uint64))
        assert hit.tolist() == [v in x for v in q]
        assert i.tolist() == [next((k for k, y in enumerate(x) if y >= v), n) for v in q]
        if n:
            assert ef.get(np.arange(n)).tolist() == x


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["The", "ÄÖ", "x y"]
    after = {w: [rng.choice(words) for _ in range(4)] for w in words}
    rows = []
    for i in range(250):
        w = [rng.choice(words)]
        while len(w) < rng.randrange(0, 90):
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.8 else rng.choice(words))
        rows.append((i, " ".join(w) if i % 9 else None if i % 2 else ""))
    return rows + [(3, rows[3][1]), (999, "never seen words w1"), (998, "w2 " * 3000)]


def model_of(learn):
    """(c of words, of pairs, of trigrams; followers of words and of pairs; N, V) by dictionaries."""
    uni, bi, tri, after1, after2 = Counter(), Counter(), Counter(), {}, {}
    for t in learn:
        s = ["<s>", "<s>", *tokens(t), "</s>"]
        uni.update(s[2:])
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            bi[b, c] += 1
            tri[a, b, c] += 1
            after1.setdefault(b, set()).add(c)
            after2.setdefault((a, b), set()).add(c)
    return uni, bi, tri, after1, after2


def scores_by(learn, rows):
    uni, bi, tri, after1, after2 = model_of(learn)
    n, v = sum(uni.values()), len(uni)
    c1, c2 = Counter(), Counter()
    for (b, _), k in bi.items():
        c1[b] += k
    for (a, b, _), k in tri.items():
        c2[a, b] += k
    out = []
    for t in rows:
        s = ["<s>", "<s>", *tokens(t), "</s>"]
        base = score = 0.0
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            p = p1 = (uni[c] + 0.5) / (n + 0.5 * (v + 1))
            if c1[b]:
                p = max(bi[b, c] - 0.75, 0) / c1[b] + 0.75 * len(after1[b]) / c1[b] * p1
            if c2[a, b]:
                p = max(tri[a, b, c] - 0.75, 0) / c2[a, b] + 0.75 * len(after2[a, b]) / c2[a, b] * p
            base += math.log10(p1)
            score += math.log10(p)
        out.append((len(s) - 2, sum(uni[x] > 0 for x in s[2:]), base, score))
    return n, v, out


@pytest.mark.parametrize("options", [{}, {"hot_share": 3.0}, {"bucket_bytes": 256}, {"block_bytes": 500, "bucket_bytes": 4096}, {"block_bytes": 3000, "hot_share": 0.01, "bucket_bytes": 300}])
def test_scores_follow_the_model(docs_of, options):
    rows = corpus()
    n, v, want = scores_by([t for i, t in rows if i % 3], [t for _, t in rows])
    df = docs_of(rows, extra=True).drop("held_out").selectExpr("*", "doc_id % 3 = 0 AS held_out")
    out = lm_score(df, **options)
    assert (out.tokens, out.words) == (n, v) and (out.hot_pairs > 0) is (options.get("hot_share") != 3.0)
    got = sorted(out.rows.collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    rows = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=lambda r: (r[0], r[1]))
    assert len(got) == len(rows)
    for r, (i, size, known, base, score) in zip(got, rows, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["held_out"]) == (i, size, known, i % 3 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) < 1e-6 + 3e-4 * size


def test_nothing_to_learn_and_nothing_to_score(docs_of):
    df = docs_of([(1, "a b"), (None, None)]).selectExpr("*", "true AS held_out")
    out = lm_score(df)
    assert (out.tokens, out.words) == (0, 0)
    rows = {r["doc_id"]: r for r in out.rows.collect()}
    assert rows[1]["score"] == pytest.approx(0.0) and rows[None]["n_tokens"] == 1
    assert lm_score(df.where("false")).rows.count() == 0


def test_null_fold_is_learned_from_and_large_ids_stay(docs_of):
    big = (1 << 62) + 1
    df = docs_of([(big, "a b c"), (None, "a b c"), (2, "a b d")]).selectExpr("*", "if(doc_id = 2, true, null) AS held_out")
    out = lm_score(df)
    rows = {r["doc_id"]: r for r in out.rows.collect()}
    assert out.tokens == 8 and set(rows) == {big, None, 2} and rows[2]["n_known"] == 3 and rows[big]["score"] > rows[2]["score"]


def test_a_repeated_text_scores_above_single_ones(docs_of):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[0][1])]
    got = {r["doc_id"]: r["score"] for r in lm_score(docs_of(rows).selectExpr("*", "false AS held_out")).rows.collect()}
    assert got[0] == got[100] > max(v for k, v in got.items() if k not in (0, 100)) + 5


def test_words_are_told_apart_as_their_definition_says():
    raw = "The the\tTHE ä Ä x\u00a0y \x1f ".encode() + b"\x0b" + b"q" * 3000 + b" " + b"q" * 2999 + b" ab ba"
    start, h = words_of(raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw.lower()) if w]
    assert [raw.lower()[s: s + len(w)] for s, w in zip(start.tolist(), words, strict=True)] == words
    assert len(set(words)) == len(set(h.tolist())) and {w: x for w, x in zip(words, h.tolist(), strict=True)} == dict(zip(words, h.tolist(), strict=True))
    assert words_of(b"")[1].tolist() == words_of(b" \n")[1].tolist() == []


def test_counts_beyond_32_bits():
    big = (1 << 32) + 5
    assert unsmall(small(np.array([0, 254, 255, big, 1])), 5).tolist() == [0, 254, 255, big, 1]
    a, fan_a, b, fan_b, c = np.array([7, 9, 8], np.uint64), np.array([2, 1, 1]), np.array([1, 2, 1, 4], np.uint64), np.array([2, 1, 1, 1]), np.array([5, 6, 5, 5, 5], np.uint64)
    arrays, totals = build_trie(*(np.tile(x, 2) for x in (a, fan_a, b, fan_b, c)), np.array([big, 1, 1, 3, 0, 3, 2, 3, 2, 0]), Hot.none())
    assert arrays["count"].tolist() == [big + 10, 5] and totals["tokens"].tolist() == [big + 15, 0, 2]
    count, back, pair, rest, prob = Trie(loaded(dump(arrays))).ask(np.array([7, 8], np.uint64), np.array([2, 1]), np.array([1, 3, 1], np.uint64), np.array([2, 1, 1]), np.array([5, 9, 5, 5], np.uint64))
    assert count.tolist() == [big + 10, 0] and SHARE[back[0]] == pytest.approx(2 * 0.75 / (big + 10), rel=1e-3) and back[1] == NONE
    assert AMOUNT[pair[0]] == pytest.approx(big + 6, rel=1e-3) and pair[1:].tolist() == rest[1:].tolist() == [NONE, NONE]
    assert SHARE[prob[0]] == pytest.approx((big + 3 - 0.75) / (big + 6), rel=1e-3) and prob[1:].tolist() == [NONE] * 3


def test_levels_of_many_contexts():
    n = 5000
    a, one = np.arange(n, dtype=np.uint64) * np.uint64(1 << 50), np.ones(n, np.int64)
    arrays, _ = build_trie(a, one, a >> np.uint64(32), one, a >> np.uint64(32), one, Hot.none())
    assert arrays["width"].tolist() == [32, 32]
    *_, prob = Trie(loaded(dump(arrays))).ask(a, one, a >> np.uint64(32), one, a >> np.uint64(32))
    assert (prob != NONE).all()
    assert behind(np.zeros(1), np.zeros(1, np.uint64), 1 << 40)[1] == 22  # more contexts leave fewer bits for what follows
