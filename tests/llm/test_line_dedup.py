"""Line dedup against a plain count, and the edges its docstring defines."""

import random
from collections import Counter, defaultdict

from textloom.llm.line_dedup import line_dedup


def brute(rows, ratio=0.1, least=3):
    hosts, seen = Counter(r[2] for r in rows), defaultdict(Counter)
    for _, text, host in rows:
        if text is not None:
            seen[host].update({x for x in text.split("\n") if x.strip(" ")})
    bad = {(h, x) for h, c in seen.items() for x, n in c.items() if n >= least and n > ratio * hosts[h]}
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for i, t, h in rows)


def got(df, **options):
    return sorted((r["doc_id"], r["text"]) for r in line_dedup(df, **options).collect())


def table(n=120):
    rng = random.Random(1)
    lines = ["menu", "foot er", "", "  ", *(f"line {i}" for i in range(40))]
    rows = []
    for i in range(n):
        k = rng.randrange(1, 7)
        rows.append((i, "\n".join(rng.choice(lines[:6] if rng.random() < 0.4 else lines) for _ in range(k)), rng.choice(["hot", "hot", "a", None])))
    return rows + [(500, None, "hot"), (501, "", "hot"), (502, None, None), (503, "menu\n" * 3000 + "rest", "hot")]


def test_equals_the_plain_count(docs_of):
    rows = table()
    assert got(docs_of(rows, extra=True)) == brute(rows)


def test_the_join_beyond_the_broadcast_bound_gives_the_same(docs_of):
    rows = table()
    assert got(docs_of(rows), broadcast_bytes=0) == brute(rows)


def test_repeated_rows_count_as_documents(docs_of):
    rows = [(1, "x\ny", "h")] * 4 + [(2, "z", "h")]
    assert got(docs_of(rows)) == brute(rows) == [(1, "")] * 4 + [(2, "z")]


def test_counts_and_ties_at_the_ratio(docs_of):
    rows = [(i, "tie\nu%d" % i if i < 3 else "u%d" % i, "h") for i in range(30)]  # 3 of 30 is not over a tenth
    assert got(docs_of(rows)) == brute(rows) == sorted((i, t) for i, t, _ in rows)
    r = line_dedup(docs_of([(i, "tie\nu%d" % i, "h") for i in range(5)])).orderBy("doc_id").first()
    assert (r["text"], r["n_lines"], r["n_removed"]) == ("u0", 2, 1)


def test_empty(docs_of):
    assert got(docs_of([(1, "a", "b")]).where("false")) == []
