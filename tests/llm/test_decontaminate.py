"""Decontamination against a full edit-distance table."""

import random

from textloom.llm.decontaminate import Matcher, decontaminate, fold, heads, myers, pieces, probes, with_matches


def least_distance(pattern, text):
    """Smallest edit distance of pattern to a substring of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != ch)))
        row = new
        best = min(best, row[-1])
    return best


def masks_of(p):
    return {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 90)))
        w = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 120)))
        limit = rng.randrange(0, len(p))
        assert myers(p, masks_of(p), w, limit) == min(least_distance(p, w), limit + 1)


def test_pieces_cover_the_item():
    for n in (1, 2, 19, 20, 300):
        for k in range(min(n, 20)):
            got = pieces("x" * n, k)
            assert len(got) == k + 1 and sum(len(p) for _, p in got) == n and all(p for _, p in got)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("xyz")
        elif kind == 1:
            t.insert(i, rng.choice("xyz"))
        elif len(t) > 1:
            del t[i]
    return "".join(t)


def planted(rng, items, n=60):
    rows = []
    for i in range(n):
        noise = "".join(rng.choice("abcdef gh") for _ in range(rng.randrange(0, 200)))
        it = rng.choice(items)[1]
        body = edited(rng, it, rng.randrange(0, int(0.08 * len(it)) + 2))
        rows.append((i, noise[:50] + body.upper() + "\n " + noise[50:]))
    return rows


def test_equals_brute_force(spark, docs_of):
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcdef gh") for _ in range(rng.randrange(5, 120)))) for i in range(15)] + [(3, "again the same id"), (90, None), (91, " \n"), (None, "no id for this one here")]
    rows = planted(rng, [x for x in items if x[1] and x[1].strip()]) + [(100, None), (101, ""), (102, "q" * 20_000 + " No  ID\tfor this one here " + "q" * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in rows:
        t = fold(text)
        for i in {i for i, x in items if fold(x)}:
            ds = [least_distance(fold(x), t) for j, x in items if j == i and fold(x) if least_distance(fold(x), t) <= int(0.07 * len(fold(x)))] if t else []
            if ds:
                want.add((d, i, min(ds)))
    for size in (16 << 20, 0):
        got = {(r["doc_id"], h["item_id"], h["distance"]) for r in with_matches(docs_of(rows, extra=True), bench, "found", automaton_bytes=size).collect() for h in r["found"]}
        assert got == want and len(want) > 20


def test_clean_documents_stay_and_columns_too(spark, docs_of):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    df = docs_of([(1, "the quick brown fox jumps over the lazy dog again and agaim"), (2, "something else"), (3, None), (2, "something else")], extra=True)
    out = decontaminate(df, bench)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 2, 3]
    assert decontaminate(df, bench.where("false")).count() == 4
    out = decontaminate(df, bench, automaton_bytes=0)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 2, 3]
    assert decontaminate(df, spark.createDataFrame([(1, " "), (2, "")], bench.schema), automaton_bytes=0).count() == 4
    assert decontaminate(df.where("false"), bench, automaton_bytes=0).count() == 0
    assert decontaminate(df.where("false"), bench).count() == 0


def test_bit_table_lets_all_heads_through():
    rng = random.Random(6)
    text = "".join(rng.choice("aé€😀 b") for _ in range(200))
    got = {q: h for q, h in heads(text, {3, 12})}
    assert {q: len(h) for q, h in got.items()} == {3: 198, 12: 189}
    for q in (3, 12):
        same = {}
        for i, h in enumerate(got[q].tolist()):
            assert same.setdefault(text[i: i + q], h) == h
        assert len(set(same.values())) == len(same)
    assert dict(heads("ab", {3})) == {} and all((p < 1024).all() for p in probes(got[3], 1024))


def test_matcher_without_items():
    assert Matcher([], 0.07)("abc") == []
