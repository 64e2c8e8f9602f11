"""Packing: nothing lost, no conflict, capacity held, and each choice the tightest there was."""

import random
from collections import Counter, defaultdict

from textloom.llm.packing import best_fit, pack


def brute(pieces, capacity):
    bins, out = [], []
    for tokens, source, cluster in pieces:
        fits = [(capacity - b["n"], i) for i, b in enumerate(bins) if capacity - b["n"] >= tokens and source not in b["s"] and cluster not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"n": 0, "s": set(), "c": set()})
        out.append((i, bins[i]["n"]))
        bins[i]["n"] += tokens
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_pack_is_best_fit_over_all_bins():
    rng = random.Random(1)
    for _ in range(60):
        pieces = sorted(((rng.randrange(0, 100), rng.randrange(6), rng.randrange(30)) for _ in range(rng.randrange(0, 80))), reverse=True)
        assert pack(pieces, 100) == brute(pieces, 100)


def test_rows(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 30, 49, 50, 51, 120])) + f" u{rng.randrange(40)}", rng.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "a"), (None, "x y", "b"), (905, "same Text", "c"), (906, "same  text", "d"), (907, "x " * 5000, "d")]
    for shard_docs in (2000, 50):
        got = best_fit(docs_of(rows, extra=True), capacity=50, shard_docs=shard_docs).collect()
        want = Counter()
        for i, t, _ in rows:
            want[i] += len((t or "").split())
        have = Counter()
        bins = defaultdict(list)
        for r in got:
            have[r["doc_id"]] += r["n_tokens"]
            bins[r["shard"], r["bin"]].append(r)
        assert have == want and {r["doc_id"] for r in got} == {r[0] for r in rows}
        for b in bins.values():
            assert sum(r["n_tokens"] for r in b) <= 50 and len({r["source"] for r in b}) == len(b)
            at = 0
            for r in sorted(b, key=lambda r: (r["start"], r["n_tokens"])):
                assert r["start"] == at
                at += r["n_tokens"]
        assert len({k for k, b in bins.items() for r in b if r["doc_id"] in (905, 906)}) == 2


def test_empty(docs_of):
    assert best_fit(docs_of([(1, "a")]).where("false")).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    from collections import Counter

    from textloom.llm.packing import op8_best_fit_packing

    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w), f"s{i}") for i in range(5)] + [(10 + i, f"other{i} " * 40, f"s{i}") for i in range(5)] + [(3, " ".join(w), "s9"), (None, None, None), (None, "", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op8_best_fit_packing(spark, f"file://{tmp_path}").collect()
    assert sum(r["n_tokens"] for r in got) == 6 * 60 + 5 * 40 and len(got) == len(rows)
    copies = [(r["shard"], r["bin"]) for r in got if r["n_tokens"] == 60]
    assert max(Counter(copies).values()) == 1
