"""Links and components against all pairs in double precision."""

import numpy as np
import pytest

from textloom.llm.embedding_dedup import Graph, embedding_components


def brute(rows, least=0.9):
    x = {i: np.array(v, float) for i, v in enumerate(r[1] for r in rows) if v is not None and len(v) and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    comp = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ks = list(x)
    for n, i in enumerate(ks):
        for j in ks[n + 1:]:
            if len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))


def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 1.0], (n, 1))
    x[: n // 4] = x[0] + rng.normal(size=(n // 4, d)) * 0.05  # a large group
    return [(i, [float(y) for y in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard_rows", [20_000, 60])
def test_equals_all_pairs(spark, shard_rows):
    rows = vectors(1)
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, [0.0] * 16), (1004, [float("nan")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, []), (1007, [float("inf")] * 16), (1008, [1.0, 2.0]), (1009, [2.0, 4.0])]
    rows += [(1010, [1e-30 * y for y in rows[6][1]])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("links", F.lit("x"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as floats are
    got = sorted(tuple(r) for r in embedding_components(df, shard_rows=shard_rows).collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.98 * there
    assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) <= 2


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in embedding_components(df).collect()), key=str) == [(3, 1, 3, True), (None, 1, 3, False)]
    assert embedding_components(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Graph(x).build()
    q = x[:200].astype(np.float32)
    ids, _ = g.search(0, q, g.descend(q, 0), 64)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, truth, strict=True)]) >= 9


def test_audit_draws_until_it_has_seen_links():
    from textloom.llm.embedding_dedup import AUDIT_LINKS, AUDIT_QUERIES

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x[:600] = np.repeat(x[:300], 2, axis=0) + 0.02 * rng.normal(size=(600, 24))  # pairs
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Graph(x).build()
    drawn, truth = g.audit(x, x[:800], 0.9)
    assert truth.sum() >= AUDIT_LINKS and truth.tolist() == (x[drawn] @ x.T >= 0.9).sum(1).tolist()
    drawn, truth = g.audit(x, -x[600:900], 0.9)  # no links at all
    assert len(drawn) == AUDIT_QUERIES and truth.sum() == 0
    tally = np.zeros(2, np.int64)
    a, b = g.links(x, x[:800], 0.9, 0.98, tally)
    assert tally[0] >= 0.98 * tally[1] > 0
    want = (x[:800] @ x.T >= 0.9).sum()
    assert 0.98 * want <= len(a) <= want
    tally = np.array([0, 1000])  # blocks before missed all: the beam widens until it is exact
    assert len(g.links(x, x[:50], 0.9, 0.98, tally)[0]) == (x[:50] @ x.T >= 0.9).sum()


def test_repeated_ids_and_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_components(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_memory_of_a_search_does_not_grow_with_a_group():
    import tracemalloc

    import pandas as pd

    from textloom.llm.embedding_dedup import _search, pack, unit

    rng = np.random.default_rng(6)
    x = np.float32(1 + 0.05 * rng.normal(size=(3000, 64)))  # one group
    q, x = x[2000:], x[:2000]
    g = Graph(unit(x)).build()
    graph = pack(x=x, cid=np.arange(2000), copies=np.ones(2000, np.int64), top=np.array(g.top), label=np.zeros(2000, np.int64), level=g.level,
                 **{f"adj{i}": v for i, v in enumerate(g.adj)})
    rows = pd.DataFrame({"d": 64, "shard": 0, "range": 0, "block": [-1, 5000], "x": [graph, pack(x=q, cid=np.arange(5000, 6000))]})
    tracemalloc.start()
    try:
        got = pd.concat(list(_search(0.9, 0.98)(iter([rows]))))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got["links"].sum() == 2_000_000 and got["a"].notna().sum() == 1000
    assert most < 200e6  # all pairs of 256 queries in double precision are 500 MB


def test_graphs_travel_in_pieces(spark, monkeypatch):
    from textloom.llm.common import Workspace

    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 128))
    x[600:] = x[:600] + 0.02 * rng.normal(size=(600, 128))
    longest, write = [], Workspace.write

    def spied(self, df, *a, **b):
        out = write(self, df, *a, **b)
        if "x" in out.columns:
            longest.append(out.selectExpr("max(length(x))").first()[0])
        return out

    monkeypatch.setattr(Workspace, "write", spied)
    df = spark.createDataFrame([(i, [float(y) for y in np.float32(v)]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_components(df, min_shards=1).collect()
    assert sorted(tuple(r) for r in got) == [(i, 1, i % 600, i < 600) for i in range(1200)]
    assert len(longest) == 2 and max(longest) <= 1 << 18


def test_shards_are_searched_in_waves(spark, monkeypatch):
    from textloom.llm.common import Workspace

    widths, write = [], Workspace.write

    def spied(self, df, *a, **b):
        out = write(self, df, *a, **b)
        if out.columns == ["cid", "links", "a", "b"]:
            widths.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "write", spied)
    rows = vectors(2, n=160)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in embedding_components(df, min_shards=20).collect())
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert got == want
    assert len(widths) == 3 and min(widths) > 0  # of eight, eight and four shards
