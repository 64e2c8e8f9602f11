"""The pipeline over the smallest tables, stage by stage, and all queries' columns."""

import os

import pytest

import corpus_pipeline
from textloom.llm import queries
from textloom.llm.common import components, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_removed", "text"], "op2_benchmark_decontamination": ["doc_id", "item_id", "distance"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op4_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_embedding_neardup": ["vec_id", "n_links", "component_id", "kept"], "op6_html_extraction": ["page_id", "url", "text", "n_chars"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_simhash_neardup": ["doc_id", "fingerprint", "component_id"], "op10_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    whole = {"op4_chat_format": table(spark, SF, "conversations").select("conv_id").distinct().count() + 1, "op5_embedding_neardup": table(spark, SF, "embeddings").count(),
             "op6_html_extraction": table(spark, SF, "pages").count(), "op2_benchmark_decontamination": None, "op8_best_fit_packing": None}.get(name, table(spark, SF, "documents").count())
    n = df.count()
    assert n == whole if whole is not None else n > 0


def test_line_dedup_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.SQL["op1_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op1_line_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_neardup", "decontaminate", "packing"]
    kept = {r[0] for r in docs.select("doc_id").collect()}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids <= kept
        if name != "packing":
            assert out.columns == docs.columns
            kept, docs = ids, out
    assert ids == kept
    assert {r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept


def test_components(spark):
    import random

    from textloom.llm.common import Workspace

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    got = {r["node"]: r["comp"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {}

    def find(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in comp}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
