"""Cases that every operator defines: nulls in any column, repeated rows, empty tables, clashing columns, long texts."""


import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm.chat_format import op4_chat_format
from textloom.llm.decontaminate import decontaminate, with_matches
from textloom.llm.line_dedup import line_dedup
from textloom.llm.packing import best_fit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "What is the name of the river that flows through the old town and ends in the northern sea after many miles?"


def folder(spark, path, docs, labels=(), items=()):
    tables = {"documents": (docs, SCHEMA), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(list(rows), schema).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def some_docs():
    rows = [(i, f"Document number {i} says word{i} and other{i} thing{i} in line one{i}.\nshared line of the site\n", "en", "a" if i % 2 else None, 10) for i in range(40)]
    rows += [(50, None, None, None, None), (None, "text without an id", "en", "b", 3), (None, None, None, None, None), (51, "", "en", "a", 0), (52, f"{ITEM} and more", "en", "c", 9), rows[3], (53, rows[3][1], "de", "z", 1)]
    return rows + [(54, "long " * 60_000 + "end", "en", "a", 1)]


@pytest.mark.parametrize("kind", ["rows", "empty"])
def test_stages_of_the_pipeline(spark, tmp_path, kind):
    docs = some_docs() if kind == "rows" else []
    sf = folder(spark, tmp_path, docs, [(i, 1, i % 2) for i in range(40)] if docs else [], [(1, ITEM), (None, ITEM), (2, None)] if docs else [])
    now = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_hits", F.lit("x")).withColumn("score", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        n = out.count()
        if name != "packing":
            assert out.columns == now.columns and n <= now.count()
            now = out
    assert (n > 0) is bool(docs)
    got = corpus_pipeline.run(spark, sf)
    ids = [r["doc_id"] for r in got.collect()]
    assert 52 not in ids and ids.count(3) <= 1 and (len(ids) > 30 or not docs)
    assert got.columns == ["doc_id", "piece", "n_tokens", "shard", "bin", "start", "source"]


def test_line_dedup_with_null_ids_and_repeated_rows(docs_of):
    rows = [(None, "keep me\nboiler\n"), (None, "keep me too\nboiler"), (1, "boiler"), (1, "boiler"), (2, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(docs_of(rows), ratio=0.5).collect()), key=str)
    assert got == sorted([(None, "keep me\n"), (None, "keep me too"), (1, ""), (1, ""), (2, None)], key=str)


def test_decontamination_with_null_ids_and_repeated_rows(spark, docs_of):
    items = spark.createDataFrame([(1, ITEM), (None, ITEM), (3, "")], "item_id long, text string")
    rows = [(None, f"so {ITEM} it"), (7, f"{ITEM}"), (7, f"{ITEM}"), (8, "clean"), (None, None)]
    got = with_matches(docs_of(rows), items, "m").collect()
    assert sorted((r["doc_id"] is None, len(r["m"])) for r in got) == [(False, 0), (False, 2), (False, 2), (True, 0), (True, 2)]
    assert sorted((r["doc_id"] is None, r["text"]) for r in decontaminate(docs_of(rows), items).collect() if r["text"]) == [(False, "clean")]


def test_packing_of_repeated_rows(docs_of):
    rows = [(1, "a b c")] * 3 + [(None, "a b c"), (None, None), (2, "x " * 250)]
    got = best_fit(docs_of(rows), capacity=100).collect()
    assert len(got) == 5 + 3 and sum(r["n_tokens"] for r in got) == 4 * 3 + 250
    assert len({(r["shard"], r["bin"]) for r in got if r["n_tokens"] == 3}) == 4


def test_a_long_conversation(spark, tmp_path):
    big = "word <|im_end|> " * 40_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", big) for k in range(16)] + [(2, 0, "user", None), (None, 0, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op4_chat_format(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {1, 2, None, -1}
    assert got[1]["n_turns"] == 16 and got[1]["loss_chars"] == 8 * len(big) and got[1]["formatted_chars"] > 16 * len(big) > 8 << 20
