"""The grammar's rules, its best paths against all paths, and held-out accuracy on planted and on supplied labels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.toxicity import ADDRESS, GIVEN, NEGATE, REPORT, WORD, best_path, event_weights, grammar, heads_of, read, score, symbols_of, train

LEX = {"idiot": 4.0}


def weigh(clause):
    return best_path(grammar(), symbols_of(WORD.findall(clause), LEX))[0]


def test_rules_of_the_grammar():
    assert weigh("what an idiot") == 4.0
    assert weigh("you idiot") == weigh("idiot , you") > weigh("an idiot") > weigh("she was quoted idiot") > 0
    assert weigh("you are not an idiot") < 0.5 * weigh("you are an idiot")
    assert weigh("you are not a very big total idiot") < 0.5 * weigh("you are an idiot")
    assert weigh("not bad , you idiot") == weigh("you idiot") == weigh("not bad but you idiot")
    assert weigh("i will kill time") == 0 and weigh("i will kill you") > 0
    assert weigh("i will not kill you") < weigh("i will kill you")
    assert weigh("a fine day") == weigh("") == 0


def test_events_of_the_best_path():
    events = lambda s: best_path(grammar(), symbols_of(WORD.findall(s), LEX))[1]
    assert events("he said you are no idiot , but kill") == [('insult~"@', 4.0), ('threat"@', 2.0)]
    assert events("kill time") == [] and events("idiot idiot") == [("insult", 4.0), ("insult", 4.0)]


def all_paths(m, symbols):
    """(weight, events) of every accepted path."""
    paths = [(s, 0.0, ()) for s in m.starts]
    for symbol, x in symbols:
        paths = [(to, total + (w * x if event != "word" else 0), (*got, *([(event, x)] if event != "word" else []))) for s, total, got in paths for event, w, to in m.arcs.get((s, symbol), ())]
    return [(total, list(got)) for s, total, got in paths if s in m.ends]


def cascade(m, symbols):
    """The paths of the transducers one after the other, without a composition."""
    texts = [[s for s, _ in symbols]]
    for t in m:
        new = []
        for text in texts:
            part = [(s, ()) for s in t.starts]
            for symbol in text:
                part = [(to, (*got, out)) for s, got in part for out, _, to in t.arcs.get((s, symbol), ())]
            new += [list(got) for s, got in part if s in t.ends]
        texts = new
    return texts


def test_best_path_is_the_best_of_all_paths():
    rng = random.Random(2)
    kinds = ["word", "insult", "threat", "target", "negation", "report", "contrast"]
    for weights in (GIVEN, {k: v * 0.7 for k, v in GIVEN.items()}):
        m = grammar(weights)
        for _ in range(150):
            s = [(k, float(rng.randrange(1, 9)) if k in ("insult", "threat") else 0.0) for k in rng.choices(kinds, k=rng.randrange(7))]
            paths = all_paths(m, s)
            weight, events = best_path(m, s)
            assert weight == pytest.approx(max((p[0] for p in paths), default=0.0)) and (weight, events) in [(pytest.approx(w), e) for w, e in paths]
            # the composed machine accepts what the transducers do in turn
            marked = [[x for x in text if x in GIVEN] for text in cascade((NEGATE, REPORT, ADDRESS), s)]
            assert sorted([e for e, _ in p[1]] for p in paths) == sorted(marked)


def test_event_weights_are_learned_and_drawn_to_the_given_ones():
    from collections import Counter

    few = event_weights(Counter(insult=2), Counter(), 10, 90)
    assert few["insult~"] == pytest.approx(GIVEN["insult~"], abs=0.05)
    many = event_weights(Counter({"insult": 400, "insult~": 400}), Counter({"insult": 5, "insult~": 5}), 500, 5000)
    assert many["insult~"] > 0.9 and many["insult@"] == GIVEN["insult@"]


def test_clauses_bound_the_scope():
    heads, m = heads_of(LEX), grammar()
    assert read("not here. idiot", LEX, heads, m).features[0] > read("not an idiot", LEX, heads, m).features[0]
    assert read(None, LEX, heads, m).features == read("", LEX, heads, m).features == (0.0, 0.0, 0.0, 0.0)


def test_very_long_text():
    heads, m = heads_of(LEX), grammar()
    text = "you are an idiot. and so on and on and on without end; " * 40_000
    assert read(text, LEX, heads, m).clauses == 40_000
    assert read("word " * 400_000 + "idiot", LEX, heads, m).total == 4.0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_supplied_labels_are_told_apart(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    got = score(docs.select("doc_id", "text"), train(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    hit = int((got["predicted"] & got["toxic"]).sum())
    assert hit / got["toxic"].sum() >= 0.85 and hit / max(1, got["predicted"].sum()) >= 0.95


def planted(seed=1, n=900):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    nasty = [f"{a}{b}" for a in ("grobflit", "snazzle", "vorpish") for b in ("", "s", "er")]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(nasty))
        docs.append((i, " ".join("".join(c for c in w if c.isalpha()) + chr(97 + int("".join(c for c in w if c.isdigit()) or 0) % 26) if w[0] == "w" else w for w in words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_rows_are_told_apart_and_columns_pass(spark, docs_of):
    docs, labels = planted()
    docs += [(5000, None), (5001, ""), (None, "words"), (3, docs[3][1])]
    df = docs_of(docs).withColumn("half", F.lit("x")).withColumn("toxic", F.lit("x"))
    lab = spark.createDataFrame([*labels, (7777, None), (None, 1), (8888, 1)], "doc_id long, toxic int")
    out = score(df, train(df, lab))
    rows = {r["doc_id"]: r for r in out.collect()}
    held = [(rows[i]["predicted"], t) for i, t in labels if rows[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[5000]["score"] == rows[5001]["score"]
    assert rows[None]["held_out"] is False and out.count() == len(docs) and {*df.columns} <= {*out.columns}


def test_held_out_labels_are_not_learned(spark, docs_of):
    docs, labels = planted()
    df = docs_of(docs)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = train(df, lab), train(df, other)
    assert a.lexicon == b.lexicon and a.events == b.events and np.allclose(a.weights, b.weights, rtol=1e-12)


def test_no_labels(spark, docs_of):
    df = docs_of([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in score(df, train(df, none)).collect()] == [0.0, 0.0]
    assert score(df.where("false"), train(df.where("false"), none)).count() == 0
