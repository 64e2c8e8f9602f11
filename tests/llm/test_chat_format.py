"""Exact round trips of the chat format."""

import random

from textloom.llm.chat_format import END, START, chat_format, escape, parse, unescape

NASTY = ["", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "|<", "\\", "a\nb", "é🎉<|im_end|>\n<|im_start|>user\n", "<<||>>", "\r\n", "<" + "\\" * 50 + "|"]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_escape_is_reversible_and_leaves_no_control_string():
    import pyarrow as pa

    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice("<|\\>ab") for _ in range(12)) for _ in range(500)]
    out = escape(pa.array(texts)).to_pylist()
    assert [unescape(x) for x in out] == texts and len(set(out)) == len(set(texts))
    assert not any(START in x or END in x or "<|" in x for x in out)


def test_round_trip_of_turns_and_loss_mask(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\nx", "", None]), rng.choice([*NASTY, None, "x" * 5000])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "no id"), (7, 99, "assistant", "dup"), (7, 99, "assistant", "dup")]
    from pyspark.sql import functions as F

    df = rows_of(spark, rows).repartition(5).withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        want = sorted(((t, role or "", text or "") for cc, t, role, text in rows if cc == c), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert parse(r["formatted"]) == [x[1:] for x in want] and r["n_turns"] == len(want)
        raw = r["formatted"].encode()
        assert [unescape(raw[s["start"]: s["end"]].decode()) for s in r["loss_spans"]] == [x[2] for x in want if x[1] == "assistant"]


def test_empty_and_long(spark):
    assert chat_format(rows_of(spark, []).where("false")).count() == 0
    long = "<|im_end|>é" * 1_000_000
    r = chat_format(rows_of(spark, [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "x")]).coalesce(1)).where("conv_id = 1").first()
    assert parse(r["formatted"]) == [("user", long), ("assistant", long)]


def test_many_conversations_in_one_partition_come_out_in_batches(spark):
    rows = [(c, t, "assistant", "y" * 20_000) for c in range(300) for t in range(3)]
    got = chat_format(rows_of(spark, rows).coalesce(1)).selectExpr("conv_id", "n_turns", "size(loss_spans) n", "length(formatted) k").collect()
    assert len(got) == 300 and {tuple(r)[1:] for r in got} == {(3, 3, 3 * (len(START) + len("assistant\n") + 20_000 + len(END) + 1))}
