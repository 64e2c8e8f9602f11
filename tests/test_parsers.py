"""Known answers for the parsers, the diff and the reductions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import diff as d
from textloom.operators import parsers as p
from textloom.operators import reductions as r
from textloom.streaming.utf8_chunks import utf8_chunked


def frame(spark, texts, kind="string"):
    return spark.createDataFrame(list(enumerate(texts)), f"id int, t {kind}")


def test_json_tokens(spark):
    rows = p.json_tokens(frame(spark, ['{"a": [1.5e+10, true, null], "b\\"": -0}', '"open', "tru", "1.", "-x", "", None]), "id", "t").orderBy("id", "seq").collect()
    got = {i: [(x["type"], x["value"]) for x in rows if x["id"] == i] for i in range(7)}
    assert [k for k, _ in got[0]] == ["ObjectOpen", "String", "Colon", "ArrayOpen", "Number", "Comma", "True", "Comma", "Null", "ArrayClose", "Comma", "String", "Colon", "Number", "ObjectClose"]
    assert got[0][1] == ("String", '"a"') and got[0][11][1] == '"b\\""'
    assert got[1] == [("Error", '"open')]
    assert got[2][0] == ("Error", "tru") and got[4][0] == ("Error", "-x")
    assert not got[5] and not got[6]


@pytest.mark.parametrize(("text", "ok"), [("1", True), ("-1.5e+10", True), ("1.", False), ("1\n", False), ("", False), ("007", True), ("1e", False)])
def test_is_json_number(spark, text, ok):
    assert frame(spark, [text]).select(p.is_json_number("t")).first()[0] is ok


def test_json_unescape(spark):
    got = [x[0] for x in frame(spark, [r"a\nb", r"\\n", r"\"", r"A", "x\\", r"\q", "", None]).coalesce(1).select(p.json_unescape("t")).collect()]
    assert got == ["a\nb", r"\n", '"', r"A", "x\\", "q", "", None]


def test_xml_tokens(spark):
    rows = p.xml_tokens(frame(spark, ['<?xml version="1.0"?><a b="1">hi<br/></a><!-- c --><![CDATA[<x>]]>', "<", None]), "id", "t").orderBy("id", "seq").collect()
    assert [(x["type"], x["value"]) for x in rows] == [("Declaration", "xml"), ("OpenTag", "a"), ("Text", "hi"), ("SelfClose", "br"), ("CloseTag", "a"), ("Comment", " c "), ("CData", "<x>"), ("Error", "<")]
    assert frame(spark, ['a<b>c&d"\'']).select(p.xml_escape("t")).first()[0] == "a&lt;b&gt;c&amp;d&quot;&apos;"
    assert [x[0] for x in frame(spark, [" <a", "a", ""]).coalesce(1).select(p.looks_like_xml("t")).collect()] == [True, False, False]


def test_csv_details():
    cases = {'x"a",b': [["a", "b"]], '"a"x,b': [["a", 'a"x', "b"]], '"open,\n': [["open,\n"]], 'a,"b"': [["a", "b"]], "a,": [["a", ""]], "\n": [[""]], "a\rb\r\nc": [["a\rb"], ["c"]], '""': [[""]], '"a"""': [['a""']]}
    assert {t: list(p.csv_records(t)) for t in cases} == cases
    assert list(p.csv_records("'a|b'|c\nd", "|", "'")) == [["a|b", "c"], ["d"]]


@pytest.mark.parametrize(("text", "delimiter", "want"), [
    ('"say ""hi""",x', ",", [['say ""hi""', "x"]]), ("a,,c", ",", [["a", "", "c"]]), ("a,b\r\nc,d\n", ",", [["a", "b"], ["c", "d"]]), ("a|b", "|", [["a", "b"]]), ('"x\ny",z', ",", [["x\ny", "z"]]), ("", ",", [])])
def test_csv(spark, text, delimiter, want):
    rows = p.csv_rows(frame(spark, [text]), "id", "t", delimiter).orderBy("row", "col").collect()
    got = [[x["value"] for x in rows if x["row"] == i] for i in range(1, 1 + max((x["row"] for x in rows), default=0))]
    assert got == want
    assert frame(spark, [text]).select(p.parse_csv_row("t", delimiter)).first()[0] == (want[0] if want else [])


def test_markdown(spark):
    text = "# T\n\n- a\n2.b\n> q\n```py\n# no\n```\n***\n####### x"
    rows = p.markdown_tokens(frame(spark, [text, None]), "id", "t").orderBy("seq").collect()
    assert [(x["type"], x["content"], x["level"]) for x in rows] == [
        ("Heading", "T", 1), ("Paragraph", "", 0), ("ListItem", "a", 0), ("ListItem", "b", 1), ("Blockquote", "q", 0), ("CodeBlock", "py", 0), ("CodeBlock", "# no", 0), ("CodeBlock", "", 0),
        ("HorizontalRule", "", 0), ("Heading", "x", 6)]


def test_rows_with_equal_and_null_keys_stay_apart(spark):
    rows = spark.createDataFrame([(1, "```\na"), (1, "b"), (None, "```"), (None, "c")], "id int, t string")
    got = p.markdown_tokens(rows, "id", "t")
    assert sorted((x["type"], x["content"]) for x in got.collect()) == [("CodeBlock", ""), ("CodeBlock", ""), ("CodeBlock", "a"), ("Paragraph", "b"), ("Paragraph", "c")]
    assert "Exchange" not in got._jdf.queryExecution().toString()
    rows = spark.createDataFrame([(1, "[s]\na=1"), (1, "b=2"), (None, "[t]"), (None, "c=3")], "id int, t string")
    got = p.config_entries(rows, "id", "t")
    assert sorted((x["section"], x["name"]) for x in got.collect()) == [("", "b"), ("", "c"), ("s", "a")]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_markdown_raw_lines_and_byte_offsets(spark):
    text = "# é\n  x\n\n```\n  ü\n"
    rows = p.markdown_tokens(frame(spark, [text, "", "\n"]), "id", "t").orderBy("id", "seq").collect()
    mine = [x for x in rows if x["id"] == 0]
    assert "".join(x["text"] for x in mine) == text
    assert [x["offset"] for x in mine] == [0, 5, 9, 10, 14]
    assert [(x["id"], x["text"], x["offset"]) for x in rows if x["id"]] == [(2, "\n", 0)]


def test_config(spark):
    text = "; c\n[database]\nhost = localhost\nname=\"x y\"\n\n[server]\nport=80\nbad\n"
    e = p.config_entries(frame(spark, [text, None]), "id", "t")
    assert [tuple(x)[1:] for x in e.orderBy("line").collect()] == [("database", "host", "localhost", 3), ("database", "name", "x y", 4), ("server", "port", "80", 7)]
    assert p.config_get(e, "id", "server", "port").first()["value"] == "80"
    assert p.config_get(e, "id", "server", "none", "d").first()["value"] == "d"


@pytest.mark.parametrize(("line", "want"), [
    ("2024-01-15 03:21:44 ERROR connection timeout", ("2024-01-15 03:21:44", "ERROR", "connection timeout")), ("[ts] INFO server started", ("ts", "INFO", "server started")),
    ("INFO: x", ("", "INFO", "x")), ("plain words", ("", "", "plain words")), ("[open", ("", "", "[open")), ("INFORMATION then", ("", "", "INFORMATION then")), ("", ("", "", ""))])
def test_log_line(spark, line, want):
    assert tuple(frame(spark, [line]).select(p.parse_log_line("t")).first()[0]) == want


def test_log_line_details(spark):
    cases = {"\tWARNING: x": ("", "WARNING", "x"), "XERROR ERROR y": ("", "", "XERROR ERROR y"), "a info b ERROR c": ("a", "info", "b ERROR c"), "[a] ": ("a", "", ""),
             "[t]  WARN:\t m ": ("t", "WARN", "m "), "é FATAL": ("é", "FATAL", ""), " \t": ("", "", " \t"), "x INFO, ERROR: z": ("x INFO,", "ERROR", "z")}
    got = frame(spark, cases).coalesce(1).orderBy("id").select(p.parse_log_line("t").alias("e")).collect()
    assert [tuple(x["e"]) for x in got] == list(cases.values())
    assert frame(spark, [None]).select(p.parse_log_line("t")).first()[0] is None


def test_log_lines_compile_and_give_offsets(spark):
    rows = p.log_lines(frame(spark, ["é INFO a\n\nERROR b\n", "", None]), "id", "t", offsets=True).orderBy("id", "line_number").collect()
    assert [(x["line_number"], x["byte_offset"], x["level"], x["rank"]) for x in rows] == [(1, 0, "INFO", 2), (2, 10, "", 6), (3, 11, "ERROR", 4)]
    plan = p.filter_log_lines(frame(spark, ["INFO a"]), "id", "t", "WARN")
    for part in spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan._jdf.queryExecution().executedPlan()).mkString("\n").split("maxMethodCodeSize:")[1:]:
        assert int(part.split(";")[0]) < 64_000


def test_log_counts_and_filter(spark):
    text = "a INFO x\nb INFO y\nc ERROR z\nd WARN w\ne FATAL v\n"
    got = p.count_log_levels(frame(spark, [text]), "id", "t").first()
    assert (got["n_info"], got["n_error"], got["n_warn"], got["n_fatal"], got["n_total"]) == (2, 1, 1, 1, 5)
    kept = p.filter_log_lines(frame(spark, ["INFO a\nERROR b\nWARN c"]), "id", "t", "ERROR").collect()
    assert [(x["line_number"], x["line"]) for x in kept] == [(2, "ERROR b")]
    assert [x[0] for x in frame(spark, ["warning", "Warn", "DEBUG", None]).coalesce(1).select(p.parse_log_level("t")).collect()] == ["WARN", "UNKNOWN", "DEBUG", None]


def test_diff(spark):
    rows = spark.createDataFrame([(0, "a\nb", "a\nc"), (1, "a", "x\ny"), (2, "", ""), (3, None, "a")], "id int, a string, b string")
    assert [x[0] for x in rows.coalesce(1).select(d.count_diff_lines("a", "b")).collect()] == [2, 3, 0, None]
    ops = rows.select("id", F.inline(d.line_diff("a", "b"))).where("id = 0").orderBy("seq").collect()
    assert [(x["type"], x["a_text"], x["b_text"], x["a_line"], x["b_line"]) for x in ops] == [("Equal", "a", "a", 1, 1), ("Delete", "b", "", 2, 0), ("Insert", "", "c", 0, 2)]
    words = spark.createDataFrame([(0, "hello", "help"), (1, "hello", "jello"), (2, "", "x"), (3, None, "")], "id int, a string, b string").coalesce(1)
    assert [tuple(x) for x in words.select(d.common_prefix_length("a", "b"), d.common_suffix_length("a", "b"), d.text_equal("a", "b")).collect()] == [(3, 0, False), (0, 4, False), (0, 0, False), (None, None, None)]


def test_diff_script_rebuilds_both_texts_and_is_shortest():
    rng = random.Random(3)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        ops = d.diff("\n".join(x) + "\n" * bool(x), "\n".join(y) + "\n" * bool(y))
        assert [o[1] for o in ops if o[0] != "Insert"] == x and [o[2] for o in ops if o[0] != "Delete"] == y
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, s in enumerate(x):
            for j, u in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if s == u else max(best[i][j + 1], best[i + 1][j])
        assert sum(o[0] != "Equal" for o in ops) == len(x) + len(y) - 2 * best[-1][-1]


def test_diff_follows_the_table_at_every_size():
    rng = random.Random(4)
    for n in (5, 70, 300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(n))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, s in enumerate(x):
            for j, u in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if s == u else max(best[i][j + 1], best[i + 1][j])
        i, j, want = len(x), len(y), []
        while i or j:
            if i and j and x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                want.append(("Equal", i + 1, j + 1))
            elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
                j -= 1
                want.append(("Insert", 0, j + 1))
            else:
                i -= 1
                want.append(("Delete", i + 1, 0))
        a, b = "\n".join(x), "\n".join(y)
        assert [(o[0], o[3], o[4]) for o in d.diff(a, b)] == want[::-1]
        assert d.changes(a, b) == len(x) + len(y) - 2 * best[-1][-1]


def test_diff_of_many_lines_is_exact():
    x = [f"line {i}" for i in range(6000)]
    y = [*x[:10], "new", *x[12:3000], *x[3500:], "end"]
    ops = d.diff("\n".join(x), "\n".join(y))
    assert sum(o[0] != "Equal" for o in ops) == 2 + 500 + 2 == d.changes("\n".join(x), "\n".join(y))
    assert [o[1] for o in ops if o[0] != "Insert"] == x and [o[2] for o in ops if o[0] != "Delete"] == y


def test_diff_line_by_line_above_a_limit(spark):
    rows = spark.createDataFrame([(0, "a\nb\nc", "b\nc")], "id int, a string, b string")
    assert rows.select(d.count_diff_lines("a", "b"), d.count_diff_lines("a", "b", cells=5), d.count_diff_lines("a", "b", cells=6)).first()[:] == (1, 5, 1)
    ops = rows.select(F.inline(d.line_diff("a", "b", cells=5))).collect()
    assert [(o["type"], o["a_line"], o["b_line"]) for o in ops] == [("Delete", 1, 0), ("Insert", 0, 1), ("Delete", 2, 0), ("Insert", 0, 2), ("Delete", 3, 0)]


def test_common_lengths_of_bytes(spark):
    rng = random.Random(5)
    pairs = [(i, rng.randbytes(n) , rng.randbytes(m)) for i, (n, m) in enumerate([(0, 0), (0, 5), (1, 1), (300, 300)])]
    pairs += [(10 + i, s + rng.randbytes(3) + e, s + rng.randbytes(2) + e) for i, (s, e) in enumerate([(rng.randbytes(a), rng.randbytes(b)) for a, b in ((1, 0), (7, 9), (1000, 64), (0, 2000))])]

    def common(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    rows = spark.createDataFrame(pairs, "i int, a binary, b binary").coalesce(1).orderBy("i").select("a", "b", d.common_prefix_length("a", "b").alias("p"), d.common_suffix_length("a", "b").alias("s")).collect()
    assert [(r["p"], r["s"]) for r in rows] == [(common(r["a"], r["b"]), common(r["a"][::-1], r["b"][::-1])) for r in rows]


@pytest.mark.parametrize("parts", [1, 5])
def test_reductions_do_not_depend_on_partitions(spark, parts):
    rows = frame(spark, ["a,b\n", "xx,", "é\n\n", None, ""]).repartition(parts)
    got = rows.agg(r.agg_count_byte("t", ","), r.agg_count_newlines("t"), r.agg_is_ascii("t"), r.agg_valid_utf8("t"), r.agg_find_byte("t", ","), r.agg_find_byte("t", "q")).first()
    assert tuple(got) == (2, 3, False, True, 1, None)
    none = rows.where("id < 0").agg(r.agg_count_byte("t", ","), r.agg_is_ascii("t"), r.agg_find_byte("t", ",")).first()
    assert tuple(none) == (0, True, None)


def test_chunks(spark):
    got = r.for_each_chunk(frame(spark, ["abcdefg", "", None]), "id", "t", 3, lambda b, o: len(b), "long").orderBy("offset").collect()
    assert [tuple(x) for x in got] == [(0, 0, 3), (0, 3, 3), (0, 6, 1)]


def test_chunked_utf8(spark):
    rows = [(1, 0, b"\xc2"), (2, 1, b"\xa5"), (2, 0, b"\xc2"), (3, 0, b"\xff"), (3, 1, b"a"), (4, 0, b"a" * 9), (5, 0, b"\xf0\x9f"), (5, 2, b"\x80"), (5, 1, b"\x98")]
    got = utf8_chunked(spark.createDataFrame(rows, "stream_id int, seq int, chunk binary")).collect()
    assert {x["stream_id"]: x["valid"] for x in got} == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_tokens_come_in_pieces_of_a_batch():
    texts = ["<a>x</a>" * 40_000, None, "", *["<b/>"] * 1000, "<c>" * 400_000, "<d/>"]
    got = list(p.xml_tokens_udf.func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert [len(x) for x in got] == [1003, 1, 1, 0]
    assert [len(y) if y is not None else None for x in got for y in x] == [120_000, None, 0, *[1] * 1000, 400_000, 1]


def test_common_lengths_take_an_argument_once(spark):
    rng = random.Random(5)
    pairs = [(rng.choice(["", "é", "xé"]) + "ab" * rng.randrange(5), "ab" * rng.randrange(5) + rng.choice(["", "é", "yé"])) for _ in range(200)] + [("x" * 70_000, "x" * 69_999), ("a" * 50_000 + "b" * 9, "c" + "b" * 9)]
    rows = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    common = lambda x, y: next((i for i, (m, n) in enumerate(zip(x, y, strict=False)) if m != n), min(len(x), len(y)))
    want = [(common(x.encode(), y.encode()), common(x.encode()[::-1], y.encode()[::-1])) for x, y in pairs]
    assert [tuple(x) for x in rows.select(d.common_prefix_length("a", "b"), d.common_suffix_length("a", "b")).collect()] == want
    for f in (d.common_prefix_length, d.common_suffix_length):
        assert rows.select(f(F.initcap("a"), "b").alias("out"))._jdf.queryExecution().optimizedPlan().toString().count("initcap(") == 1


def test_log_filter_parses_a_line_once(spark):
    plan = p.filter_log_lines(frame(spark, ["INFO a"]), "id", "t", "WARN")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2  # both of one parsed line


def test_log_keywords_as_by_hand(spark):
    rng = random.Random(6)
    parts = [*p.KEYWORDS, "INFORMATION", "xERROR", "a", "é\U0001f600", "[", "]", ":", " ", "\t", " ", ",", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(9))) for _ in range(600)]

    def first(t):
        at = [i for w in p.KEYWORDS for i in [t.find(w)] if i >= 0 and (i == 0 or t[i - 1] in " \t") and (i + len(w) == len(t) or t[i + len(w)] in " :")]
        return min(at) + 1 if at else None

    assert [x[0] for x in frame(spark, texts).coalesce(1).orderBy("id").select(p._first_keyword(F.col("t"))).collect()] == [first(t) for t in texts]
