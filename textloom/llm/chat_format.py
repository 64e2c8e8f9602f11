"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted inside the partition.  A batch of whole conversations is formatted without a
loop over bytes: control strings inside texts are escaped by Arrow's string kernels, segment lengths (header, text,
end mark) give cumulative offsets, and two scatter-index arrays copy all headers and all contents into one preallocated
buffer, which becomes the Arrow column of formatted conversations.

Template: ``<|im_start|>ROLE\n`` TEXT ``<|im_end|>\n`` for each turn.  Escaping is reversible: in texts and roles every
``<``, backslashes, ``|`` gets one more backslash before the bar, so no control string can occur; in roles a
backslash-coded newline keeps the header on one line.  The loss mask is a list of [start, end) byte offsets into the
formatted bytes, one per assistant turn, covering the escaped text and nothing else.

Defined results: null text and null role are empty; a null conv_id is a conversation of its own; turns are ordered by
turn (nulls first), role, text, so ties give one result; repeated rows are repeated turns; an empty table gives no rows;
extra columns are ignored.  A conversation is one output value and so is limited to Spark's 2 GB per value; it streams
through a task in batches, and no more than one batch and one conversation are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(a: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(a, r"<(\\*)\|", r"<\\\1|")


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def escape_role(a: pa.Array) -> pa.Array:
    a = pc.replace_substring(pc.replace_substring(a, "\\", "\\\\"), "\n", "\\n")
    return escape(a)


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s), flags=re.S)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 lengths of an array of strings without nulls."""
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], np.diff(off)


def _scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    src = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    out[np.repeat(to - src, lengths) + np.arange(len(data))] = data


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """conv: the ordinal of each row's conversation, ascending.  (bytes, conversation offsets, turns, loss spans)."""
    esc = escape(text)
    heads = pc.binary_join_element_wise(pa.scalar(START), escape_role(role), pa.scalar("\n"), "")
    h, hl = _bytes(heads)
    c, cl = _bytes(esc)
    tail = np.frombuffer((END + "\n").encode(), np.uint8)
    seg = hl + cl + len(tail)
    ends = np.cumsum(seg)
    starts = ends - seg
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, h, hl, starts)
    _scatter(out, c, cl, starts + hl)
    _scatter(out, np.tile(tail, len(seg)), np.full(len(seg), len(tail)), ends - len(tail))
    turns = np.bincount(conv, minlength=int(conv[-1]) + 1 if len(conv) else 0)
    last = np.cumsum(turns)
    offsets = np.concatenate(([0], ends[last - 1])) if len(turns) else np.zeros(1, np.int64)
    talk = np.flatnonzero(np.asarray(pc.equal(role, "assistant").to_numpy(zero_copy_only=False), bool))
    base = offsets[conv[talk]]
    a, b = starts[talk] + hl[talk] - base, ends[talk] - len(tail) - base
    return out, offsets, turns, [talk, conv[talk], a, b]


def _emit(rows: pa.Table) -> pa.RecordBatch:
    conv_col = rows.column("conv_id").combine_chunks()
    ids = conv_col.fill_null(0).to_numpy()
    null = np.asarray(conv_col.is_null())
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
    conv = np.cumsum(new) - 1
    out, offsets, turns, (_, of, a, b) = assemble(conv, rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
    first = np.flatnonzero(new)
    text = pa.Array.from_buffers(pa.large_string(), len(turns), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(turns))))), pa.int32()),
                                     pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
    return pa.RecordBatch.from_arrays([conv_col.take(pa.array(first)), pa.array(turns, pa.int64()), text.cast(pa.string()), spans],
                                      ["conv_id", "n_turns", "formatted", "loss_spans"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < 8 << 20:
            continue
        t = pa.Table.from_batches(held)
        ids = t.column("conv_id").combine_chunks()
        last = ids[len(ids) - 1].as_py()
        same = np.asarray(ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False))
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield _emit(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = t.slice(cut).nbytes
    if held:
        yield _emit(pa.Table.from_batches(held))


def chat_format(conv: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans), a row for each conversation of (conv_id, turn, role, text)."""
    rows = conv.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_format, SCHEMA)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for conv, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"], strict=True):
            turns = parse(text)
            h = hashlib.sha256()
            for role, body in turns:
                h.update(f"{role}\n{body}\n".encode())
            raw = text.encode()
            loss = [unescape(raw[s["start"]: s["end"]].decode()) for s in spans]
            g = hashlib.sha256()
            for x in loss:
                g.update(x.encode())
            rows.append((conv, len(turns), h.hexdigest(), sum(map(len, loss)), g.hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def op4_chat_format(spark, sf_dir):
    from textloom.llm.common import table

    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    return chat_format(rows).mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS header FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(header, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
