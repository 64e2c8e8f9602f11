"""UTF-8 validity of byte streams that arrive in chunks, in batch and in Structured Streaming."""

from __future__ import annotations

import codecs
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(state: tuple[bytes, bool], chunk: bytes) -> tuple[bytes, bool]:
    """(undecided tail, valid so far) after one more chunk."""
    tail, good = state
    if not good:
        return b"", False
    d = codecs.getincrementaldecoder("utf-8")()
    try:
        d.decode(tail + chunk, False)
    except UnicodeDecodeError:
        return b"", False
    return d.getstate()[0], True


def utf8_chunked(df: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Batch: (stream, valid), chunks in order of seq.  Partitions are sorted and a stream is folded chunk by chunk."""
    t = dict(df.dtypes)[stream]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, any_ = None, (b"", True), False
        for p in batches:
            rows = []
            for k, b in zip(p["k"], p["b"], strict=True):
                if any_ and k != key:
                    rows.append((key, state[1] and not state[0]))
                    state = (b"", True)
                key, any_ = k, True
                state = step(state, bytes(b) if b is not None else b"")
            yield pd.DataFrame(rows, columns=["k", "valid"])
        if any_:
            yield pd.DataFrame([(key, state[1] and not state[0])], columns=["k", "valid"])

    dealt = df.select(F.col(stream).alias("k"), F.col(seq).alias("s"), F.col(chunk).alias("b")).repartition("k").sortWithinPartitions("k", "s").select("k", "b")
    return dealt.mapInPandas(run, f"k {t}, valid boolean").withColumnRenamed("k", stream)


def utf8_stream(df: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Streaming: after each trigger (stream, valid, complete) of the streams that got chunks; a chunk waits for its turn."""
    t = dict(df.dtypes)[stream]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, good, turn, early = state.get if state.exists else (b"", True, 0, b"")
        wait = pickle.loads(early) if early else {}
        for p in batches:
            wait.update({int(s): bytes(b) if b is not None else b"" for s, b in zip(p["s"], p["b"], strict=True) if int(s) >= turn})
        while turn in wait:
            tail, good = step((tail, good), wait.pop(turn))
            turn += 1
        state.update((bytes(tail), good, turn, pickle.dumps(wait) if wait else b""))
        yield pd.DataFrame([(key[0], good, good and not tail)], columns=["k", "valid", "complete"])

    rows = df.select(F.col(stream).alias("k"), F.col(seq).alias("s"), F.col(chunk).alias("b"))
    out = rows.groupBy("k").applyInPandasWithState(update, f"k {t}, valid boolean, complete boolean", "tail binary, good boolean, turn long, early binary", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", stream)
