"""Embedding near-dedup with hierarchical navigable small-world graphs.

Equal vectors are one class. Classes are dealt to shards by a hash of the vector; each shard's graph is built in its own
task and written to the shared folder in pieces of at most ``PIECE`` bytes, since a graph in one row is a large object
in every buffer of the JVM it passes. Every class then queries every shard: classes are packed into blocks, blocks into
ranges, and a graph of at most ``shard_rows`` vectors meets the blocks of one range at a time, so that nothing passes
the driver and a task holds one graph and one block. A range has up to four times the vectors of a shard, so that graphs
are sent less often than blocks; ``SHARDS`` shards are searched at a time (a 64th of all if that is more), so that few
copies of the vectors are sent at once. Links come from a search a few at a time and are counted and joined to
components at once; what a task keeps of a query is its number of links and the local components it touches, however
many copies a group has. A search whose beam is full of links is repeated with twice the beam, and so is a block of
queries whose audit finds less than ``audit_recall`` of the links: a brute-force count for queries drawn until
``AUDIT_LINKS`` links or ``AUDIT_QUERIES`` queries were seen, judged for the block and for all blocks that the task has
searched in this graph. A beam as wide as the shard is exact.
Hits are verified by cosine in double precision.  A task returns per class the number of linked vectors and one edge per
local component touched, never all pairs; components are found by alternating stars.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
different length are never compared; repeated rows are linked copies; null vec_ids are carried and name no component
unless all of it is null; an empty table gives no rows; extra columns do no harm.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, components

M = 12
AUDIT_LINKS, AUDIT_QUERIES = 24, 256
BLOCK = 1024
PIECE = 1 << 18
SHARDS = 8
FOUND = "cid long, links long, a long, b long"


class Graph:
    """A small-world graph over unit rows.  Level 0 holds all nodes with 2 M links, level l a fraction M^-l of them."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float32)
        n = len(x)
        rank = np.random.default_rng(7).random(n)
        self.level = np.minimum((-np.log(np.maximum(rank, 1e-12)) / math.log(M)).astype(int), 6)
        self.adj = [np.full((n, 2 * M if lv == 0 else M), -1, np.int32) for lv in range(int(self.level.max()) + 1 if n else 1)]
        self.top: list[int] = []  # entry points: inserted nodes of the highest level so far

    def search(self, lv: int, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ef best nodes met at a level, as (ids, similarities), best first; -1 where there are none."""
        x, adj, n = self.x, self.adj[lv], len(self.x)
        b = len(q)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(b)[:, None]
        ids = entry.astype(np.int64)
        if ids.shape[1] > ef:
            ids = ids[:, :ef]
        sims = np.where(ids >= 0, np.einsum("bed,bd->be", x[ids], q), -np.inf).astype(np.float32)
        seen[rows, np.where(ids >= 0, ids, n)] = True
        done = ids < 0
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            k = min(width, open_sims.shape[1])
            pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k] if k < open_sims.shape[1] else np.tile(np.arange(k), (len(live), 1))
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            any_ = good.any(1)
            live, pick, good = live[any_], pick[any_], good[any_]
            if not len(live):
                break
            node = np.where(good, ids[live[:, None], pick], -1)
            done[live[:, None], pick] |= good
            near = np.where(node[:, :, None] >= 0, adj[node], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            slot = np.where(near >= 0, near, n)
            near = np.where(seen[live[:, None], slot], -1, near)
            seen[live[:, None], slot] = True
            s = np.einsum("bmd,bd->bm", x[near], q[live], optimize=False)
            s = np.where(near >= 0, s, -np.inf).astype(np.float32)
            all_ids = np.concatenate((ids[live], near), 1)
            all_sims = np.concatenate((sims[live], s), 1)
            all_done = np.concatenate((done[live], near < 0), 1)
            if all_ids.shape[1] > ef:
                best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
                all_ids, all_sims, all_done = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_done))
            if all_ids.shape[1] > ids.shape[1]:
                more = all_ids.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
            ids[live, : all_ids.shape[1]], sims[live, : all_ids.shape[1]], done[live, : all_ids.shape[1]] = all_ids, all_sims, all_done
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        entry = np.tile(np.array(self.top[:8], np.int64), (len(q), 1))
        for lv in range(len(self.adj) - 1, to, -1):
            ids, _ = self.search(lv, q, entry, 8)
            entry = ids[:, :4] if ids.shape[1] else entry
        return entry

    def choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates up to m, nearest first, such that none is nearer to a chosen one than to q; then the nearest rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * m]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        c = ids.shape[1]
        v = self.x[ids]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        for i in range(c):
            near = np.where(kept, mutual[:, i, :], -np.inf).max(1)
            ok = (ids[:, i] >= 0) & (near < sims[:, i]) & (count < m)
            kept[:, i] = ok
            count += ok
        place = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
        first = np.argsort(place, axis=1)[:, :m]
        out = np.take_along_axis(ids, first, 1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out

    def insert(self, batch: np.ndarray, ef: int = 40) -> None:
        q = self.x[batch]
        for lv in range(int(self.level[batch].max()), -1, -1):
            mine = np.flatnonzero(self.level[batch] >= lv)
            if lv >= len(self.adj) or not len(mine):
                continue
            qs, own = q[mine], batch[mine]
            sims = qs @ qs.T
            np.fill_diagonal(sims, -np.inf)
            k = min(2 * M, len(own) - 1)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if 0 < k < len(own) - 1 else np.tile(np.arange(len(own)), (len(own), 1))
            near_sims = np.take_along_axis(sims, near, 1)
            ids = np.where(near_sims > -np.inf, own[near], -1)
            if self.top:
                got, s = self.search(lv, qs, self.descend(qs, lv), ef)
                ids, near_sims = np.concatenate((got, ids), 1), np.concatenate((s, near_sims), 1)
            m = self.adj[lv].shape[1]
            chosen = self.choose(qs, ids, near_sims, M)
            self.adj[lv][own, :M] = chosen
            a, b = np.repeat(own, M), chosen.ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.lexsort((-np.einsum("nd,nd->n", self.x[a], self.x[b]), b))
            a, b = a[order], b[order]
            start = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
            pos = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0)) if len(b) else np.zeros(0, int)
            use = pos < m
            to = b[start]
            row = np.cumsum(start) - 1
            more = np.full((len(to), m), -1, np.int64)
            more[row[use], pos[use]] = a[use]
            for i in range(0, len(to), 256):
                t = to[i: i + 256]
                cand = np.sort(np.concatenate((self.adj[lv][t], more[i: i + 256]), 1), axis=1)
                cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
                s = np.where(cand >= 0, np.einsum("bcd,bd->bc", self.x[cand], self.x[t]), -np.inf)
                self.adj[lv][t] = self.choose(self.x[t], cand, s, m)
        best = self.level[batch].max()
        if not self.top or best >= self.level[self.top].max():
            self.top = [int(i) for i in batch[self.level[batch] == best][:8]] + ([] if not self.top or best > self.level[self.top].max() else self.top)
            self.top = self.top[:8]

    def build(self) -> Graph:
        order = np.random.default_rng(11).permutation(len(self.x))
        at = 0
        while at < len(order):
            size = min(512, max(64, at // 4))
            self.insert(order[at: at + size])
            at += size
        return self

    def audit(self, exact: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries drawn, their numbers of links by brute force)."""
        order = np.random.default_rng(len(q)).permutation(len(q))
        truth = np.zeros(0, np.int64)
        while len(truth) < min(len(q), AUDIT_QUERIES) and truth.sum() < AUDIT_LINKS:
            more = order[len(truth): len(truth) + 16]
            truth = np.concatenate((truth, (q[more] @ exact.T >= least).sum(1)))
        return order[: len(truth)], truth

    def hits(self, exact: np.ndarray, q: np.ndarray, least: float, recall: float, tally: np.ndarray | None = None, ef: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Links of cosine >= least as (queries, nodes), few at a time; (queries, None) takes back all that was given for these.

        exact: this graph's unit rows in double precision; q likewise.  tally: links found and true ones of the audits so
        far; this block's are added.
        """
        n, few = len(self.x), max(1, (1 << 21) // max(1, q.shape[1]))
        tally = np.zeros(2, np.int64) if tally is None else tally
        todo = np.arange(len(q))
        drawn, truth = self.audit(exact, q, least)
        found_of = np.zeros(len(q), np.int64)
        while len(todo):
            wide = ef >= n
            again: list[np.ndarray] = []
            step = max(1, (1 << 21) // (n + 1) if wide else min(256, (1 << 24) // (n + 1), (1 << 20) // (ef + 8 * M)))
            for i in range(0, len(todo), step):
                t = todo[i: i + step]
                full = np.zeros(len(t), bool)
                if wide:
                    r, node = np.nonzero(q[t] @ exact.T >= least - 1e-9)
                else:
                    q32 = q[t].astype(np.float32)
                    ids, sims = self.search(0, q32, self.descend(q32, 0), ef)
                    full = (sims.shape[1] >= ef) & (sims[:, -1] >= least - 1e-4)
                    r, c = np.nonzero((ids >= 0) & (sims >= least - 1e-4) & ~full[:, None])
                    node = ids[r, c]
                found_of[t] = 0
                for k in range(0, len(r), few):
                    a, b = t[r[k: k + few]], node[k: k + few]
                    ok = np.einsum("nd,nd->n", q[a], exact[b]) >= least
                    np.add.at(found_of, a[ok], 1)
                    yield a[ok], b[ok]
                again.append(t[full])
            full = np.concatenate(again)
            if not wide and not len(full):
                got = np.array([found_of[drawn].sum(), truth.sum()])
                if got[0] < recall * got[1] or (got + tally)[0] < recall * (got + tally)[1]:
                    full = np.arange(len(q))  # the audit failed: all again with a wider beam
                    yield full, None
            todo, ef = full, ef * 2
        tally += np.array([found_of[drawn].sum(), truth.sum()])

    def links(self, exact: np.ndarray, q: np.ndarray, least: float, recall: float, tally: np.ndarray | None = None, ef: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) pairs of hits()."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in self.hits(exact, q, least, recall, tally, ef):
            pairs = pairs + [(a, b)] if b is not None else [(x[~np.isin(x, a)], y[~np.isin(x, a)]) for x, y in pairs]
        return np.concatenate([a for a, _ in pairs] or [np.zeros(0, int)]), np.concatenate([b for _, b in pairs] or [np.zeros(0, int)])


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def rows_of(vectors: pd.Series, d: int) -> np.ndarray:
    """The vectors as rows; in single precision if that holds them exactly."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), d)
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if np.array_equal(x, y) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components ``label`` after links between a and b."""
    n = len(label)
    pairs = np.unique(label[a] * n + label[b])
    return local_components(n, pairs // n, pairs % n)[label]


def pieces(blob: bytes) -> list[bytes]:
    return [blob[i: i + PIECE] for i in range(0, len(blob), PIECE)]


def embedding_components(vectors: DataFrame, least: float = 0.9, shard_rows: int = 20_000, min_shards: int = 8, audit_recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for the rows of (vec_id, embedding)."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "embeddings")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for i, v in zip(p["vec_id"], p["embedding"], strict=True):
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v is not None else np.zeros(0)
                with np.errstate(over="ignore", invalid="ignore"):
                    good = len(x) > 0 and bool(np.isfinite(x).all())
                    if good and not 1e-140 < np.abs(x).max() < 1e140:
                        x = x / np.abs(x).max() if np.abs(x).max() > 0 else x  # the length alone would leave the range of doubles
                    good = good and bool(x.any())
                c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) if good else (0, 0)
                rows.append((i, len(x) if good else 0, c1, c2, x.tobytes() if good else None))
            yield pd.DataFrame(rows, columns=["vec_id", "d", "c1", "c2", "v"]).astype({"vec_id": "Int64"})

    rows = ws.write(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                    .mapInPandas(read, "vec_id long, d int, c1 long, c2 long, v binary"))
    classes = rows.where("d > 0").groupBy("d", "c1", "c2").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    n = {r[0]: r[1] for r in rows.where("d > 0").groupBy("d").agg(F.approx_count_distinct("c1")).collect()}
    shards = max(min_shards, -(-max(n.values(), default=1) // shard_rows))
    classes = ws.write(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.col("c1"), F.lit(shards)).cast("int")))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        d = int(p["d"].iloc[0])
        p = p.sort_values(["c1", "c2"])
        rows = rows_of(p["v"], d)
        x, tally = unit(rows), np.zeros(2, np.int64)
        g = Graph(x).build()
        label = np.arange(len(x))
        for i in range(0, len(x), BLOCK):
            for a, b in g.hits(x, x[i: i + BLOCK], least, audit_recall, tally):
                label = joined(label, a + i, b) if b is not None else label  # links taken back are links all the same
        parts = pieces(pack(x=rows, cid=p["cid"].to_numpy(), copies=p["copies"].to_numpy(), top=np.array(g.top), label=label,
                            level=g.level, **{f"adj{i}": v for i, v in enumerate(g.adj)}))
        return pd.DataFrame({"d": d, "shard": int(p["shard"].iloc[0]), "piece": range(len(parts)), "x": parts})

    graphs = ws.write(classes.groupBy("d", "shard").applyInPandas(build, "d int, shard int, piece int, x binary"))

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for d, own in p.groupby("d"):
                for i in range(0, len(own), BLOCK):
                    part = own.iloc[i: i + BLOCK]
                    parts = pieces(pack(x=rows_of(part["v"], int(d)), cid=part["cid"].to_numpy()))
                    yield pd.DataFrame({"d": int(d), "block": int(part["cid"].iloc[0]), "piece": range(len(parts)), "x": parts})

    blocks = ws.write(classes.select("d", "cid", "v").mapInPandas(blocks_of, "d int, block long, piece int, x binary"))
    most = max(n.values(), default=1)
    ranges = max(1, min(4, -(-most // shard_rows)), -(-most // (4 * shard_rows)))
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    wave = max(SHARDS, -(-shards // 64))
    paths = []
    for first in range(0, shards, wave):
        last = min(first + wave, shards) - 1
        held = graphs.where(F.col("shard").between(first, last)).select("d", "shard", each(0, ranges - 1).alias("range"), F.lit(-1).cast("long").alias("block"), "piece", "x")
        asked = blocks.select("d", each(first, last).alias("shard"), F.pmod(F.xxhash64("block"), F.lit(ranges)).cast("int").alias("range"), "block", "piece", "x")
        dealt = held.union(asked).repartition(min(max(1, len(n)) * (last - first + 1) * ranges, 20_000), "d", "shard", "range").sortWithinPartitions("d", "shard", "range", "block", "piece")
        paths.append(ws.write(dealt.mapInPandas(_search(least, audit_recall), FOUND), batch_rows=4)._textloom_path)
    found = spark.read.schema(FOUND).parquet(*paths)
    ws.drop(graphs)
    ws.drop(blocks)
    of = components(ws, found.where("a is not null").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("cid", "low", "d", "c1", "c2", "copies").join(of, "cid", "left").join(
        found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = ws.write(named)
    lows = named.where("comp is not null").groupBy("comp").agg(F.min("low").alias("least"))
    named = named.join(lows, "comp", "left").select("d", "c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    out = rows.select("vec_id", "d", "c1", "c2").join(named, ["d", "c1", "c2"], "left")
    comp = F.when(F.col("d") == 0, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.col("vec_id").eqNullSafe(comp).alias("kept"))


def _search(least: float, recall: float):
    """Rows come sorted by (d, shard, range, block, piece): a graph first (block -1), then the blocks that query it."""

    def opened(blob: bytes) -> tuple:
        z = np.load(io.BytesIO(blob))
        x = unit(z["x"])
        g = Graph.__new__(Graph)
        g.x, g.level, g.top = x.astype(np.float32), z["level"], z["top"].tolist()
        g.adj = [z[f"adj{i}"] for i in range(sum(k.startswith("adj") for k in z.files))]
        return g, x, z["cid"], z["copies"], z["label"], np.zeros(2, np.int64)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bytes]]:
        at, parts = None, []
        for p in batches:
            for d, shard, range_, block, x in zip(*(p[c] for c in ("d", "shard", "range", "block", "x")), strict=True):
                if at != (d, shard, range_, block):
                    if parts:
                        yield at, b"".join(parts)
                    at, parts = (d, shard, range_, block), []
                parts.append(x)
        if parts:
            yield at, b"".join(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for (*key, block), blob in whole(batches):
            if block < 0:
                at, held = key, None  # the graph before goes first
                held = opened(blob)
                continue
            if at != key:
                continue  # no vector of this length in this shard
            g, x, cid, copies, label, tally = held
            z = np.load(io.BytesIO(blob))
            own, n = z["cid"], len(cid)
            total, ties = np.zeros(len(own), np.int64), [np.zeros(0, np.int64)]
            for a, b in g.hits(x, unit(z["x"]), least, recall, tally):
                if b is None:
                    total[a], ties = 0, [t[~np.isin(t // n, a)] for t in ties]
                    continue
                ok = own[a] != cid[b]
                a, b = a[ok], b[ok]
                np.add.at(total, a, copies[b])
                ties.append(np.unique(a * n + label[b]))
            one = np.unique(np.concatenate(ties))  # an edge for each local component
            if not len(one):
                continue
            head = np.flatnonzero(total)
            yield pd.DataFrame({"cid": own[head], "links": total[head], "a": pd.array([None] * len(head), "Int64"), "b": pd.array([None] * len(head), "Int64")})
            yield pd.DataFrame({"cid": own[one // n], "links": 0, "a": pd.array(own[one // n], "Int64"), "b": pd.array(cid[one % n], "Int64")})

    return run


def op5_embedding_neardup(spark, sf_dir):
    from textloom.llm.common import table

    return embedding_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM r GROUP BY vec_id
"""
