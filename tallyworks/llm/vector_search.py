"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers, floor(256 * x). For a query, the largest inner product is the smallest Euclidean distance
once every data vector x gets one more coordinate sqrt(M - |x|^2) (M: the largest squared norm; a query gets 0 there), so
distances obey the triangle inequality. The index keys each vector by its nearest pivot and its distance to it, sorts by
(pivot, distance) and packs the sorted run into segments: annuli around a pivot, each a row of a table in the shared
folder. Queries are packed into blocks the same way. A block first searches the annuli that hold its own keys, which
gives each query a k-th best score. Then it expands outwards in waves: of the annuli that the triangle inequality cannot
exclude for one of its queries (|d(q, p) - d(x, p)| <= d(q, x)) it visits the nearest WAVE, tightens every query's
bound, and goes on with GROWTH times as many until none is left. Inside a visit only the queries whose own bound reaches
the annulus are scored. The scores themselves are exact integers.

Pivots are a bounded sample (PIVOTS rows) and every vector is indexed. Queries and data meet as packed blocks, never as
rows, and the blocks that visit one segment are dealt to several tasks. One vector repeated many times fills consecutive
segments: segments are cut by row count, not by key.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null
id; shorter vectors count as padded with zeros; ties go to the smaller vec_id; a query excludes its own row (rows that
repeat its id included); with fewer than k other vectors all are returned; repeated candidate rows are one candidate
each id and vector; an empty table gives an empty result; extra columns are ignored. Components and scores that do not
fit a long are the nearest long (such scores tie).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

_LONG = (1 << 63) - 1
K = 5
SCALE = 256
PIVOTS = 64
SEGMENT_ROWS = 4096
QUERY_ROWS = 512
WAVE, GROWTH = 16, 16  # annuli of a block's first expansion, and how much larger the next one is
SLICE_BLOCKS = 16  # query blocks that meet a segment in one task
_PACKED = "block bigint, pivot int, d_min double, d_max double, n int, payload binary"


def pack(ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray, values: np.ndarray) -> bytes:
    """ids, distance keys, float payload (k-th best so far, for queries) and the integer matrix."""
    small = vectors.dtype != np.int64
    return struct.pack("<qqq", len(ids), vectors.shape[1], int(small)) + ids.astype("<i8").tobytes() + keys.astype("<f8").tobytes() + values.astype("<f8").tobytes() + vectors.astype("<i2" if small else "<i8").tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, d, small = struct.unpack_from("<qqq", b)
    at = 24
    ids, keys, values = np.frombuffer(b, "<i8", n, at), np.frombuffer(b, "<f8", n, at + 8 * n), np.frombuffer(b, "<f8", n, at + 16 * n)
    return ids, np.frombuffer(b, "<i2" if small else "<i8", n * d, at + 24 * n).reshape(n, d), keys, values


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through floating point where every partial sum stays below 2**53."""
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (q, x))
    top = lambda m: int(np.abs(m.astype(np.int64)).max(initial=0))
    if top(q) * top(x) * max(1, d) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top(q) * top(x) * max(1, d) <= _LONG:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), norm2 of the vectors that take part."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.greatest(F.lit(-_LONG), F.floor(x.cast("double") * SCALE))).alias("v"))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


class Pivots:
    """Pivot vectors with their extra coordinate, and the bound M."""

    def __init__(self, vectors: list[list[int]], norms: list[int], bound: int):
        d = max((len(v) for v in vectors), default=1) or 1
        self.m = np.zeros((len(vectors), d))
        for i, v in enumerate(vectors):
            self.m[i, : len(v)] = v
        self.extra, self.norm, self.bound = np.sqrt(np.maximum(bound - np.array(norms, float), 0)), np.array(norms, float), float(bound)

    def distances(self, x: np.ndarray, norm2: np.ndarray, query: bool) -> np.ndarray:
        d = max(x.shape[1], self.m.shape[1])
        dot = np.pad(x.astype(float), ((0, 0), (0, d - x.shape[1]))) @ np.pad(self.m, ((0, 0), (0, d - self.m.shape[1]))).T
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.bound - norm2, 0))
        return np.sqrt(np.maximum(norm2[:, None] + self.norm[None] - 2 * dot + (extra[:, None] - self.extra[None]) ** 2, 0))


def _matrix(col: pa.Array) -> np.ndarray:
    rows = col.to_pylist()
    d = max((len(r) for r in rows), default=0) or 1
    out = np.zeros((len(rows), d), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _key(batches: Iterator[pa.RecordBatch], pivots: Pivots, query: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, norm2 = _matrix(part.column(1)), np.asarray(part.column(2)).astype(float)
            d = pivots.distances(x, norm2, query)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=["vec_id", "v", "pivot", "dist"])


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut the sorted run of a task into segments of one pivot and at most ``rows`` rows."""
    from pyspark import TaskContext

    serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held: list[tuple] = []
    made = 0

    def close():
        nonlocal made
        ids = np.array([r[0] for r in held], np.int64)
        v = _matrix(pa.array([r[1] for r in held], pa.list_(pa.int64())))
        if np.abs(v).max(initial=0) < 1 << 15:
            v = v.astype(np.int16)
        d = np.array([r[3] for r in held])
        out = pa.RecordBatch.from_arrays([pa.array([serial + made], pa.int64()), pa.array([held[0][2]], pa.int32()), pa.array([d.min()]), pa.array([d.max()]), pa.array([len(held)], pa.int32()), pa.array([pack(ids, v, d, np.full(len(d), -np.inf))], pa.binary())],
                                         names=["block", "pivot", "d_min", "d_max", "n", "payload"])
        made += 1
        held.clear()
        return out

    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and (r[2] != held[0][2] or len(held) >= rows):
                yield close()
            held.append(r)
    if held:
        yield close()


def build(vectors: DataFrame, pivots: Pivots, query: bool, rows: int, name: str) -> DataFrame:
    """The packed table of segments (or query blocks), in the shared folder."""
    keyed = vectors.select("vec_id", "v", "norm2").mapInArrow(lambda b: _key(b, pivots, query), "vec_id bigint, v array<bigint>, pivot int, dist double")
    keyed = c.materialize(keyed, f"{name}-keys")
    parts = max(1, -(-keyed.count() // (rows * 4)))
    sorted_ = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    packed = c.materialize(sorted_.mapInArrow(lambda b: _pack(b, rows), _PACKED), name)
    c.release(keyed)
    return packed


def _reach(q: np.ndarray, kth: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(norms, the distance within which anything better than each query's k-th best score lies)."""
    norm2 = (q.astype(float) ** 2).sum(axis=1)
    # one unit of score, and a little for rounding, on top
    return norm2, np.sqrt(np.maximum(norm2 + bound - 2 * (kth - 1), 0)) * (1 + 1e-9) + 1e-3


def _visits(batches: Iterator[pa.RecordBatch], pivots: Pivots, first: bool) -> Iterator[pa.RecordBatch]:
    """For each query block and pivot: the keys of its queries, and the range of keys it has to see. First round: just the
    block's own range."""
    for batch in batches:
        rows = []
        for block, pivot, lo, hi, payload in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("block", "pivot", "d_min", "d_max", "payload"))):
            if first:
                rows.append((block, pivot, lo, hi, lo, hi))
                continue
            _, q, _, kth = unpack(payload)
            norm2, reach = _reach(q, kth, pivots.bound)
            d = pivots.distances(q, norm2, True)
            lows, highs = (d - reach[:, None]).min(axis=0), (d + reach[:, None]).max(axis=0)
            rows += [(block, p, float(lows[p]), float(highs[p]), float(d[:, p].min()), float(d[:, p].max())) for p in range(d.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int32(), *[pa.float64()] * 4))], names=["qblock", "pivot", "lo", "hi", "near", "far"])


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int, pivots: Pivots) -> pd.DataFrame:
    """The best k of one segment for each query of some blocks."""
    out: list[tuple] = []
    for pivot, d_min, d_max, payload in left[["pivot", "d_min", "d_max", "payload"]][:1].itertuples(index=False):
        ids, x, _, _ = unpack(payload)
        repeats = len(np.unique(ids)) < len(ids)
        for block, q_payload in zip(right["qblock"], right["payload"]):
            qids, q, _, kth = unpack(q_payload)
            norm2, reach = _reach(q, kth, pivots.bound)
            d = pivots.distances(q, norm2, True)[:, pivot]
            rows = np.flatnonzero((d - reach <= d_max) & (d + reach >= d_min))
            s = products(q[rows], x)
            worth = s >= kth[rows, None]
            for i in np.flatnonzero(worth.any(axis=1)):
                qid = qids[rows[i]]
                at = np.flatnonzero(worth[i] & (ids != qid))
                if repeats:  # one candidate each, as in ``best``, before the cut to k
                    at = at[np.unique(np.stack([ids[at], s[i, at]]), axis=1, return_index=True)[1]]
                if len(at) > k:
                    # ties at the k-th place are decided by id
                    cut = np.partition(s[i, at], len(at) - k)[len(at) - k]
                    at = at[s[i, at] >= cut]
                    at = at[np.lexsort((ids[at], -s[i, at]))][:k]
                out += [(block, int(qid), int(ids[j]), int(s[i, j])) for j in at]
    return pd.DataFrame(out, columns=["qblock", "query_id", "vec_id", "score"]).astype("int64")


def visit(blocks: DataFrame, segments: DataFrame, visits: DataFrame, k: int, pivots: Pivots, slices: int) -> DataFrame:
    """Search the listed (qblock, segment) pairs; rows of (qblock, query_id, vec_id, score). The blocks that visit one
    segment are dealt to ``slices`` tasks."""
    sliced = visits.select("qblock", "segment", F.pmod(F.xxhash64("qblock"), F.lit(slices)).alias("slice"))
    left = segments.select(F.col("block").alias("segment"), "pivot", "d_min", "d_max", "payload").join(sliced.select("segment", "slice").distinct(), "segment")
    right = sliced.join(blocks.select(F.col("block").alias("qblock"), "payload"), "qblock").select(F.col("segment").alias("seg"), F.col("slice").alias("sl"), "qblock", "payload")
    return left.groupBy("segment", "slice").cogroup(right.groupBy("seg", "sl")).applyInPandas(lambda a, b: _search(a, b, k, pivots), "qblock bigint, query_id bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query, with their rank; repeated candidates are one. Spark limits each task's group to the first
    k ranks before the shuffle."""
    found = found.select(*by, "vec_id", "score").withColumn("rank", F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")))
    return found.where(F.col("rank") <= k).dropDuplicates([*by, "rank"])


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, pivots: int = PIVOTS, segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. Queries default to the rows whose vec_id is divisible by 50."""
    data = quantised(vectors)
    asked = data.where("vec_id % 50 = 0") if queries is None else quantised(queries)
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    bound = data.agg(F.max("norm2")).first()[0]
    if bound is None:
        return vectors.sparkSession.createDataFrame([], out)
    chosen = _pivot_rows(data, pivots)
    index = Pivots([r["v"] for r in chosen], [r["norm2"] for r in chosen], bound)
    segments, blocks = build(data, index, False, segment_rows, "vs-segments"), build(asked, index, True, query_rows, "vs-queries")
    cover = segments.select(F.col("block").alias("segment"), "pivot", "d_min", "d_max")
    n_segments, slices = cover.count(), max(1, -(-blocks.select("block").count() // SLICE_BLOCKS))

    def pairs(bounded: DataFrame, first: bool) -> DataFrame:
        """(qblock, segment, gap): annuli that some query of a block reaches, and their distance from its keys."""
        ranges = bounded.mapInArrow(lambda b: _visits(b, index, first), "qblock bigint, pivot int, lo double, hi double, near double, far double")
        gap = F.greatest(F.lit(0.0), F.col("near") - F.col("d_max"), F.col("d_min") - F.col("far"))
        return ranges.join(cover, "pivot").where("d_min <= hi AND d_max >= lo").select("qblock", "segment", gap.alias("gap"))

    by = ("qblock", "query_id")
    seen = c.materialize(pairs(blocks, True), "vs-visits")
    found = c.materialize(best(visit(blocks, segments, seen, k, index, slices), k, by), "vs-found")
    wave = WAVE
    while True:
        # each query's bound goes into its block, of at most query_rows queries
        kth = found.where(F.col("rank") == k).groupBy(F.col("qblock").alias("block")).agg(F.collect_list(F.struct("query_id", F.col("score").alias("kth"))).alias("kth"))
        bounded = c.materialize(blocks.join(kth, "block", "left").mapInArrow(_set_bounds, _PACKED), "vs-bounded")
        todo = pairs(bounded, False).join(seen.select("qblock", "segment"), ["qblock", "segment"], "left_anti")
        if wave < n_segments:
            todo = todo.withColumn("at", F.row_number().over(W.partitionBy("qblock").orderBy("gap", "segment"))).where(F.col("at") <= wave).drop("at")
        todo = c.materialize(todo, "vs-visits")
        more = visit(bounded, segments, todo, k, index, slices)
        better = c.materialize(best(found.drop("rank").unionByName(more), k, by), "vs-found")
        c.release(found, bounded)
        found, seen = better, seen.unionByName(todo)
        if wave >= n_segments:
            break
        wave *= GROWTH
    c.release(segments, blocks)
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def _pivot_rows(data: DataFrame, n: int) -> list:
    """A bounded sample: the n vectors of smallest hash, equal vectors once."""
    return data.groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v"), F.first("norm2").alias("norm2")).orderBy("h").limit(n).collect()


def _set_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = []
        for payload, kth in zip(batch.column(batch.schema.get_field_index("payload")).to_pylist(), batch.column(batch.schema.get_field_index("kth")).to_pylist()):
            ids, q, d, _ = unpack(payload)
            known = {r["query_id"]: r["kth"] for r in kth or ()}
            payloads.append(pack(ids, q, d, np.array([float(known.get(int(i), -np.inf)) for i in ids])))
        i = batch.schema.get_field_index("payload")
        yield batch.set_column(i, "payload", pa.array(payloads, pa.binary())).select(["block", "pivot", "d_min", "d_max", "n", "payload"])
