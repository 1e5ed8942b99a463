"""Shared pieces of the training-data operators: shared storage, vectorised word hashing, components.

Word hashing works on whole Arrow batches with numpy: the bytes of many documents are joined, mapped through a
256-entry table (lower case, separators), and every word gets a 64-bit polynomial hash from one prefix sum. No
Python code runs per word.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction, so that thresholds compare integers
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's default file system resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees, set by the cluster in ``spark.checkpoint.dir``; without it, a temporary one, but
    only where driver and executors are one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyworks.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyworks-")
        spark.conf.set("tallyworks.shared.dir", root)
    return qualified(spark, root).rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Owns every path that is handed out while it is open, and deletes them when it closes, but for those kept: they
    pass to the scope around it, or to the caller."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scope:
        self.token = _scope.set(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = _paths[df]
        self.paths.discard(path)
        if (around := self.token.old_value) not in (None, self.token.MISSING):
            around.paths.add(path)
        return df

    def __exit__(self, *_) -> None:
        _scope.reset(self.token)
        for path in self.paths:
            drop_path(self.spark, path)


def scoped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) whose result is written; all other tables that it wrote are deleted. What is left is the
    result, which the caller may ``release``."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **values) -> DataFrame:
        with Scope(spark) as s:
            return s.keep(materialize(query(spark, *args, **values), query.__name__))

    return run


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (s := _scope.get()) is not None:
        s.paths.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        if (path := _paths.pop(t, None)) is not None:
            drop_path(t.sparkSession, path)
            if (s := _scope.get()) is not None:
                s.paths.discard(path)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with one class row a key, where ``count`` is the number of rows that have the key. Keys of
    more than one row in HOT_SHARE, at most HOT_SHARE of them, are broadcast; so no key of the shuffled join is hot."""
    total = classes.agg(F.sum(count)).first()[0] or 0
    hot, cold = F.col(count) * HOT_SHARE > total, F.col(count) * HOT_SHARE <= total
    if classes.where(hot).limit(1).count() == 0:
        return rows.join(classes, key)
    few = F.broadcast(classes.where(hot))
    rest = rows.join(F.broadcast(classes.where(hot).select(key)), key, "left_anti").join(classes.where(cold).hint("merge"), key)
    return rows.join(few, key).unionByName(rest)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """The plain path behind a ``file:`` URI (a shared mount), or None for another store."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else None


# --------------------------------------------------------------------------------------------------------------
# words

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 19
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK, 1 << (n - 1).bit_length())
    if size not in _pow:
        out = []
        for b in (_BASE, _BASE_INV):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > _CHUNK:
            return out[0], out[1]
        _pow[size] = (out[0], out[1])
    return _pow[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash is usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _lut(punctuation_separates: bool) -> np.ndarray:
    """Byte -> lower-cased byte, 0 for a separator. Bytes of non-ASCII letters stay; NUL, where it is part of a token,
    becomes 255, which no UTF-8 text holds."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    t[65:91] += 32
    if punctuation_separates:
        for b in range(128):
            if not chr(b).isalnum():
                t[b] = 0
    else:
        t[[9, 10, 11, 12, 13, 32]] = 0
    return t


WORDS, TERMS, TOKENS = _lut(True), _lut(True), _lut(False)


def word_hashes(data: bytes, lut: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word. ``WORDS`` also lower-cases Latin-1 letters (two-byte UTF-8);
    ``TERMS`` does not."""
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):  # cut at a separator; a longer word makes a longer piece
            cut = np.flatnonzero(lut[raw[at:end]] == 0)
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                step = end
                while step < len(raw) and lut[raw[step]]:
                    step += 1
                end = step
        piece = lut[raw[at:end]]
        if lut is WORDS:
            up = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97)
            piece[1:][up] += 32
        inside = piece != 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            power, inverse = _powers(len(piece) + 1)
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece.astype(np.uint64) * power[: len(piece)], out=prefix[1:])
            h = (prefix[e] - prefix[s]) * inverse[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_groups(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a batch whose texts add up to about ``size`` bytes, texts as UTF-8 (null as empty)."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    begin, held, texts = 0, 0, []
    for i in range(len(col)):
        v = col[i].as_py() or b""
        texts.append(v)
        held += len(v)
        if held >= size:
            yield begin, i + 1, texts
            begin, held, texts = i + 1, 0, []
    if texts:
        yield begin, len(col), texts


def grouped_words(texts: list[bytes], lut: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry than texts)."""
    h, s = word_hashes(b"\n".join(texts), lut)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.concatenate([[0], np.searchsorted(s, ends)]).astype(np.int64)


_FACTORS = [np.uint64(x) for x in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5, 0x4B33A62ED433D4A3, 0x4D5A2DA51DE1AA47, 0xA0761D6478BD642F)]


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and their bounds. A text of 1 to k-1 words has one
    shingle, its whole word sequence; a text without words has none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    first = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = np.repeat(n < k, count)
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        w = padded[first + j]
        if short.any():
            w = np.where(short & (j >= np.repeat(n, count)), np.uint64(0), w)
        h += w * _FACTORS[j % len(_FACTORS)] + np.uint64(j)
    return mix(h), out_bounds


def segment_min(values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of each segment; ``empty`` where a segment has no values."""
    n = len(bounds) - 1
    out = np.full(n, empty, values.dtype)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --------------------------------------------------------------------------------------------------------------
# connected components

def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp): the smallest node of each connected component, from edges (a, b).

    Minimum labels travel along the edges and labels are shortcut (a node takes its label's label), so chains
    halve each round. Every round is a table in the shared folder, deleted after the next one; nothing is collected. A
    round makes one row for each end of an edge, and a node of any degree is summed up in part before its rows meet.
    """
    once = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialize(once.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))), f"{name}-edges")
    step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{name}-0")
    while True:
        labels = step.select("node", "comp")
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        done = materialize(hooked.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), f"{name}-step")
        release(step)
        step = done
        if not done.where("comp != old").limit(1).count():
            release(both)
            return done.select("node", "comp")
