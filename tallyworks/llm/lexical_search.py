"""Ranked lexical search with block-max pruning.

One native pass counts the documents N and terms L. A second pass makes the index: blocks of up to BLOCK_DOCS documents
that follow one another, each with its forward index (terms and impacts of every document, an impact being the part of
the score that no query changes) and, for every term, the largest impact in the block and the number of its documents.
The index is a table in the shared folder; it holds the terms of the items (or, where these are more than VOCABULARY,
all terms), named by 64-bit hashes.

A query's bound for a block is the sum of its weights times the block's largest impacts: no document of the block
scores more. Each task sorts its blocks by an item's bound and scores their forward index from the top, until the bound
is below the item's threshold, the 20th best score known; blocks that reach it exactly are scored too, as equal scores
rank by id. A first round scores each task's best block for every item, which gives a threshold over the whole corpus;
the second round starts with it.

Items are read in slices of at most SLICE_BYTES, one after the other, so a benchmark of any size passes through bounded
memory; a task returns at most 20 rows an item and slice.

Defined cases: a null or empty text has no terms: such a document counts nowhere, such an item has no rows; texts of any
length are read whole; each row is a document of its own, so repeated rows rank one after the other; a document without
an id counts and ranks after equal scores; repeated items are one, and an id with several texts is several items; extra
columns are ignored; an empty table of documents or items gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

TOP = 20
BLOCK_DOCS, BLOCK_ENTRIES = 64, 1 << 15
VOCABULARY = 1 << 22
SLICE_BYTES = 32 << 20
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_NO_ID = (1 << 63) - 1
_ROWS = 256  # blocks that are sorted together

INDEX = "ids binary, starts binary, entries binary, impacts binary, terms array<bigint>, largest array<bigint>, df array<bigint>"
_INDEX = pa.schema([*[(x, pa.binary()) for x in ("ids", "starts", "entries", "impacts")], *[(x, pa.list_(pa.int64())) for x in ("terms", "largest", "df")]])
HITS = "item bigint, doc_id bigint, score bigint"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    r = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _block(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, imp: np.ndarray) -> tuple:
    """Columns of a block; entries are in document order."""
    terms, local = np.unique(term, return_inverse=True)
    largest = np.zeros(len(terms), np.int64)
    np.maximum.at(largest, local, imp)
    docs, starts = np.unique(doc, return_index=True)
    return (ids[docs].tobytes(), starts.astype(np.int32).tobytes(), local.astype(np.int32).tobytes(), imp.astype(np.int32).tobytes(), terms.view(np.int64), largest, np.bincount(local, minlength=len(terms)))


def _build(batches: Iterator[pa.RecordBatch], size: tuple[int, int], vocabulary: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_ids = batch.column(0).fill_null(_NO_ID).to_numpy()
        for begin, end, texts in c.text_groups(batch):
            ids = all_ids[begin:end]
            h, bounds = c.grouped_words(texts, c.TERMS)
            m = np.array([75 + 25 * n * size[0] // max(size[1], 1) for n in np.diff(bounds).tolist()], np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            if vocabulary is not None:
                keep = _known(vocabulary, h)[1]
                h, doc = h[keep], doc[keep]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.concatenate([first, [len(h)]]))
            h, doc = h[first], doc[first]
            imp = impact(tf, m[doc])
            rows, at, upto = [], 0, np.searchsorted(doc, np.arange(len(texts) + 1))
            while at < len(texts):  # up to so many documents and entries, one document at least
                stop = max(at + 1, min(at + BLOCK_DOCS, int(np.searchsorted(upto, upto[at] + BLOCK_ENTRIES, "right")) - 1, len(texts)))
                a, b = upto[at], upto[stop]
                if b > a:
                    rows.append(_block(ids, doc[a:b], h[a:b], imp[a:b]))
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 7, _INDEX.types)], schema=_INDEX)


def _known(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of x among sorted values, and which are there."""
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, (sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) of the items."""
    for batch in batches:
        for begin, _, texts in c.text_groups(batch):
            h, bounds = c.grouped_words(texts, c.TERMS)
            for i in range(len(texts)):
                term, times = np.unique(h[bounds[i] : bounds[i + 1]], return_counts=True)
                item = np.full(len(term), batch.column(0)[begin + i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], names=["item", "term", "times"])


class Queries:
    """A slice of the items: for each one its terms, in the order of their hashes, and their weights."""

    def __init__(self, rows: list[tuple[int, list[int], list[int]]]):
        self.items = np.array([r[0] for r in rows], np.int64)
        sizes = [len(r[1]) for r in rows]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        terms = np.array([t for r in rows for t in r[1]], np.int64).view(np.uint64)
        self.terms, self.at = np.unique(terms, return_inverse=True)
        self.weights = np.array([w for r in rows for w in r[2]], np.int64)

    def bounds(self, terms: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """The most that a document of a block can score, for each item."""
        at, known = _known(self.terms, terms)
        most = np.zeros(len(self.terms), np.int64)
        most[at[known]] = largest[known]
        return np.add.reduceat(most[self.at] * self.weights, self.starts[:-1])

    def scores(self, item: int, terms: np.ndarray, starts: np.ndarray, entries: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        part = slice(self.starts[item], self.starts[item + 1])
        at, known = _known(terms, self.terms[self.at[part]])
        weight = np.zeros(len(terms), np.int64)
        weight[at[known]] = self.weights[part][known]
        return np.add.reduceat(weight[entries] * impacts, starts)


class Ranking:
    """The best rows of each item so far. ``least`` is a score that the final ranking is known to need."""

    def __init__(self, queries: Queries, least: np.ndarray, top: int):
        self.q, self.least, self.top = queries, least.copy(), top
        self.ids = [np.zeros(0, np.int64) for _ in queries.items]
        self.score = [np.zeros(0, np.int64) for _ in queries.items]
        self.scored = self.met = 0

    def add(self, item: int, ids: np.ndarray, score: np.ndarray) -> None:
        ok = score >= max(self.least[item], 1)
        if not ok.any():
            return
        ids, score = np.concatenate([self.ids[item], ids[ok]]), np.concatenate([self.score[item], score[ok]])
        best = np.lexsort((ids, -score))[: self.top]
        self.ids[item], self.score[item] = ids[best], score[best]
        if len(best) == self.top:
            self.least[item] = max(self.least[item], score[best[-1]])

    def visit(self, blocks: list[tuple], upto: int | None) -> None:
        """Blocks (ids, starts, entries, impacts, terms, largest), by each item's bound, until it is too low."""
        bounds = np.stack([self.q.bounds(b[4], b[5]) for b in blocks], axis=1)
        self.met += bounds.size
        for item in range(len(self.q.items)):
            for b in np.argsort(-bounds[item], kind="stable")[:upto].tolist():
                if bounds[item, b] < max(self.least[item], 1):
                    break
                ids, starts, entries, impacts, terms, _ = blocks[b]
                self.scored += 1
                self.add(item, ids, self.q.scores(item, terms, starts, entries, impacts))

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(self.q.items, [len(x) for x in self.ids])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.score, np.zeros(0, np.int64)]))], names=["item", "doc_id", "score"])


def _opened(batch: pa.RecordBatch) -> list[tuple]:
    types, out = (np.int64, np.int32, np.int32, np.int32), []
    for r in range(batch.num_rows):
        ids, starts, entries, impacts = (np.frombuffer(batch.column(k)[r].as_py(), t) for k, t in enumerate(types))
        out.append((ids, starts, entries, impacts.astype(np.int64), *(batch.column(k)[r].values.to_numpy() for k in (4, 5))))
    return [(*b[:4], b[4].view(np.uint64), b[5]) for b in out]


def _rank(batches: Iterator[pa.RecordBatch], queries: Queries, least: np.ndarray, top: int, upto: int | None) -> Iterator[pa.RecordBatch]:
    ranking = Ranking(queries, least, top)
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            ranking.visit(_opened(batch.slice(a, _ROWS)), upto)
    yield ranking.rows()


def build_index(docs: DataFrame, size: tuple[int, int], vocabulary: np.ndarray | None) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    return c.materialize(docs.mapInArrow(lambda b: _build(b, size, held.value if held is not None else None), INDEX), "lex-index")


def weighted_terms(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """item, terms, weights (times repeats) of the items' terms that some document has."""
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    x = asked.join(df, "term").select("item", F.struct("term", (weight * F.col("times")).alias("weight")).alias("x"))
    x = x.groupBy("item").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the terms of one item
    return x.select("item", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary: int = VOCABULARY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of every item."""
    size = corpus_size(docs)
    items = c.materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "lex-items")
    asked = c.materialize(items.select("item", "text").mapInArrow(_hashes, "item bigint, term bigint, times bigint"), "lex-asked")
    terms = asked.select("term").distinct()
    few = terms.count() <= vocabulary  # 32 MB at most
    index = build_index(docs, size, np.unique(np.array([r[0] for r in terms.collect()], np.int64).view(np.uint64)) if few else None)
    wanted = c.materialize(weighted_terms(index, asked, size[0]), "lex-wanted")
    held = wanted.agg(F.sum(F.size("terms") * 16 + 64)).first()[0] or 0
    best, passes = None, -(-held // slice_bytes)
    for p in range(passes):
        queries = Queries([tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect()])
        if not len(queries.items):
            continue
        least, order = np.zeros(len(queries.items), np.int64), {x: i for i, x in enumerate(queries.items.tolist())}
        for upto in (1, None):
            found = index.mapInArrow(lambda b, q=queries, t=least, u=upto: _rank(b, q, t, top, u), HITS)
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
            if upto:
                least = least.copy()
                for item, score in found.where(F.col("rank") == top).select("item", "score").collect():
                    least[order[item]] = score
        found = c.materialize(found, "lex-found")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")
