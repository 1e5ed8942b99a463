"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of five-word shingles, powers of two). For each size class the documents are cut
into overlapping windows no longer than the class's items, and windows and items are MinHashed: a window that lies in a
copied passage has an item's minimum in a band with a probability of at least the share of the item's shingles that the
window holds and no foreign shingle undercuts: the containment, for a passage copied in one piece, so that with BANDS
single-value bands it escapes with 0.2**12 < 5e-9; edits add foreign shingles, and of 100 words with every tenth
changed a band still finds half (measured in the tests). Candidates are verified by exact shingle
containment: at least 0.8 of the item's distinct shingles occur in the document.

Items of one to four words are classes of their own: they are looked up exactly among the document's runs of as many
words, so a short item inside a longer document is found as well.

The documents make one pass over the items. Items are read in slices of at most SLICE_BYTES (their size is measured
first), one pass for each slice; the matches of a pass are written before the next slice is read, so driver and tasks
hold one slice at a time, of a benchmark of any size.

Defined cases: a null or empty text has no shingles and matches nothing, and neither does such an item; texts of any
length are read whole; repeated items or documents give repeated rows; null ids are carried through; extra columns are
ignored; an empty table of documents or items gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BANDS = 12
BLOCK = 4
SLICE_BYTES = 32 << 20
OUT = "doc_id bigint, item_id bigint, shared int, item_shingles int, containment double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int32()), ("item_shingles", pa.int32()), ("containment", pa.float64())])
_MULT = c.odd_multipliers(BANDS, 6)


class ItemIndex:
    """Items by size class: for each band a filter of the low bits of the minima, and the sorted minima with their items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        words, bounds = c.grouped_words([(r[1] or "").encode() for r in rows]) if rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        sh, sb = c.shingles(words, bounds)
        self.sets = [np.unique(sh[sb[i] : sb[i + 1]]) for i in range(len(rows))]
        length = np.diff(bounds)
        self.short = []  # (words, sorted hashes, items)
        for k in range(1, c.SHINGLE):
            items = np.flatnonzero(length == k)
            if len(items):
                runs = sh[sb[items]]
                order = np.argsort(runs, kind="stable")
                self.short.append((k, runs[order], items[order]))
        by: dict[int, list[int]] = {}
        for i in np.flatnonzero(length >= c.SHINGLE).tolist():
            n = len(self.sets[i])
            by.setdefault(1 if n < 2 * BLOCK else 1 << (n.bit_length() - 1), []).append(i)
        self.classes = []
        for width, items in sorted(by.items()):
            mask = np.uint64((1 << min(20, max(8, (16 * len(items)).bit_length()))) - 1)
            bands = []
            for m in _MULT:
                low = np.array([(self.sets[i] * m).min() for i in items], np.uint64)
                order = np.argsort(low, kind="stable")
                filt = np.zeros(int(mask) + 1, bool)
                filt[(low & mask).astype(np.int64)] = True
                bands.append((mask, filt, low[order], np.array(items)[order]))
            self.classes.append((width, bands))

    @staticmethod
    def _lookup(values: np.ndarray, low: np.ndarray, items: np.ndarray, owner: np.ndarray, out: set[tuple[int, int]]) -> None:
        lo, hi = np.searchsorted(low, values, "left"), np.searchsorted(low, values, "right")
        for k in np.flatnonzero(hi > lo):
            out.update((int(owner[k]), int(i)) for i in items[lo[k] : hi[k]])

    def candidates(self, sh: np.ndarray, sb: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs whose windows share a band value."""
        counts = np.diff(sb)
        blocks = -(-counts // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(sb[:-1] - first[:-1] * BLOCK, blocks) + np.arange(first[-1]) * BLOCK
        of_shingle, of_block = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), blocks)
        out: set[tuple[int, int]] = set()
        for b, m in enumerate(_MULT):
            values = sh * m
            base, width = None, BLOCK
            for size, bands in self.classes:
                mask, filt, low, items = bands[b]
                if size == 1:
                    mins, owner = values, of_shingle
                else:
                    if base is None:
                        base = np.minimum.reduceat(values, starts)
                    while width < size:  # windows of twice the length
                        step = width // BLOCK
                        if len(base) > step:
                            base = np.concatenate([np.minimum(base[:-step], base[step:]), base[-step:]])
                        width *= 2
                    mins, owner = base, of_block
                at = np.flatnonzero(filt[(mins & mask).astype(np.int64)])
                self._lookup(mins[at], low, items, owner[at], out)
        return out

    def runs(self, words: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of the items shorter than a shingle."""
        out: set[tuple[int, int]] = set()
        for k, known, items in self.short:
            at = np.arange(len(words) - k + 1)
            at = at[at + k <= np.repeat(bounds[1:], np.diff(bounds))[: len(at)]]  # inside one text
            if not len(at):
                continue
            # the hash that ``shingles`` gives a text of these words alone
            rows = np.stack([words[at + j] for j in range(k)], axis=1).ravel()
            h, _ = c.shingles(rows, np.arange(len(at) + 1) * k)
            hit = np.flatnonzero(np.isin(h, known))
            self._lookup(h[hit], known, items, np.searchsorted(bounds, at[hit], "right") - 1, out)
        return out

    def matches(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
        """(row of the batch, item, shared shingles, item shingles) of the verified candidates."""
        for begin, _, texts in c.text_groups(batch):
            words, bounds = c.grouped_words(texts)
            sh, sb = c.shingles(words, bounds)
            if not len(sh):
                continue
            for d, i in sorted(self.runs(words, bounds)):
                yield begin + d, i, 1, 1
            held = (-1, np.zeros(0, np.uint64))
            for d, i in sorted(self.candidates(sh, sb)):
                if held[0] != d:
                    held = (d, np.unique(sh[sb[d] : sb[d + 1]]))
                n, q = int(np.isin(self.sets[i], held[1]).sum()), len(self.sets[i])
                if n * c.SIMILARITY[1] >= q * c.SIMILARITY[0]:
                    yield begin + d, i, n, q


def _scan(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        rows = [(ids[d].as_py(), index.ids[i], n, q, n / q) for d, i, n, q in index.matches(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, _ARROW.types)], schema=_ARROW)


def _slices(items: DataFrame, slice_bytes: int) -> Iterator[tuple[ItemIndex, bool]]:
    """The index of each slice of the items, and whether it is the only one."""
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    passes = max(1, -(-size // slice_bytes))
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        yield ItemIndex([(r[0], r[1]) for r in part.collect()]), passes == 1


def find_benchmark(docs: DataFrame, items: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every item contained in a document."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index, only in _slices(items, slice_bytes):
        found = docs.mapInArrow(lambda b, index=index: _scan(b, index), OUT)
        found = found if only else c.materialize(found, "decon-found")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, judged row by row in the same scan."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    kept = docs
    for index, only in _slices(items, slice_bytes):
        clean = kept.mapInArrow(lambda b, index=index: _clean(b, index), docs.schema)
        if only:
            return clean
        clean = c.materialize(clean, "decon-kept")
        c.release(kept)
        kept = clean
    return kept


def _clean(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for d, *_ in index.matches(batch):
            keep[d] = False
        yield batch.filter(pa.array(keep))
