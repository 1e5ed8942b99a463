"""Token counts by section, with whole documents encoded once.

A document is tokenised as one string, so tokens are those that training sees. The byte spans of the tokens follow from
the lengths of their byte strings; sections are byte spans too (by default one per line, its newline included), and an
interval join of the two sorted lists gives each token its section. A token that crosses a boundary belongs

* ``majority`` (default): to the section that holds most of its bytes, the earlier one on a tie;
* ``first``: to the section that holds its first byte.

Either way every token is counted once, so the counts of a document's sections add up to its tokens.

Defined cases: a null or empty text has one section, 0..0, with no tokens; texts of any length are encoded whole; repeated
rows give repeated results; null ids are carried through; extra columns are ignored; an empty table gives an empty
result. A section of which no byte starts or dominates a token has 0 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for k, v in ranks.items():
        lengths[v] = len(k)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines, each with its newline."""
    cuts = np.flatnonzero(raw == 10) + 1
    return np.unique(np.concatenate([[0], cuts, [len(raw)]]))


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary. Token i spans [sum(lengths[:i]), sum(lengths[:i+1]))."""
    end = np.cumsum(lengths)
    begin = end - lengths
    first, last = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(bounds, end, "left") - 1
    cross = last > first
    if rule == "first":
        return first, cross
    if rule != "majority":
        raise ValueError(f"no such rule: {rule}")
    section = first.copy()
    for i in np.flatnonzero(cross):
        cuts = np.concatenate([[begin[i]], bounds[first[i] + 1 : last[i] + 1], [end[i]]])
        section[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return section, cross


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, rule: str) -> Iterator[pa.RecordBatch]:
    enc, size = encoder(path, pattern)
    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text"))
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(ids, texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            bounds = line_sections(raw)
            if len(bounds) < 2:
                n, counts, crossing, chars = 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64)
            else:
                section, cross = attribute(size[np.array(enc.encode_ordinary(text), np.int64)], bounds, rule)
                n = len(bounds) - 1
                counts, crossing = np.bincount(section, minlength=n), np.bincount(section[cross], minlength=n)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
            for col, v in zip(out, ([doc_id] * n, range(n), chars[:-1], chars[1:], counts, crossing)):
                col.extend(v if isinstance(v, (list, range)) else v.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _ARROW.types)], schema=_ARROW)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "majority") -> DataFrame:
    """One row per document and section: doc_id, section, char_start, char_end, n_tokens, n_crossing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda b: _count(b, vocabulary, pattern, rule), OUT)
