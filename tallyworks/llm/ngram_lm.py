"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 is the vocabulary: the sorted 63-bit hashes of all training tokens, with exact counts. Level k holds the n-grams
of k tokens as one sorted list of keys ``context * V + word``, where ``context`` is the position of the first k-1 tokens
in level k-1. Each level lies in shard files, each an Elias-Fano list (packed low bits, unary high bits with a rank
directory) beside an array of 16-bit codes for the smoothed log10 probabilities. A second file of each shard holds, for
every node of the level below that begins there, its back-off code and, again in Elias-Fano form, the monotone pointer to
its first child. A query takes its context's pointer pair and searches its key's successor inside that range.

A level's counts go from the tasks that read texts straight to the task of their key range, which merges them and writes
the shard: no table of n-grams is written, sorted or shuffled again. Ranges hold about as many occurrences each, by the
counts of the level below, and are cut at contexts; a context of more than SHARD_KEYS occurrences is cut by words.

The files are memory-mapped from the shared folder, so a worker's memory holds only pages in use. Where that folder is
not a mounted file system they are fetched once by each worker process.

Probabilities: unigrams are (c + 0.1) / (N + 0.1 (V + 1)); n-grams, all of which are kept, get absolute discounting, and
the mass left goes to the lower order over the words not seen there (Katz back-off), so that every context's
probabilities add up to one. All counts are over all training documents.

Defined cases: a null or empty text is the end token alone; texts of any length are read whole; a row with a null id is
held out; repeated rows count twice; without any training row V and N are 0 and every token is unknown; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

ORDER, DISCOUNT = 3, 0.5
MIN_COUNT = 1  # of a kept n-gram: all of them are
SHARD_KEYS, LEAST_KEYS = 4_000_000, 250_000
FLUSH = 3_000_000
GROUP = 8 << 20  # bytes of text worked on at once: one visit of every shard
LOG_RANGE = 16.0
STEP = 1 << 18  # elements worked on at once while a shard is built
END = np.int64(0x2545F4914F6CDD1D)

# --------------------------------------------------------------------------------------------------------------
# Elias-Fano lists

_SEL8 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SEL8[_b, _r] = _p
_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_EIGHT, _BYTE = np.uint64(8), np.uint64(255)


def select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) one of each 64-bit word, all eight bytes counted at once."""
    s = w - (w >> np.uint64(1) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + (s >> np.uint64(2) & np.uint64(0x3333333333333333))
    s = (s + (s >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to and with each byte
    r = r.astype(np.uint64)
    k = np.minimum(np.bitwise_count((r * _ONES | _HIGH) - s & _HIGH), 7).astype(np.uint64) * _EIGHT
    byte, inside = w >> k & _BYTE, r - (s << _EIGHT >> k & _BYTE)
    return k.astype(np.int64) + _SEL8[byte, np.minimum(inside, np.uint64(7))]


class EliasFano:
    """A non-decreasing list of integers below 2**63. All reads take and give arrays."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.l, self.low, self.high, self.rank = int(n), int(low_bits), low, high, rank
        self._zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        words = ((int(v[-1] >> np.uint64(bits)) + n - 1 if n else 0) >> 6) + 2
        high, low = np.zeros(words, np.uint64), np.zeros((n * bits >> 6) + 2, np.uint64)
        for begin in range(0, n, STEP):
            part = v[begin : begin + STEP]
            i = np.arange(begin, begin + len(part), dtype=np.int64)
            up = (part >> np.uint64(bits)).astype(np.int64) + i
            np.bitwise_or.at(high, up >> 6, np.uint64(1) << (up & 63).astype(np.uint64))
            if bits:
                part, at = part & np.uint64((1 << bits) - 1), i * bits
                word, shift = at >> 6, (at & 63).astype(np.uint64)
                np.bitwise_or.at(low, word, part << shift)
                over = (shift.astype(np.int64) + bits) > 64
                np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        return cls(n, bits, low, high, rank)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.l], np.int64), "low": self.low, "high": self.high, "rank": self.rank}

    @classmethod
    def of(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        """The list of that name in a mapped file; its object stays with the file."""
        if name not in a:
            n, bits = a[f"{name}.meta"]
            a[name] = cls(n, bits, a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.rank"])
        return a[name]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        spill = (np.uint64(64) - shift) & np.uint64(63)
        out |= np.where(shift > 0, self.low[word + 1] << spill, np.uint64(0))
        return out & np.uint64((1 << self.l) - 1)

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the i-th (from 0) one or zero of the high bits."""
        if not ones and self._zeros is None:
            self._zeros = (np.arange(len(self.rank), dtype=np.int64) << 6) - self.rank
        before = self.rank if ones else self._zeros
        word = np.minimum(np.searchsorted(before, i, "right") - 1, len(self.high) - 1)
        w = self.high[word]
        return (word << 6) + select_in_word(w if ones else ~w, i - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)).astype(np.int64)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element >= x, whether it equals x); with lo, hi only elements [lo, hi) are searched."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = x >> self.l
        top = int(len(self.high) * 64 - self.rank[-1]) - 1  # zeros there are, less one
        inside = h < top
        hq = np.minimum(h, top - 1)
        a = np.where(hq > 0, self._select(np.maximum(hq - 1, 0), False) + 1 - hq, 0)
        b = self._select(hq, False) - hq
        a, b = np.minimum(a, self.n), np.minimum(b, self.n)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        want = (x & ((1 << self.l) - 1)).astype(np.uint64)
        left, right = a.copy(), np.maximum(a, b)
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self._low(mid) < want[live]
            left[live[less]] = mid[less] + 1
            right[live[~less]] = mid[~less]
            live = live[left[live] < right[live]]
        hit = (left < b) & inside
        hit[hit] = self._low(left[hit]) == want[hit]
        return np.where(inside, left, self.n), hit


# --------------------------------------------------------------------------------------------------------------
# shard files

def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays at 64-byte offsets. Written aside and renamed, so a repeated task leaves a whole file."""
    head, blob, at = [], io.BytesIO(), 0
    for k, v in arrays.items():
        v = np.ascontiguousarray(v)
        head.append(f"{k} {v.dtype.str} {len(v)} {at}")
        blob.write(v.tobytes())
        blob.write(bytes(-v.nbytes % 64))
        at += v.nbytes + -v.nbytes % 64
    text = "\n".join(head).encode()
    data = len(text).to_bytes(8, "little") + text + bytes(-(8 + len(text)) % 64) + blob.getvalue()
    path = c.local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{path}.{os.getpid()}"
        with open(aside, "wb") as f:
            f.write(data)
        os.replace(aside, path)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(inner) as f:
            f.write(data)


@lru_cache(maxsize=16384)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    path = c.local_path(uri)
    if not path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        path = tempfile.mkstemp(suffix=".ef")[1]
        with store.open_input_stream(inner) as f, open(path, "wb") as g:
            g.write(f.read())
        m = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the mapping keeps the file until the worker ends
    else:
        m = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(m[:8].tobytes(), "little")
    base = 8 + n + -(8 + n) % 64
    out = {}
    for line in m[8 : 8 + n].tobytes().decode().split("\n"):
        k, dtype, size, at = line.split(" ")
        width = np.dtype(dtype).itemsize
        out[k] = m[base + int(at) : base + int(at) + int(size) * width].view(dtype)
    return out


class Sharded:
    """A list cut into shard files by value. manifest: (path, least value, count) in order. All reads take sorted arrays,
    so that they walk through the files."""

    def __init__(self, manifest: list[tuple[str, int, int]]):
        self.manifest = manifest
        self.first = np.array([m[1] for m in manifest], np.int64)
        self.base = np.concatenate([[0], np.cumsum([m[2] for m in manifest])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.base[-1])

    def pieces(self, edges: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, slice, dict[str, np.ndarray]]]:
        """Slices of the sorted ``x`` by shard, with the shard's arrays."""
        cuts = np.concatenate([[0], np.searchsorted(x, edges[1:]), [len(x)]])
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]) if len(self.manifest) else ():
            yield int(s), slice(int(cuts[s]), int(cuts[s + 1])), map_arrays(self.manifest[s][0])

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Global index of each value, -1 where it is missing."""
        out = np.full(len(x), -1, np.int64)
        for s, at, a in self.pieces(self.first, x):
            ef = EliasFano.of(a, "keys")
            bounds = (None, None) if lo is None else (np.clip(lo[at] - self.base[s], 0, ef.n), np.clip(hi[at] - self.base[s], 0, ef.n))
            i, hit = ef.successor(x[at], *bounds)
            out[at] = np.where(hit, i + self.base[s], -1)
        return out

    def take(self, i: np.ndarray, name: str) -> np.ndarray:
        """Entries of a named column at global indexes."""
        out = np.zeros(len(i), np.int64)
        for s, at, a in self.pieces(self.base[:-1], i):
            out[at] = a[name][i[at] - self.base[s]]
        return out


def code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * (65535 / LOG_RANGE)), 0, 65535).astype(np.uint16)


def decode(codes: np.ndarray) -> np.ndarray:
    return codes * (-LOG_RANGE / 65535)


class Level:
    """The n-grams of one length. ``contexts`` lists every node of the level below, ``begins`` is the global index of the
    first key in each of its shards. ``hot`` are the contexts cut into several shards: (node, back-off, children)."""

    def __init__(self, keys: Sharded, contexts: Sharded, begins: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.keys, self.contexts, self.begins, self.hot = keys, contexts, begins, hot

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Back-off and child range of sorted nodes of the level below."""
        bow, lo, hi = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for s, at, a in self.contexts.pieces(self.contexts.base[:-1], nodes):
            j, first = nodes[at] - self.contexts.base[s], EliasFano.of(a, "first")
            lo[at], hi[at] = first.get(j) + self.begins[s], first.get(j + 1) + self.begins[s]
            bow[at] = decode(a["bow"][j]) + 6
        ids, weights, counts = self.hot
        if len(ids):
            i = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
            at = np.flatnonzero(ids[i] == nodes)
            bow[at], hi[at] = weights[i[at]], lo[at] + counts[i[at]]
        bow[hi == lo] = 0
        return bow, lo, hi


class Trie:
    def __init__(self, vocabulary: Sharded, total: int, levels: list[Level]):
        self.words, self.total, self.levels = vocabulary, total, levels

    @property
    def denominator(self) -> float:
        return self.total + 0.1 * (len(self.words) + 1)

    def unigram(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, count) of word ids, -1 for unknown words."""
        order = np.argsort(ids, kind="stable")
        order = order[np.searchsorted(ids, 0, sorter=order) :]
        count = np.zeros(len(ids), np.int64)
        count[order] = self.words.take(ids[order], "count")
        return np.log10((count + 0.1) / self.denominator), count

    def start(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct tokens' ids, which of them each token is, each token's id, the id before it), -1 for unknown ones."""
        unique, of = np.unique(hashes, return_inverse=True)
        ids_u = self.words.find(unique)
        ids = ids_u[of]
        before = np.concatenate([[-1], ids[:-1]])
        before[first] = self.words.find(np.array([END]))[0]
        return ids_u, of, ids, before

    def step(self, level: int, nodes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each (context node, word): its index in ``level`` or -1, its code, and the context's back-off where it was
        not seen. Each distinct pair is looked up once."""
        child, codes, bow = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.uint16), np.zeros(len(nodes))
        at, wide, here = np.flatnonzero(nodes >= 0), len(self.words) + 1, self.levels[level - 2]
        if not len(at):
            return child, codes, bow
        pairs, of = np.unique(nodes[at] * wide + ids[at] + 1, return_inverse=True)
        node = pairs // wide
        word = pairs - node * wide - 1
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        b, lo, hi = (np.repeat(x, np.diff(np.append(starts, len(node)))) for x in here.children(node[starts]))
        known, found = np.flatnonzero((hi > lo) & (word >= 0)), np.full(len(pairs), -1, np.int64)
        found[known] = here.keys.find(node[known] * len(self.words) + word[known], lo[known], hi[known])
        hit, c_u = np.flatnonzero(found >= 0), np.zeros(len(pairs), np.uint16)
        c_u[hit] = here.keys.take(found[hit], "p")
        child[at], codes[at], bow[at] = found[of], c_u[of], b[of]
        return child, codes, bow

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, base log10, model log10) of each token; ``first`` marks the first token of each text."""
        ids_u, of, ids, nodes = self.start(hashes, first)
        uni_u, count_u = self.unigram(ids_u)
        base, age = uni_u[of], _age(first)
        p = base
        for level in range(2, len(self.levels) + 2):
            child, codes, bow = self.step(level, nodes, ids)
            p = np.where(child >= 0, decode(codes), p + bow)
            nodes = _next(child, age, level)
        return count_u[of], base, p


def _next(child: np.ndarray, age: np.ndarray, level: int) -> np.ndarray:
    """Context nodes for the level after ``level``: the n-gram that ended one token before, inside the text."""
    nodes = np.concatenate([[-1], child[:-1]])
    nodes[age < level - 1] = -1
    return nodes


def _age(first: np.ndarray) -> np.ndarray:
    """Position of each token in its text."""
    begins = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(begins, np.diff(np.append(begins, len(first))))


# --------------------------------------------------------------------------------------------------------------
# counting and building

def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit token hashes of all texts, each text closed by END, and the marks of first tokens."""
    h, b = c.grouped_words(texts, c.TOKENS)
    n = np.diff(b)
    out = np.full(len(h) + len(texts), END, np.int64)
    ends = b[1:] + np.arange(len(texts))
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = (h >> np.uint64(1)).astype(np.int64)
    first = np.zeros(len(out), bool)
    first[ends - n] = True
    return out, first


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and their codes, which are the same wherever a key is."""
    keys, counts, codes = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts), codes[order[starts]]


PART = "part int, keys binary, counts binary, codes binary"
MANIFEST = "part int, path string, contexts string, n bigint, total bigint, ends array<bigint>, sums array<bigint>, large array<bigint>, large_n array<bigint>, hot array<bigint>, children array<bigint>, spent array<double>, below array<double>"


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, the lowest first: what the shuffle compresses is then mostly zeros."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes, dtype: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _deal(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Sorted keys, as differences, with counts and codes as one row for each key range: few large rows are far cheaper
    to shuffle than many."""
    cuts = np.concatenate([[0], np.searchsorted(keys, edges[1:]), [len(keys)]])
    parts = np.flatnonzero(cuts[1:] > cuts[:-1])
    blob = lambda x: pa.array([pack(x(cuts[i], cuts[i + 1])) for i in parts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), blob(lambda i, j: np.diff(keys[i:j], prepend=0)), blob(lambda i, j: counts[i:j]), blob(lambda i, j: codes[i:j])], names=["part", "keys", "counts", "codes"])


def _count(batches: Iterator[pa.RecordBatch], trie: Trie | None, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of the level above ``trie`` in this task, with the codes of the n-grams less their first token
    where that is more than a word; merged before they leave, at most FLUSH keys being held."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        for _, _, texts in c.text_groups(batch, size=GROUP):
            h, first = tokens(texts)
            codes = np.zeros(len(h), np.uint16)
            if trie is not None:
                _, _, ids, nodes = trie.start(h, first)
                for level in range(2, len(trie.levels) + 2):
                    child, codes, _ = trie.step(level, nodes, ids)
                    nodes = _next(child, _age(first), level)
                ok = np.flatnonzero((nodes >= 0) & (ids >= 0))
                h, codes = nodes[ok] * len(trie.words) + ids[ok], codes[ok]
            if not len(h):
                continue
            held.append(_merge([(h, np.ones(len(h), np.int64), codes)]))
            n += len(held[-1][0])
            if n > FLUSH:
                held = [_merge(held)]
                n = len(held[0][0])
                if n > FLUSH // 2:
                    yield _deal(*held[0], edges)
                    held, n = [], 0
    if held:
        yield _deal(*_merge(held), edges)


def _arrived(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What was counted for this task's key range."""
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))]
    part = _partition()
    for batch in batches:
        for p, keys, counts, codes in zip(*(batch.column(k) for k in range(4))):
            if p.as_py() != part:
                raise RuntimeError(f"counts of part {p} in partition {part}")
            got.append((np.cumsum(unpack(keys.as_py())), unpack(counts.as_py()), unpack(codes.as_py(), np.uint16)))
    return _merge(got) if len(got) > 1 else got[0]


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _parts(spark, total: int) -> int:
    """How many shards: of about SHARD_KEYS occurrences at most, and fewer where the cores would lie idle."""
    return max(-(-total // SHARD_KEYS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_KEYS)), 1)


def _row(part: int, path: str, contexts: str | None, counts: np.ndarray, grain: int, most: int, *hot: np.ndarray) -> pa.RecordBatch:
    """A shard's line in the manifest: where its nodes have reached each multiple of ``grain`` occurrences, the nodes of
    more than ``most``, and its share of the contexts that several shards share."""
    sums = np.cumsum(counts)
    ends = np.flatnonzero(np.diff(sums // grain, append=-1))
    large = np.flatnonzero(counts > most)
    lists = [ends + 1, sums[ends], large, counts[large], *(hot or (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2)]
    n, total = len(counts), int(sums[-1]) if len(sums) else 0
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([contexts], pa.string()), pa.array([n]), pa.array([total]), *(pa.array([x.tolist()], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in lists)], names=names)


def _edges(rows: list, v: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least key of each part of the next level, contexts that are cut, their occurrences) from the manifest of this one.
    Parts begin at contexts and hold about as many occurrences each; a context of more than SHARD_KEYS is cut by words."""
    base = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum([r["total"] for r in rows])]).astype(np.int64)
    joined = lambda name, offset: np.concatenate([np.zeros(0, np.int64), *(np.array(r[name], np.int64) + o for r, o in zip(rows, offset))])
    ends, sums = joined("ends", base), joined("sums", before)
    large, large_n = joined("large", base), joined("large_n", np.zeros(len(rows), np.int64))
    cuts = ends[np.searchsorted(sums, before[-1] * np.arange(1, parts) // parts)] if len(ends) else ends
    inside = [x * v + v * np.arange(k + 1) // k for x, k in zip(large, -(-large_n // SHARD_KEYS))]
    edges = np.unique(np.concatenate([[0], cuts * v, *inside]).astype(np.int64))
    return edges[(edges == 0) | (edges < base[-1] * v)], large, large_n


def build_trie(docs: DataFrame, order: int = ORDER, name: str = "ngram") -> Trie:
    """Count all texts of ``docs`` and write the trie's levels to the shared folder."""
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    root, texts = c.shared_path(spark, name), docs.select("text")
    grain, most = max(1, min(SHARD_KEYS, LEAST_KEYS) // 2), SHARD_KEYS

    def made(trie: Trie | None, edges: np.ndarray, shard) -> list:
        counted = texts.mapInArrow(lambda b: _count(b, trie, edges), PART).repartitionById(len(edges), F.col("part"))
        return sorted(counted.mapInArrow(shard, MANIFEST).collect(), key=lambda r: r["part"])  # one row a shard

    def vocabulary(batches):
        part = _partition()
        if part < len(edges):
            keys, counts, _ = _arrived(batches)
            path = f"{root}/words-{part}.ef"
            width = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
            write_arrays(path, {**{f"keys.{k}": x for k, x in EliasFano.build(keys).arrays().items()}, "count": counts.astype(width)})
            yield _row(part, path, None, counts, grain, most)

    size = texts.agg(F.sum(F.octet_length("text") / 4 + 1)).first()[0]  # words are no more than half of the bytes, and hashes spread them evenly
    parts = _parts(spark, int(size or 0))
    edges = np.array([(i << 63) // parts for i in range(parts)], np.int64)
    rows = made(None, edges, vocabulary)
    trie = Trie(Sharded([(r["path"], int(edges[r["part"]]), r["n"]) for r in rows]), sum(r["total"] for r in rows), [])
    for level in range(2, order + 1):
        lower = Trie(trie.words, trie.total, list(trie.levels))
        edges, large, large_n = _edges(rows, max(1, len(lower.words)), _parts(spark, trie.total))
        ends = np.append(edges[1:], sum(r["n"] for r in rows) * max(1, len(lower.words)))
        rows = made(lower, edges, _Shard(lower, level, root, edges, ends, large, large_n, grain, most))
        trie.levels.append(_level(rows, edges, ends, max(1, len(lower.words))))
    return trie


class _Shard:
    """The task of one key range: counts in, files of a level's n-grams and of their contexts out, one manifest row."""

    def __init__(self, lower: Trie, level: int, root: str, edges: np.ndarray, ends: np.ndarray, large: np.ndarray, large_n: np.ndarray, grain: int, most: int):
        self.lower, self.level, self.root, self.edges, self.ends, self.large, self.large_n, self.grain, self.most = lower, level, root, edges, ends, large, large_n, grain, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _partition()
        if part >= len(self.edges):
            return
        v = max(1, len(self.lower.words))
        begin, end = (-(-int(x[part]) // v) for x in (self.edges, self.ends))  # nodes whose children begin here
        keys, counts, codes = _arrived(batches)
        ctx = keys // v
        below = 10 ** (self.lower.unigram(keys - ctx * v)[0] if self.level == 2 else decode(codes))
        starts = np.flatnonzero(np.diff(ctx, prepend=-1))
        node, children = ctx[starts], np.diff(np.append(starts, len(ctx)))
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        # every occurrence of a context but the end of a text has one word after it
        of, shared = total(counts), np.isin(node, self.large)
        of[shared] = self.large_n[np.searchsorted(self.large, node[shared])]
        p = (counts - DISCOUNT) / np.repeat(of, children)
        spent, below = total(p), total(below)
        own = node >= begin
        size, bow = np.zeros(end - begin, np.int64), np.zeros(end - begin, np.uint16)
        size[node[own] - begin], bow[node[own] - begin] = children[own], back_off(spent[own], below[own])
        first = np.concatenate([[0], np.cumsum(size)]) + children[~own].sum()
        path, contexts = f"{self.root}/level{self.level}-{part}.ef", f"{self.root}/contexts{self.level}-{part}.ef"
        write_arrays(path, {**{f"keys.{k}": x for k, x in EliasFano.build(keys).arrays().items()}, "p": code(np.log10(p))})
        write_arrays(contexts, {**{f"first.{k}": x for k, x in EliasFano.build(first).arrays().items()}, "bow": bow})
        yield _row(part, path, contexts, counts, self.grain, self.most, node[shared], children[shared], spent[shared], below[shared])


def back_off(spent: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Codes of the back-off weights of contexts that have spent so much here and so much in the lower order."""
    return code(np.minimum(np.log10(np.maximum(1 - spent, 1e-9) / np.maximum(1 - below, 1e-9)), 6) - 6)


def _level(rows: list, edges: np.ndarray, ends: np.ndarray, v: int) -> Level:
    keys = Sharded([(r["path"], int(edges[r["part"]]), r["n"]) for r in rows])
    nodes = [(-(-int(edges[r["part"]]) // v), -(-int(ends[r["part"]]) // v)) for r in rows]
    some = [i for i, (a, b) in enumerate(nodes) if a < b]
    contexts = Sharded([(rows[i]["contexts"], nodes[i][0], nodes[i][1] - nodes[i][0]) for i in some])
    of, children, spent, below = (np.concatenate([np.zeros(0, t), *(np.array(r[k], t) for r in rows)]) for k, t in (("hot", np.int64), ("children", np.int64), ("spent", float), ("below", float)))
    hot, at = np.unique(of, return_inverse=True)
    sums = lambda x: np.bincount(at, x, len(hot))
    weights = decode(back_off(sums(spent), sums(below))) + 6
    return Level(keys, contexts, keys.base[some], (hot, weights, sums(children).astype(np.int64)))


def held_out(folds: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def _score(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in c.text_groups(batch, size=GROUP):
            h, first = tokens(texts)
            count, base, p = trie.score(h, first)
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(h)))
            size = end - begin
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, size), batch.column(2).slice(begin, size), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(size, trie.total)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(p, at))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    trie = build_trie(docs.where(~F.col("held_out")), order)
    return docs.mapInArrow(lambda b: _score(b, trie), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
