"""SimHash near duplicates by a self-join of binary tries.

A text's words (A-Z lower-cased) give three-word shingles, repeats included; a fingerprint bit is set where over half of
the shingles' XXH64 values have it. Equal fingerprints are made one first, with their smallest id, so copies cost one
row a task. Two fingerprints link at BUDGET or fewer differing bits.

The join walks pairs of trie nodes from the top, adds up the bits in which their paths differ, and drops a pair as soon
as the sum is above the budget. Of at most three differing bits one half of the 64 has at most one, so there are two
tries, one over the fingerprints and one over the fingerprints turned by 32 bits, and in each a pair of nodes may differ
in one bit only until depth 32: some N * log(N) pairs instead of N * log(N)^3.

Spark does the walk's upper part: a global sort cuts each trie into blocks, which are sub-tries of at most BLOCK
fingerprints with a common path; a block pairs with the blocks whose paths are its own path, or a shorter beginning of
it, with at most the allowed bits turned over (an equi-join on depth and path). Then each pair of blocks is walked in
one task, in pieces of at most FRONTIER node pairs. Node pairs whose fingerprints all belong to one set already are not
walked further, and a pair of blocks gives one edge a fingerprint at most, so a large group of near copies costs rows in
proportion to its fingerprints, in each of its block pairs.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and links like any other; texts
of one or two words have one shingle; texts of any length are read whole, a piece at a time; rows without an id get
their component, whose smallest id is null only where none of its rows has an id; repeated rows give repeated rows;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE_WORDS, SEED = 3, 42
BUDGET = 3
HALF, HALF_BUDGET = 32, 1
BLOCK = 4096
FRONTIER = 1 << 18
_PIECE = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].lower().split()  # bytes know ASCII letters and the six spaces only
        at = end


def fingerprint(text: str | None) -> int:
    ones, n, held = np.zeros(64, np.int64), 0, []

    def add(hashes: list[int]) -> None:
        nonlocal n
        h = np.array(hashes, ">u8")
        ones.__iadd__(np.unpackbits(h.view(np.uint8)).reshape(len(h), 64).sum(axis=0, dtype=np.int64))
        n += len(h)

    for words in _pieces((text or "").encode()):
        words = held + words
        if len(words) < SHINGLE_WORDS:
            held = words
            continue
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        first = np.concatenate([[0], ends[: -SHINGLE_WORDS] + 1])
        add([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first.tolist(), ends[SHINGLE_WORDS - 1 :].tolist())])
        held = words[1 - SHINGLE_WORDS :]
    if not n and held:
        add([xxhash.xxh64_intdigest(b" ".join(held), SEED)])
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def _cut(keys: np.ndarray, turned: int, held: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Sub-tries of at most ``held`` sorted keys: (turned, depth, path, keys)."""
    stack = [(0, len(keys))]
    while stack:
        a, b = stack.pop()
        low, high = int(keys[a]), int(keys[b - 1])
        depth = 64 - (low ^ high).bit_length()
        if b - a <= held:
            yield turned, depth, low >> (64 - depth), keys[a:b].tobytes()
        else:  # at the first bit in which they differ
            mid = int(np.searchsorted(keys[a:b], np.uint64(high >> (63 - depth) << (63 - depth)))) + a
            stack += [(a, mid), (mid, b)]


_BLOCKS = pa.schema([("turned", pa.int32()), ("depth", pa.int32()), ("path", pa.int64()), ("keys", pa.binary())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(held: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (turned, key) in order; a block may end where a batch ends."""
        for batch in batches:
            turn, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]])
            rows = [r for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b > a for r in _cut(keys[a:b], int(turn[a]), held)]
            rows = [(t, d, _signed(p), k) for t, d, p, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 4, _BLOCKS.types)], schema=_BLOCKS)

    return cut


class Walk:
    """The joint walk of two sub-tries (or of one with itself). ``label`` is the set that each key belongs to."""

    def __init__(self, one: np.ndarray, two: np.ndarray | None, frontier: int = FRONTIER):
        self.keys = one if two is None else np.concatenate([one, two])
        self.size, self.frontier = len(one), frontier
        self.label = np.arange(len(self.keys))
        self.ones: dict[int, np.ndarray] = {}
        self.visited = 0
        n = len(one)
        if two is None:
            self._run(0, [np.array([x]) for x in (0, n, 0, n, 0)])
        elif len(two):
            depth = min(64 - (int(x[0]) ^ int(x[-1])).bit_length() for x in (one, two))
            differ = (int(one[0]) ^ int(two[0])) >> (64 - depth)
            if differ.bit_count() <= BUDGET and (differ >> max(0, depth - HALF)).bit_count() <= HALF_BUDGET:
                self._run(depth, [np.array([x]) for x in (0, n, n, n + len(two), differ.bit_count())])

    def _split(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where each sorted range of keys turns from 0 to 1 at a bit."""
        if depth not in self.ones:
            self.ones[depth] = np.concatenate([[0], np.cumsum((self.keys >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        ones = self.ones[depth]
        return hi - (ones[hi] - ones[lo])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Makes the sets of keys a[i] and b[i] one: smallest labels travel until nothing changes."""
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while (nxt := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = nxt

    def _run(self, depth: int, first: list[np.ndarray]) -> None:
        stack = [(depth, first)]
        while stack:
            depth, (a, b, x, y, d) = stack.pop()
            if len(a) > self.frontier:  # memory is bounded: half now, half later
                h = len(a) // 2
                stack += [(depth, [v[h:] for v in (a, b, x, y, d)]), (depth, [v[:h] for v in (a, b, x, y, d)])]
                continue
            self.visited += len(a)
            # pairs that are one set already
            change = np.concatenate([[0], np.cumsum(np.diff(self.label, prepend=self.label[:1]) != 0)])
            same = (change[b] == change[a + 1]) & (change[y] == change[x + 1]) & (self.label[a] == self.label[x])
            # all below differ in few enough bits
            near = ~same & (d + 64 - depth <= BUDGET)
            for lo, hi in ((a, b), (x, y)):
                n = hi[near] - lo[near]
                inner = np.repeat(lo[near], n)
                self._join(inner, inner + np.arange(len(inner)) - np.repeat(np.cumsum(n) - n, n))
            self._join(a[near], x[near])
            single = ~same & ~near & (b - a == 1) & (y - x == 1)
            bits = np.bitwise_count(self.keys[a[single]] ^ self.keys[x[single]])
            hit = bits <= BUDGET
            self._join(a[single][hit], x[single][hit])
            go = ~(same | near | single)
            if not go.any():
                continue
            a, b, x, y, d = a[go], b[go], x[go], y[go], d[go]
            m, z = self._split(depth, a, b), self._split(depth, x, y)
            own = a == x
            parts = [(a, m, x, z, d, None), (m, b, z, y, d, None), (a, m, z, y, d + 1, None), (m, b, x, z, d + 1, ~own)]
            new = [np.concatenate([p[i] if p[5] is None else p[i][p[5]] for p in parts]) for i in range(5)]
            ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= (HALF_BUDGET if depth < HALF else BUDGET))
            if ok.any():
                stack.append((depth + 1, [v[ok] for v in new]))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, key): one edge for each key that is not the first of its set."""
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.keys[at], self.keys[self.label[at]]


def _turn(keys: np.ndarray) -> np.ndarray:
    return (keys << np.uint64(32)) | (keys >> np.uint64(32))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b"]
    for batch in batches:
        out = [np.zeros((2, 0), np.uint64)]
        for turned, one, two in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            sides = [np.frombuffer(k, np.uint64) if (k := s.as_py()) is not None else None for s in (one, two)]
            pair = np.stack(Walk(*sides).edges())
            out.append(_turn(pair) if turned else pair)
        a, b = np.concatenate(out, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(turned, one, two) of the blocks (turned, depth, path, keys, id) that share a path but for the allowed bits; a
    block with itself has no ``two``.

    Up to depth HALF all paths that one bit makes are looked up; below it the first HALF bits are, and the rest of the
    paths is compared. Of two blocks the deeper one (of equal ones, the one with the larger id) looks for the other.
    """
    meta = blocks.select("turned", "depth", "path", "id")
    at = meta.select("turned", F.least("depth", F.lit(HALF)).alias("level"), F.expr(f"shiftrightunsigned(path, depth - least(depth, {HALF}))").alias("head"), F.col("depth").alias("depth_1"), F.col("path").alias("path_1"), F.col("id").alias("id_1"))
    levels = at.select("turned", "level").distinct()
    ask = meta.join(F.broadcast(levels), "turned").where("level <= depth")  # at most 2 * 33 rows
    ask = ask.withColumn("own", F.expr("IF(level = 0, 0L, shiftrightunsigned(path, depth - level))"))  # a shift by 64 is none
    ask = ask.withColumn("head", F.explode(F.expr("IF(level = 0, array(own), array_append(transform(sequence(1, level), i -> own ^ shiftleft(1L, i - 1)), own))")))
    met = ask.join(at, ["turned", "level", "head"]).where("depth > depth_1 OR (depth = depth_1 AND id > id_1)")
    met = met.where(f"depth_1 = 0 OR bit_count(shiftrightunsigned(path, depth - depth_1) ^ path_1) <= {BUDGET}").select("turned", "id", "id_1")
    keys = blocks.select("id", "keys")
    pairs = met.join(keys.withColumnRenamed("keys", "one"), "id").join(keys.select(F.col("id").alias("id_1"), F.col("keys").alias("two")), "id_1")
    return blocks.select("turned", F.col("keys").alias("one"), F.lit(None).cast("binary").alias("two")).unionByName(pairs.select("turned", "one", "two"))


def link_fingerprints(prints: DataFrame, held: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all linked fingerprints of a table with one row for each fingerprint ``fp``."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the sign bit is turned over, so that signed order is the order of the bits
    both = prints.select(F.inline(F.expr("array(named_struct('turned', 0, 'key', fp ^ shiftleft(1L, 63)), named_struct('turned', 1, 'key', (shiftleft(fp, 32) | shiftrightunsigned(fp, 32)) ^ shiftleft(1L, 63)))")))
    blocks = both.repartitionByRange(parts, "turned", "key").sortWithinPartitions("turned", "key")
    blocks = c.materialize(blocks.mapInArrow(_blocks(held), "turned int, depth int, path bigint, keys binary").withColumn("id", F.monotonically_increasing_id()), "sim-blocks")
    return block_pairs(blocks).repartition(parts).mapInArrow(_walk, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, held: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = c.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, "doc_id bigint, fp bigint"), "sim-rows")
    prints = c.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "sim-prints")
    edges = c.materialize(link_fingerprints(prints.select("fp"), held), "sim-edges")
    comps = c.components(edges, "sim").withColumnRenamed("node", "fp")
    placed = prints.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    groups = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = c.materialize(placed.join(groups, "comp").select("fp", "n", "component_id"), "sim-placed")
    out = c.join_classes(rows, placed, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
