"""N-gram Jaccard join: all pairs of texts with a Jaccard similarity of 0.8 or more over five-word shingles.

1. Texts with the same words are one class (the copies); everything after works on one row for each class.
2. A MinHash LSH forest: TREES prefix tries of MinHash labels of DEPTH values. Labels lie in sorted order, so the texts
   below a trie node are one run of rows and its deeper nodes are shorter runs inside it. Each run is worked from its
   deepest nodes up: the matched prefix is shortened value by value, and only texts that no deeper match has brought
   together are compared again. A text's prefix is shortened until a pair at the least similarity that its number of
   shingles admits has an expected recall of RECALL, 1 - (1 - s**d)**TREES; texts of few shingles, which are linked at
   0.83 or more or not at all, keep longer prefixes.
3. Two texts of a node are compared by short sketches; pairs far below the threshold (ESTIMATE, five standard deviations)
   are passed over. What is left goes on as a spanning set of edges, never as all pairs. The members of a node of more
   than NODE texts all go on as one set, each with one edge.
4. Connected components of these edges bring the texts that may be linked together. Each is dealt to blocks of BLOCK
   texts or BLOCK_BYTES and verified exactly: intersections of all shingle sets by one matrix product a block. Then each
   pair of blocks of a large component is verified, and leaves one edge for two linked sets of two blocks.

The result has one row a document: its class (the smallest doc_id linked to it directly or through others), its text
class (smallest doc_id with the same words), and the number of its links to other texts. Counting links is exact, so a
group of n different near copies costs n * n / BLOCK rows in step 4 (and n * n tests inside matrix products); all other
steps, and all edges, are in proportion to n.

Defined cases: null or empty texts are copies of one another, and link to nothing else; a text of one to four words has
one shingle, all its words; words are runs of letters and digits, lower-cased; texts of any length are read whole; null
ids are larger than all others; repeated rows are copies; extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

TREES, DEPTH, RECALL, THRESHOLD = 24, 9, 0.999, 0.8
SKETCH, ESTIMATE = 128, 0.55
NODE = 4096
BLOCK, BLOCK_BYTES = 1024, 8 << 20
LEVEL_BITS = 16  # of each label value below the shortest prefix
GROUP_BYTES = 2 << 20  # texts shingled at once
_LAST = (1 << 63) - 1


def matched_depth(similarity: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten the matched prefix, from the full label, until a pair of this similarity has the expected recall."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(size: int) -> float:
    """The least similarity, of those that make a link, that a set of ``size`` shingles has to any set."""
    top, of = c.SIMILARITY
    reachable = [i / (size + m - i) for m in range(size * top // of, size * of // top + 2) for i in range(min(size, m) + 1) if m and of * i >= top * (size + m - i)]
    return min(reachable, default=1.0)


FLOOR = matched_depth()
#: The matched depth by number of shingles; from the last entry on it is FLOOR or the difference no longer matters.
DEPTHS = np.array([DEPTH] + [matched_depth(least_similarity(n)) for n in range(1, 20)] + [FLOOR], np.int8)


def text_keys(words: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that identify each text's word sequence."""
    n = np.diff(bounds)
    pos = np.arange(len(words)) - np.repeat(bounds[:-1], n)
    out = []
    for seed in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
        h = c.mix(words + c.mix((pos + 1).astype(np.uint64) * np.uint64(seed)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        out.append(c.mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64) * np.uint64(seed)))
    both = np.stack(out, axis=1)
    return [row.tobytes() for row in both]


SIGNED = "doc_id bigint, th bigint, key binary, size bigint, least tinyint, nodes array<struct<node: bigint, path: bigint>>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key, trie labels (the node at the shortest prefix, and the path below it) and sketch of each text."""
    per = TREES * DEPTH
    mult, fold = c.odd_multipliers(max(per, SKETCH), 2), c.odd_multipliers(DEPTH, 22)
    low_bits = np.uint64((1 << LEVEL_BITS) - 1)
    for batch in batches:
        for begin, end, texts in c.text_groups(batch):
            words, bounds = c.grouped_words(texts)
            sh, sb = c.shingles(words, bounds)
            node, path = (np.zeros((TREES, len(texts)), np.uint64) for _ in range(2))
            sketch = np.zeros((len(texts), SKETCH), np.uint8)
            for i, m in enumerate(mult):
                value = c.mix(c.segment_min(sh * m, sb, 0))
                if i < per:
                    tree, level = divmod(i, DEPTH)
                    if level < FLOOR:
                        node[tree] += value * fold[level]
                    else:
                        path[tree] = path[tree] << np.uint64(LEVEL_BITS) | value >> np.uint64(20) & low_bits
                if i < SKETCH:
                    sketch[:, i] = (value >> np.uint64(56)).astype(np.uint8)
            node = c.mix(node + np.arange(1, TREES + 1, dtype=np.uint64)[:, None]).astype(np.int64).T
            count = np.diff(sb)
            full = count > 0
            labels = pa.StructArray.from_arrays([pa.array(node[full].ravel()), pa.array(path.astype(np.int64).T[full].ravel())], ["node", "path"])
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, TREES, 0))]).astype(np.int32)), labels)
            ids, th = (batch.column(i).slice(begin, end - begin) for i in (0, 2))
            least = DEPTHS[np.minimum(count, len(DEPTHS) - 1)]
            yield pa.RecordBatch.from_arrays([ids, th, pa.array(text_keys(words, bounds), pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(least, pa.int8()), nodes, pa.array([r.tobytes() for r in sketch], pa.binary())],
                                             names=["doc_id", "th", "key", "size", "least", "nodes", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(batch.schema.get_field_index(x)) for x in keys]
        first, end = tuple(x[0].as_py() for x in k), tuple(x[-1].as_py() for x in k)
        if held and first == last and first == end:
            held.append(batch)
            continue
        cols = [np.asarray(x.to_numpy(zero_copy_only=False)) for x in k]
        change = np.zeros(batch.num_rows, bool)
        for x in cols:
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change)
        cut = int(starts[-1]) if len(starts) else 0
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def _run_ids(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        x = np.asarray(t.column(k).to_numpy())
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


class Forest:
    """Union-find over the rows of a table."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def stars(self, keys: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Edges from the smallest key of each set to its others. The units of one group share most of them, whichever
        tree they come from, so that few are left once they are made distinct."""
        least: dict[int, bytes] = {}
        for i, k in enumerate(keys):
            r = self.find(i)
            least[r] = min(least.get(r, k), k)
        edges = {(least[self.find(i)], k) for i, k in enumerate(keys)}
        edges = sorted(e for e in edges if e[0] != e[1])
        return [e[0] for e in edges], [e[1] for e in edges]


def _alike(sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (sketch[x[at : at + 8192]] == sketch[y[at : at + 8192]]).sum(axis=1) >= int(SKETCH * ESTIMATE)
    return out


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common label prefix of texts of one node, from their paths."""
    differ = a ^ b
    return FLOOR + sum((differ >> (LEVEL_BITS * k) == 0).astype(np.int64) for k in range(DEPTH - FLOOR))


def node_sets(path: np.ndarray, least: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Sets of the texts of one node (rows in path order), from the full label up to the node's own prefix: at each depth
    the texts below one deeper node are compared, unless they are in one set already. Returns each row's set."""
    label = np.arange(len(path))
    for depth in range(DEPTH, FLOOR - 1, -1):
        prefix = path >> (LEVEL_BITS * (DEPTH - depth))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [len(path)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = lo + np.flatnonzero(least[lo:hi] <= depth)
            for k, p in enumerate(rows.tolist()):
                rest = rows[k + 1 :]
                rest = rest[label[rest] != label[p]]
                if not len(rest):
                    if (label[rows] == label[p]).all():
                        break
                    continue
                hit = rest[_alike(sketch, np.full(len(rest), p), rest)]
                if len(hit):
                    met = np.unique(np.append(label[hit], label[p]))
                    label[np.isin(label, met)] = met[0]
    return label


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the texts of each node whose sketches agree, from rows sorted by node and path."""
    few = 24
    for t in _runs(batches, ("node",)):
        run = _run_ids(t, ("node",))
        path, least = (np.asarray(t.column(k).to_numpy()).astype(np.int64) for k in ("path", "least"))
        keys = t.column("key").to_pylist()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        size = np.bincount(run)
        forest = Forest(len(keys))
        live = np.flatnonzero((size[run] > 1) & (size[run] <= few))  # small nodes, all of them at once
        for gap in range(1, few):
            live = live[live + gap < len(run)]
            live = live[run[live] == run[live + gap]]
            if not len(live):
                break
            x = live[shared_depth(path[live], path[live + gap]) >= np.maximum(least[live], least[live + gap])]
            for p in x[_alike(sketch, x, x + gap)].tolist():
                forest.join(p, p + gap)
        starts = np.concatenate([[0], np.cumsum(size)])
        for r in np.flatnonzero(size > few).tolist():
            lo, hi = int(starts[r]), int(starts[r + 1])
            for i, k in enumerate(node_sets(path[lo:hi], least[lo:hi], sketch[lo:hi]).tolist()):
                if i != k:
                    forest.join(lo + i, lo + k)
        a, b = forest.stars(keys)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of membership matrices (columns in slices)."""
    sets = left + right if right is not left else left
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(flat):
        return out.astype(np.int64)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[column] > 1  # an element of one set alone is in no intersection but the set's own
    rank = np.cumsum(times > 1) - 1
    column, row = rank[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = int(column[-1]) + 1 if len(column) else 0
    width = min(max(1, total), max(64, (4 << 20) // len(sets)))
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(left)] @ (m if right is left else m[len(left) :]).T
    return np.rint(out).astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of two lists are linked; a set is not linked to itself."""
    top, of = c.SIMILARITY
    n, m = (np.array([len(s) for s in sets], np.int64) for sets in (left, right))
    near = (of + top) * intersections(left, right) >= top * (n[:, None] + m[None, :])
    if right is left:
        np.fill_diagonal(near, False)
    return near


def _units(t: pa.Table, unit: tuple[str, ...]) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(first row, rows, their shingle sets) of each unit of a table. Rows that share the id of a class's document but
    hold another text are left out."""
    run = _run_ids(t, unit)
    bounds = np.concatenate([np.flatnonzero(np.diff(run, prepend=-1)), [t.num_rows]]).tolist()
    keys, texts = t.column("key").to_pylist(), t.column("text")
    held, first, size = [], 0, 0
    for u in range(len(bounds) - 1):
        held += [(texts[i].as_py() or "").encode() for i in range(bounds[u], bounds[u + 1])]
        size += sum(map(len, held[bounds[u] - bounds[first] :]))
        if size < GROUP_BYTES and u < len(bounds) - 2:
            continue
        words, wb = c.grouped_words(held)
        found = text_keys(words, wb)
        sh, sb = c.shingles(words, wb)
        base = bounds[first]
        for k in range(first, u + 1):
            use = {keys[i]: i for i in range(bounds[k], bounds[k + 1]) if found[i - base] == keys[i]}
            rows = list(use.values())
            yield bounds[k], rows, [np.unique(sh[sb[i - base] : sb[i - base + 1]]) for i in rows]
        held, first, size = [], u + 1, 0


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*rows) if rows else [[]] * len(names), types)], names=list(names))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a component: the links a class has in it, and the set of linked classes it is in (root)."""
    for t in _runs(batches, ("comp", "block")):
        keys, out = t.column("key").to_pylist(), []
        for _, rows, sets in _units(t, ("comp", "block")):
            near = links(sets, sets)
            forest = Forest(len(rows))
            for x, y in zip(*np.nonzero(np.triu(near))):
                forest.join(int(x), int(y))
            least: dict[int, bytes] = {}
            for i, r in enumerate(rows):
                top = forest.find(i)
                least[top] = min(least.get(top, keys[r]), keys[r])
            out += [(keys[r], int(n), least[forest.find(i)]) for i, (r, n) in enumerate(zip(rows, near.sum(axis=1)))]
        yield _batch(out, ("key", "links", "root"), (pa.binary(), pa.int64(), pa.binary()))


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a component: the links of each class across, and one edge for two linked roots
    unless they are joined already."""
    unit = ("comp", "bi", "bj")
    for t in _runs(batches, unit):
        keys, roots, sides = (t.column(k).to_pylist() for k in ("key", "root", "side"))
        out: list[tuple] = []
        for _, rows, sets in _units(t, unit):
            part = [[i for i, r in enumerate(rows) if sides[r] == s] for s in (0, 1)]
            near = links(*([sets[i] for i in p] for p in part))
            for p, count in ((part[0], near.sum(axis=1)), (part[1], near.sum(axis=0))):
                out += [(keys[rows[i]], int(n), None, None) for i, n in zip(p, count) if n]
            name = sorted({roots[r] for r in rows})
            at = {k: i for i, k in enumerate(name)}
            mine = [np.array([at[roots[rows[i]]] for i in p], np.int64) for p in part]
            forest = Forest(len(name))
            x, y = np.nonzero(near)
            for a, b in np.unique(np.stack([mine[0][x], mine[1][y]]), axis=1).T.tolist():
                if forest.find(a) != forest.find(b):
                    forest.join(a, b)
                    out.append((None, 0, name[a], name[b]))
        yield _batch(out, ("key", "links", "a", "b"), (pa.binary(), pa.int64(), pa.binary(), pa.binary()))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes (key, least, nodes, sketch) that the forest brings together."""
    many = classes.where(F.size("nodes") > 0).select("key", "least", F.inline("nodes").alias("node", "path"))
    shared = many.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    members = c.materialize(many.join(shared, "node"), "jj-members")
    small = members.where(F.col("n") <= NODE).join(classes.select("key", "sketch"), "key").select("node", "path", "least", "key", "sketch")
    small = small.repartition(_parts(classes), "node").sortWithinPartitions("node", "path", "key")
    large = members.where(F.col("n") > NODE)
    first = large.groupBy("node").agg(F.min("key").alias("a"))
    return small.mapInArrow(_near, "a binary, b binary").unionByName(large.join(first, "node").where("a <> key").select("a", F.col("key").alias("b")))


def link_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed rows: doc_id, th, key; classes: key, doc, th, copies, links, group), both tables in the shared folder.

    ``th`` is a hash of the raw text; ``doc`` and ``th`` name one row of the class; ``group`` is the smallest ``doc``
    of the linked classes.
    """
    doc, th = _row_key()
    signed = c.materialize(docs.select(doc.alias("doc_id"), "text", th).mapInArrow(_sign, SIGNED), "jj-signed")
    of_class = [F.any_value(x).alias(x) for x in ("size", "least", "nodes", "sketch")]
    classes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.count("*").alias("copies"), *of_class)
    classes = c.materialize(classes.select("key", F.col("r.doc_id").alias("doc"), F.col("r.th").alias("th"), "copies", *("size", "least", "nodes", "sketch")), "jj-classes")
    comps = c.components(candidates(classes), "jj-near").withColumnRenamed("node", "key")

    placed = comps.join(classes.select("key", "doc", "th", "size"), "key")
    sizes = placed.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    placed = placed.join(sizes, "comp").withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) AS int)"))
    placed = c.materialize(placed.drop("size"), "jj-placed")
    texts = docs.select(*_row_key(), "text")
    # candidates grow with the corpus: never broadcast
    held = texts.join(placed.hint("merge"), ["doc", "th"]).select("comp", "block", "key", "text")
    held = held.repartition(_parts(docs), "comp", "block").sortWithinPartitions("comp", "block")
    checked = c.materialize(held.mapInArrow(_verify, "key binary, links bigint, root binary"), "jj-links")

    split = placed.where("blocks > 1")
    if split.limit(1).count():
        split = split.join(checked.select("key", "root"), "key").hint("merge").join(texts, ["doc", "th"])
        split = split.withColumn("x", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> block)"))).select("comp", F.least("x", "block").alias("bi"), F.greatest("x", "block").alias("bj"), (F.col("block") > F.col("x")).cast("int").alias("side"), "key", "root", "text")
        split = split.repartition(_parts(docs), "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
        across = c.materialize(split.mapInArrow(_verify_pairs, "key binary, links bigint, a binary, b binary"), "jj-across")
        joined = c.components(across.where("a IS NOT NULL").select("a", "b"), "jj-groups").select(F.col("node").alias("root"), "comp")
        more = across.where("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("more"))
        checked = checked.join(joined, "root", "left").join(more, "key", "left")
        checked = checked.select("key", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("comp", "root").alias("root"))

    found = checked.where("links > 0")
    g = found.join(classes.select("key", "doc", "th"), "key")
    least = g.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("group"))
    found = g.join(least, "root").select("key", "links", "group")
    own = F.struct(F.col("doc").alias("doc"), F.col("th").alias("th"))
    out = classes.select("key", "doc", "th", "copies").join(found, "key", "left").select("key", "doc", "th", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", own).alias("group"))
    out = c.materialize(out, "jj-out")
    c.release(classes, placed)
    return signed.select("doc_id", "th", "key"), out


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links of every row."""
    signed, classes = link_texts(docs)
    number = lambda x: F.nullif(F.col(x), F.lit(_LAST))
    return signed.join(classes.drop("th"), "key").select(number("doc_id").alias("doc_id"), number("group.doc").alias("class_id"), number("doc").alias("text_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts and copies: the one with the smallest id (of several with that id and text,
    the one whose columns have the smallest hash). All columns stay."""
    signed, classes = link_texts(docs)
    best = classes.where((F.col("group.doc") == F.col("doc")) & (F.col("group.th") == F.col("th"))).select("doc", "th")
    same = signed.groupBy(F.col("doc_id").alias("doc"), "th").agg(F.count("*").alias("same"))
    best = c.materialize(best.join(same, ["doc", "th"]), "jj-best")
    rows = docs.select(*_row_key(), F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    kept = rows.join(best.hint("merge"), ["doc", "th"])
    if not best.where("same > 1").limit(1).count():
        return kept.select("row.*")
    # only rows that occur several times over need a second shuffle
    once = kept.where("same > 1").groupBy("doc", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.where("same = 1").select("row.*").unionByName(once.select("row.*"))
