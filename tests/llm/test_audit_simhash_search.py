"""Filter audit, SimHash and lexical search against plain definitions, and on edge cases."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworks.llm import common as c
from tallyworks.llm import filter_audit, lexical_search, oracles, registry, simhash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, fp bigint, term string, A int, n string"
LONG = "word other " * 60_000 + "x" * 3_000
EDGE = [(1, None), (None, "a null id"), (None, ""), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here"), (5, "same text here"), (6, "Same text, HERE"), (7, "é ÉÉ 日本 \U0001f600 nul\x00nul"), (8, "one"), (8, "two words"), (9, "SAME $ text HERE"), (10, "same text here")]
LABEL = "doc_id bigint, quality int, toxic int, part string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, None if k % 3 else "src1", None, "p", 1, "t", 1, "n") for k, (i, t) in enumerate(EDGE)], DOC)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 1, "x"), (5, 1, None, "x"), (None, 1, 1, "x"), (10, None, None, "x")], LABEL)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_lexical_search"])
def test_query_matches_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(oracles.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())


def plain_audit(rows, labels):
    good, bad = ({i for i, q, t, *_ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs[s or ""].append((i, {k for k, v in fails.items() if v}))
    out = set()
    for part, rows in docs.items():
        orders = ["".join(p) for p in permutations("ABCDE")]
        shapley = Counter(next(x for x in o if x in f) for o in orders for _, f in rows if f)
        for o in orders:
            for k, x in enumerate(o):
                alive = [(i, f) for i, f in rows if not f & set(o[:k])]
                gone = [i for i, f in alive if x in f]
                out.add((part, o, k + 1, len(alive) - len(gone), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == {x} for _, f in rows), sum(i in good for i in gone), sum(i in bad for i in gone), shapley[x]))
    return out


def test_audit_edges(spark, edge, nothing, labels):
    rows = [(r.doc_id, r.text, r.source) for r in edge.collect()]
    want = plain_audit(rows, [tuple(r) for r in labels.collect()])
    got = filter_audit.audit_filters(edge, labels).collect()
    assert len(got) == len(want) == 2 * 600 and {tuple(r) for r in got} == want
    assert {tuple(r) for r in filter_audit.audit_filters(edge, labels.where("false")).collect()} == plain_audit(rows, [])
    assert filter_audit.audit_filters(nothing, labels).count() == 0


def plain_print(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Smallest member of each group of linked 64-bit values."""
    own, root = sorted(set(prints)), {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    a = np.array(own, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = sorted((find(own[i]), find(own[j])))
            root[y] = x
    return {x: find(x) for x in own}


def test_fingerprint_is_the_hash_of_spark(spark, edge):
    for _, t in EDGE + [(0, "A b  C\td"), (0, "x " * 700_000 + "y z")]:
        if t is None or len(t) < 100_000:
            assert simhash.fingerprint(t) == plain_print(t)
    x = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint("a B c") == x % (1 << 64)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i * i) for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 50)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def near_values(rng, n, centres, flips):
    """Values around few centres, and values anywhere."""
    out = list(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
    for x in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(n // centres):
            v = int(x)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                v ^= 1 << int(b)
            out.append(np.uint64(v))
    return np.unique(np.array(out, np.uint64))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 5), st.sampled_from([3, 64, 1 << 18]))
def test_walk_joins_what_is_linked(seed, centres, flips, frontier):
    keys = near_values(np.random.default_rng(seed), 150, centres, flips)
    found = defaultdict(set)
    for turn in (False, True):
        x = np.sort(simhash._turn(keys)) if turn else keys
        pair = np.stack(simhash.Walk(x, None, frontier).edges())
        for a, b in (simhash._turn(pair) if turn else pair).T.tolist():
            assert a in keys and b in keys
            found[a].add(b)
            found[b].add(a)
    want, got = plain_groups(keys.tolist()), {}
    for k in keys.tolist():
        if k not in got:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in got:
                    got[x] = k
                    todo += found[x]
    assert got == want


@pytest.mark.parametrize("held", [4, 50, 4096])
def test_blocks_lose_no_pair(spark, held):
    """Blocks of all depths, among them paths deeper than half."""
    rng = np.random.default_rng(held)
    keys = np.concatenate([near_values(rng, 300, 5, 4), np.uint64(0xABCDEF0123456789) ^ np.arange(300, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1, 1 << 63], np.uint64)])
    keys = np.unique(keys)
    prints = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp bigint").repartition(3)
    edges = simhash.link_fingerprints(prints, held)
    comp = {r.node % (1 << 64): r.comp % (1 << 64) for r in c.components(edges).collect()}
    sets = defaultdict(set)
    for k in keys.tolist():
        sets[comp.get(k, k)].add(k)
    want = defaultdict(set)
    for k, v in plain_groups(keys.tolist()).items():
        want[v].add(k)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))


def test_a_ball_is_walked_in_little_work():
    """Node pairs and edges of a dense ball stay far below its number of pairs."""
    rng, work = np.random.default_rng(1), []
    for n in (1000, 4000):
        bits = rng.choice(64, 14, replace=False)
        keys = np.unique(np.array([sum(1 << int(b) for b, on in zip(bits, rng.integers(0, 2, 14)) if on) for _ in range(n)], np.uint64))
        w = simhash.Walk(keys, None, 1 << 12)
        assert len(w.edges()[0]) < len(keys)
        work.append(w.visited / len(keys))
    assert work[1] < 2.5 * work[0]


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_simhash_groups(spark, edge, sf, which):
    docs = edge if which == "edge" else c.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [(i, simhash.fingerprint(t) if t and len(t) > 100_000 else plain_print(t)) for i, t in rows]
    group, least = plain_groups([p for _, p in prints]), {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = Counter((i, f"{p:016x}", least.get(group[p])) for i, p in prints)
    got = simhash.simhash_groups(docs, 16)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_hot_text(spark, monkeypatch):
    """A text that is most of the table goes around the shuffled join, and loses no row."""
    monkeypatch.setattr(c, "HOT_SHARE", 3)
    docs = spark.createDataFrame([(i, "one and the same text" if i % 3 else f"text number {i} of its own kind") for i in range(300)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert len(got) == 300 and all(got[i] == 1 for i in range(300) if i % 3)


def plain_ranking(docs, items, top=20):
    terms = lambda t: re.findall(lexical_search.TERM, (t or "").translate({x: x + 32 for x in range(65, 91)}))
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(x) for _, x in tf), sum(x.total() for _, x in tf)
    df = Counter(w for _, x in tf for w in x)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, x in tf:
            m = 75 + 25 * x.total() * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * x[w] // (1000 * x[w] + 12 * m)) for w in terms(text) if x[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:top], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"vocabulary": 0}, {"slice_bytes": 200}, {"top": 2}])
def test_search_edges(spark, edge, nothing, how, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 3)
    items = [(1, "same TEXT here here"), (1, "same TEXT here here"), (1, "another text of one id"), (None, "two words"), (3, None), (4, "日本 ÉÉ nul"), (5, "nowhere"), (6, LONG[:20_000])]
    table = spark.createDataFrame([(*x, "d") for x in items], "item_id bigint, text string, doc_id string")
    got = lexical_search.rank_documents(edge, table, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_ranking(EDGE, [(i, t or "") for i, t in items], how.get("top", 20))
    assert lexical_search.rank_documents(nothing, table).count() == 0 == lexical_search.rank_documents(edge, table.where("false")).count()


def test_pruned_blocks_hold_no_better_document():
    rng = np.random.default_rng(5)
    blocks, every = [], []
    for b in range(40):
        doc, term = np.repeat(np.arange(8), 12), rng.zipf(1.4, 96).clip(max=400).astype(np.uint64)
        key = np.unique(np.stack([doc.astype(np.uint64), term]), axis=1)
        imp = rng.integers(1, 1000, key.shape[1])
        ids, starts, entries, impacts, terms, largest, _ = lexical_search._block(np.arange(8) + 8 * b, key[0].astype(np.int64), key[1], imp)
        blocks.append((np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int32), np.frombuffer(entries, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64), terms.view(np.uint64), largest))
    q = lexical_search.Queries([(7, [3, 50, 90], [5, 100, 90]), (8, [1], [2])])
    r = lexical_search.Ranking(q, np.zeros(2, np.int64), 5)
    r.visit(blocks, None)
    for item in (0, 1):
        every = [(-s, int(i)) for b in blocks for i, s in zip(b[0], q.scores(item, b[4], b[1], b[2], b[3])) if s > 0]
        assert list(zip((-r.score[item]).tolist(), r.ids[item].tolist())) == sorted(every)[:5]
    assert r.scored < r.met


def test_scope_leaves_the_result_only(spark, sf):
    root = c.shared_root(spark)
    fs = c.drop_path.__globals__["local_path"](root)
    import os

    before = set(os.listdir(fs))
    out = registry.queries()["op12_simhash"](spark, sf)
    new = set(os.listdir(fs)) - before
    assert len(new) == 1 and out.count() > 0
    c.release(out)
    assert set(os.listdir(fs)) == before


def test_scopes_nest_and_close_on_errors(spark):
    with c.Scope(spark) as outer:
        with c.Scope(spark) as inner:
            kept = inner.keep(c.materialize(spark.range(3).toDF("x"), "kept"))
            gone = c.materialize(spark.range(3).toDF("x"), "gone")
        assert kept.count() == 3 and len(outer.paths) == 1
        with pytest.raises(Exception):
            gone.count()
    with pytest.raises(ZeroDivisionError):
        with c.Scope(spark) as s:
            c.materialize(spark.range(3).toDF("x"), "lost")
            path = next(iter(s.paths))
            1 // 0
    assert not __import__("os").path.exists(c.local_path(path))


def test_all_pairs_of_small_walks():
    """Every value of few bits against every other."""
    values = np.array([x << s for x in range(16) for s in (0, 30, 60)], np.uint64)
    keys = np.unique(values)
    want = {frozenset(p) for p in combinations(keys.tolist(), 2) if (p[0] ^ p[1]).bit_count() <= 3}
    groups = plain_groups(keys.tolist())
    assert all(groups[a] == groups[b] for a, b in want)
