"""The grid on the sphere: exact counts, round trips, and breadth-first search over neighbours."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyworks.functions import sphere as S
from tallyworks.plans.dialect import Duck, Spark


def all_cells(con, res):
    (p, q), n = S.edge(res), 7**res
    m = int(n**0.5 * 1.2) + 2
    points = f"SELECT f::INT AS f, x::BIGINT AS x, y::BIGINT AS y FROM range(20) a(f), range({-m}, {m + 1}) b(x), range({-m}, {m + 1}) c(y) WHERE x * {p + q} + y * {q} >= 0 AND y * {p} - x * {q} >= 0 AND x * {p + q} + y * {q} + y * {p} - x * {q} <= {n}"
    con.execute(f"CREATE OR REPLACE TABLE cells AS SELECT DISTINCT cf, cx, cy FROM ({S.place(Duck, points, res, 'f', 'x', 'y', 'c')})")
    return con.execute("SELECT * FROM cells").fetchall()


def neighbours(con, res):
    out = defaultdict(set)
    for r in con.execute(f"SELECT cf, cx, cy, nf, nx, ny FROM ({S.disk(Duck, 'SELECT * FROM cells', res, 'c', '1', 1, 'n')}) WHERE n_n = 1").fetchall():
        out[r[:3]].add(r[3:])
    return out


def search(graph, start, steps):
    seen, edge = {start: 0}, [start]
    for k in range(steps):
        edge = [b for a in edge for b in graph[a] if b not in seen and not seen.update({b: k + 1})]
    return seen


@pytest.mark.parametrize("res", [2, 3, 4])
def test_every_cell(res):
    con = duckdb.connect()
    cells, graph = all_cells(con, res), neighbours(con, res)
    assert len(cells) == 10 * 7**res + 2
    assert con.execute(f"SELECT count(*) FROM ({S.place(Duck, 'SELECT * FROM cells', res, 'cf', 'cx', 'cy', 'k')}) WHERE (kf, kx, ky) <> (cf, cx, cy)").fetchone()[0] == 0
    assert Counter(map(len, graph.values())) == {6: 10 * 7**res - 10, 5: 12}
    assert all(a in graph[b] and a != b for a in graph for b in graph[a])
    ids = S.cell_id(Duck, "SELECT * FROM cells", res, "c", "id")
    assert con.execute(f"SELECT count(DISTINCT id), sum(((ef, ex, ey) <> (cf, cx, cy))::INT) FROM ({S.cell_of_id(Duck, ids, res, 'id', 'e')})").fetchone() == (len(cells), 0)
    children = con.execute(f"SELECT up, count(*) FROM ({S.parent(Duck, ids, res, 'id', 'up')}) GROUP BY 1").fetchall()
    assert Counter(n for _, n in children) == {7: 10 * 7 ** (res - 1) - 10, 6: 12}
    if res > 2:  # two digits at once are two parents
        twice = S.parent(Duck, S.parent(Duck, ids, res, "id", "up"), res - 1, "up", "upper")
        assert con.execute(f"SELECT count(*) FROM ({S.ancestor(Duck, twice, res, res - 2, 'id', 'direct')}) WHERE direct <> upper").fetchone()[0] == 0
    back = S.cell_at(Duck, S.centre(Duck, "SELECT * FROM cells", res, "c", "m"), res, "mlat", "mlon", "e")
    assert con.execute(f"SELECT sum(((ef, ex, ey) <> (cf, cx, cy))::INT) FROM ({back})").fetchone()[0] == 0


@pytest.mark.parametrize("res", [2, 3, 4])
def test_distances_and_disks_are_those_of_a_search(res):
    con = duckdb.connect()
    cells, graph = all_cells(con, res), neighbours(con, res)
    corners, reach = [a for a in graph if len(graph[a]) == 5], S.reach(res)
    close = [b for a in corners[:3] for b in search(graph, a, 2)]
    starts = sorted({*random.Random(res).sample(cells, 40), *close})
    con.execute("CREATE TABLE starts (sf INT, sx BIGINT, sy BIGINT)")
    con.executemany("INSERT INTO starts VALUES (?, ?, ?)", starts)
    far = {s: search(graph, s, reach + 2) for s in starts}
    known = 0
    for *pair, d in con.execute(f"SELECT sf, sx, sy, cf, cx, cy, d FROM ({S.distance(Duck, 'SELECT * FROM starts, cells', res, 's', 'c', 'd')})").fetchall():
        true = far[tuple(pair[:3])].get(tuple(pair[3:]))
        assert d == (true if true is not None and true < reach else None), pair
        known += d is not None
    assert known > len(starts)
    k, disks = max(1, reach - 1), defaultdict(set)
    for r in con.execute(f"SELECT sf, sx, sy, nf, nx, ny FROM ({S.disk(Duck, 'SELECT * FROM starts', res, 's', str(k), k, 'n')})").fetchall():
        disks[r[:3]].add(r[3:])
    for s in starts:
        assert disks[s] == set(search(graph, s, k))
    assert 1 + 3 * k * (k + 1) in map(len, disks.values()) and len(disks[corners[0]]) == 1 + 5 * k * (k + 1) // 2


def test_spark_agrees_and_the_date_line_and_poles_are_no_edges(spark):
    places = [(31.5, 34.5), (0.0, 179.999), (0.0, -179.999), (90.0, 0.0), (90.0, 120.0), (-90.0, 7.0), (-89.9, 10.0), (52.0, 13.0), (None, 1.0), (1.0, None)]
    rows = ", ".join(f"(cast({a} AS double), cast({b} AS double))".replace("None", "NULL") for a, b in places)
    out = {}
    for d, run in ((Spark, lambda q: [tuple(r) for r in spark.sql(q).collect()]), (Duck, lambda q: duckdb.sql(q).fetchall())):
        sql = S.cell_id(d, S.cell_at(d, f"SELECT lat, lon FROM (VALUES {rows}) AS v(lat, lon)", 6, "lat", "lon", "a"), 6, "a", "id")
        out[d.name] = sorted(run(f"SELECT lat, lon, af, ax, ay, id FROM ({sql}) t"), key=str)
    assert out["spark"] == out["duck"]
    cell = {r[:2]: r[2:5] for r in out["spark"]}
    ident = {r[:2]: r[5] for r in out["spark"]}
    assert ident[90.0, 0.0] == ident[90.0, 120.0] and ident[None, 1.0] is None and ident[1.0, None] is None

    def steps(a, b):
        (f, x, y), (g, u, v) = cell[a], cell[b]
        return spark.sql(f"SELECT d FROM ({S.distance(Spark, f'SELECT {f} AS af, {x}L AS ax, {y}L AS ay, {g} AS bf, {u}L AS bx, {v}L AS by', 6, 'a', 'b', 'd')})").first().d

    assert steps((0.0, 179.999), (0.0, -179.999)) <= 1 and steps((-90.0, 7.0), (-89.9, 10.0)) <= 2
    assert steps((31.5, 34.5), (31.5, 34.5)) == 0 and steps((31.5, 34.5), (-90.0, 7.0)) is None
