"""A hexagonal grid on the sphere, as column expressions.

The sphere is an icosahedron: each of its 20 faces is a plane (gnomonic projection), and on each face lies the lattice of
the Eisenstein integers x + y * zeta (zeta = 60 degrees). At resolution r a face's edge is E_r = (2 + zeta)(3 - zeta)...,
r factors of norm 7, so every resolution has seven times the cells of the one before (10 * 7**r + 2 in all; the
12 at the icosahedron's corners are pentagons). A cell is (face, x, y); its 64-bit id holds the resolution, the face, the
root, and one digit a resolution: which of the seven residues modulo the last factor the cell is. Dropping the last digit
is division by that factor, the parent's place.

Where a cell lies beyond its face, its place is found around the nearest corner of the face: five sectors of 60 degrees
meet there, so moving into the next sector is one turn by zeta, and after five turns one is back. That one rule (`place`)
makes cells at edges and corners unique, carries neighbours and disks across faces, and leaves out the sixth direction at
a pentagon. Distances unfold the five faces around the nearest corner, both ways around. They are right as long as the
way is shorter than `reach` (from a corner's third of a face to the opposite edge); beyond it they are NULL.

Every function takes and gives SQL text. The steps of a computation are layers, each of which names values for the next.
The checking engine gets them as nested SELECTs, and so does Spark where ``d.layered`` is set: they run in generated code.
But a filter on a cell would be pushed down through them, and each layer copied into every use in the next one. So this
form is for tables that are written before they are filtered; otherwise all layers of a function are one expression in
which a layer is a struct, bound once (``transform`` over an array of one), at some four times the cost. Points without coordinates have no cell.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

UNITS = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]  # powers of zeta
FACTORS = [(2, 1), (3, -1)]  # of norm 7, by turns
RES_SHIFT, FACE_SHIFT, ROOT_SHIFT = 59, 54, 48
ROOT_OFFSET = 3


def _vertices() -> list[tuple[float, float, float]]:
    """The corners of the icosahedron, turned so that no corner, edge or plane of symmetry lies on a meridian."""
    g = (1 + math.sqrt(5)) / 2
    raw = [(0, a, b * g) for a in (-1, 1) for b in (-1, 1)]
    raw = sorted({(p[k % 3], p[(k + 1) % 3], p[(k + 2) % 3]) for p in raw for k in range(3)})
    out = []
    for x, y, z in raw:
        n = math.sqrt(x * x + y * y + z * z)
        x, y, z = x / n, y / n, z / n
        for a, (i, j) in ((0.31, (0, 1)), (0.77, (1, 2)), (1.13, (0, 2))):
            v = [x, y, z]
            v[i], v[j] = v[i] * math.cos(a) - v[j] * math.sin(a), v[i] * math.sin(a) + v[j] * math.cos(a)
            x, y, z = v
        out.append((x, y, z))
    return out


def _dot(a, b) -> float:
    return sum(x * y for x, y in zip(a, b))


def _cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


VERTICES = _vertices()
_CLOSE = 1 / math.sqrt(5) - 1e-6  # the cosine between joined corners
#: Corners of each face, counter-clockwise seen from outside.
FACES = [t if _dot(_cross(VERTICES[t[0]], VERTICES[t[1]]), VERTICES[t[2]]) > 0 else (t[0], t[2], t[1]) for t in combinations(range(12), 3) if all(_dot(VERTICES[a], VERTICES[b]) > _CLOSE for a, b in combinations(t, 2))]
assert len(FACES) == 20


def _around(v: int) -> list[tuple[int, int]]:
    """(face, corner number of v in it), counter-clockwise around a corner, from the face of the smallest number."""
    mine = {f: t.index(v) for f, t in enumerate(FACES) if v in t}
    f = min(mine)
    out = []
    while len(out) < 5:
        out.append((f, mine[f]))
        last = FACES[f][(mine[f] + 2) % 3]  # the next face begins at this face's last edge
        f = next(g for g in mine if FACES[g][(mine[g] + 1) % 3] == last)
    return out


SECTORS = [_around(v) for v in range(12)]
SECTOR_OF = [[[f for f, _ in SECTORS[v]].index(k) for v in t] for k, t in enumerate(FACES)]
CENTRES = [tuple(sum(VERTICES[v][i] for v in t) for i in range(3)) for t in FACES]


def _dual(t: tuple[int, int, int]) -> list[tuple[float, float, float]]:
    """Rows that give a point's weights at the corners."""
    a, b, c = (VERTICES[v] for v in t)
    det = _dot(_cross(a, b), c)
    return [tuple(x / det for x in r) for r in (_cross(b, c), _cross(c, a), _cross(a, b))]


DUALS = [_dual(t) for t in FACES]


def multiply(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0] + a[1] * b[1]


def edge(res: int) -> tuple[int, int]:
    out = (1, 0)
    for r in range(res):
        out = multiply(out, FACTORS[r % 2])
    return out


def reach(res: int) -> int:
    """Distances below this are known: the way stays among the five faces around a corner."""
    return max(1, int(math.sqrt(7**res) * math.sqrt(3) / 6))


def _times(x: str, y: str, p: str, q: str) -> tuple[str, str]:
    return f"({x} * {p} - {y} * {q})", f"({x} * {q} + {y} * {p} + {y} * {q})"


def _number(v) -> str:
    return f"cast({v!r} AS double)" if isinstance(v, float) else str(v)


_NAME = re.compile(r"(?<![\w.'])[a-z_]\w*\b(?!\s*\()")
_WORDS = {"case", "when", "then", "else", "end", "and", "or", "as", "is", "not", "null", "div", "int", "bigint", "double"}


def _names(expressions) -> set[str]:
    return {x for e in expressions for x in _NAME.findall(e) if x.lower() not in _WORDS}


def _layers(d, sql: str, layers: list[dict[str, str]], out: list[str]) -> str:
    """The rows of ``sql`` with the columns ``out`` of the last layers."""
    if d.layered:
        for n, layer in enumerate(layers):
            sql = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in layer.items())} FROM ({sql}) s{n}"
        return sql
    wanted, steps = set(out), []
    for layer in reversed(layers):  # what the later layers need
        steps.append((layer, sorted(wanted)))
        wanted = (wanted - set(layer)) | _names(layer.values())
    state = f"named_struct({', '.join(f'{chr(39)}{x}{chr(39)}, {x}' for x in sorted(wanted))})"
    for layer, keep in reversed(steps):
        of = lambda x: _NAME.sub(lambda m: m[0] if m[0].lower() in _WORDS else f"v.{m[0]}", x)
        fields = ", ".join(f"'{x}', {of(layer.get(x, x))}" for x in keep)
        state = f"transform(array({state}), v -> named_struct({fields}))[0]"
    g = f"{out[0]}_all"
    return f"SELECT * EXCEPT ({g}), {', '.join(f'{g}.{x} AS {x}' for x in out)} FROM (SELECT *, {state} AS {g} FROM ({sql}))"


def _turned(d, x: str, y: str, k: str) -> tuple[str, str]:
    """Times zeta**k, k from -6 on."""
    at = f"(({k} + 12) % 6)"
    return _times(x, y, d.pick([u[0] for u in UNITS], at), d.pick([u[1] for u in UNITS], at))


def _corner(d, res: int, c: str) -> tuple[str, str]:
    e = edge(res)
    z = multiply(e, UNITS[1])
    return d.pick([0, e[0], z[0]], c), d.pick([0, e[1], z[1]], c)


def place(d, sql: str, res: int, face: str, x: str, y: str, out: str, origin: tuple[str, str] | None = None) -> str:
    """Columns {out}f, {out}x, {out}y of a cell, see ``_place``."""
    return _layers(d, sql, _place(d, res, face, x, y, out, origin), [f"{out}f", f"{out}x", f"{out}y"])


def _place(d, res: int, face: str, x: str, y: str, out: str, origin: tuple[str, str] | None = None) -> list[dict[str, str]]:
    """Columns {out}f, {out}x, {out}y: the one name of the cell at lattice point (x, y) in the plane of a face.

    ``x`` and ``y`` may lie beyond the face, by less than ``reach``, in a straight line from ``origin``; for points
    opposite to the face it decides on which side of the corner the line passes.
    """
    p, q = edge(res)
    n = 7**res
    c, v = f"{out}_c", f"{out}_v"
    cx, cy = _corner(d, res, c)
    vx, vy = f"{out}_vx", f"{out}_vy"
    a, b = f"{out}_a", f"{out}_b"
    back = _turned(d, f"({x} - {cx})", f"({y} - {cy})", f"(0 - 2 * {c})")
    left = "-3"
    if origin:
        ox, oy = _turned(d, f"({origin[0]} - {cx})", f"({origin[1]} - {cy})", f"(0 - 2 * {c})")
        left = f"CASE WHEN {ox} * {vy} - {oy} * {vx} > 0 THEN 3 ELSE -3 END"
    turn = _turned(d, vx, vy, f"(0 - {out}_t)")
    home = _turned(d, f"{out}_hx", f"{out}_hy", f"(2 * {out}_c2)")
    c2x, c2y = _corner(d, res, f"{out}_c2")
    weight = lambda k, w: f"(({w}) * 12 + 11 - {d.pick([t[k] for t in FACES], face)})"
    return [
        {f"{out}_wx": f"({x} * {p + q} + {y} * {q})", f"{out}_wy": f"({y} * {p} - {x} * {q})"},
        {f"{out}_w0": weight(0, f"{n} - {out}_wx - {out}_wy"), f"{out}_w1": weight(1, f"{out}_wx"), f"{out}_w2": weight(2, f"{out}_wy")},
        {c: f"CASE WHEN {out}_w0 > {out}_w1 AND {out}_w0 > {out}_w2 THEN 0 WHEN {out}_w1 > {out}_w2 THEN 1 ELSE 2 END"},
        {v: d.pick([k for t in FACES for k in t], f"({face} * 3 + {c})"), f"{out}_s": d.pick([k for t in SECTOR_OF for k in t], f"({face} * 3 + {c})"), vx: back[0], vy: back[1]},
        {a: f"({vx} * {p + q} + {vy} * {q})", b: f"({vy} * {p} - {vx} * {q})"},
        {f"{out}_t": f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 - {out}_s WHEN {a} > 0 AND {b} >= 0 THEN 0 WHEN {a} <= 0 AND {a} + {b} > 0 THEN 1 WHEN {b} > 0 AND {a} + {b} <= 0 THEN 2 WHEN {a} < 0 AND {b} <= 0 THEN {left} WHEN {a} >= 0 AND {a} + {b} < 0 THEN -2 ELSE -1 END"},
        {f"{out}_k": f"({v} * 5 + ({out}_s + {out}_t + 10) % 5)", f"{out}_hx": turn[0], f"{out}_hy": turn[1]},
        {f"{out}f": d.pick([f for s in SECTORS for f, _ in s], f"{out}_k"), f"{out}_c2": d.pick([k for s in SECTORS for _, k in s], f"{out}_k")},
        {f"{out}_ox": home[0], f"{out}_oy": home[1]},
        {f"{out}x": f"({out}_ox + {c2x})", f"{out}y": f"({out}_oy + {c2y})"},
    ]


def cell_at(d, sql: str, res: int, lat: str, lon: str, out: str) -> str:
    """Columns {out}f, {out}x, {out}y: the cell around a point, from SQL for its coordinates."""
    p, q = edge(res)
    o = out
    xyz = {f"{o}_px": f"cos(radians({lat})) * cos(radians({lon}))", f"{o}_py": f"cos(radians({lat})) * sin(radians({lon}))", f"{o}_pz": f"sin(radians({lat}))"}
    dots = {f"{o}_d{k}": " + ".join(f"{_number(v)} * {o}_p{i}" for v, i in zip(m, "xyz")) for k, m in enumerate(CENTRES)}
    best = f"greatest({', '.join(dots)})"
    face = "CASE " + " ".join(f"WHEN {k} >= {o}_best THEN {n}" for n, k in enumerate(dots)) + " END"
    weights = {f"{o}_u{c}": " + ".join(f"{d.pick([m[c][i] for m in DUALS], f'{o}_face')} * {o}_p{a}" for i, a in enumerate("xyz")) for c in range(3)}
    total = f"({o}_u0 + {o}_u1 + {o}_u2)"
    beta, gamma = f"({o}_u1 / {total})", f"({o}_u2 / {total})"
    real = {f"{o}_rx": f"({beta} * {p} - {gamma} * {q})", f"{o}_ry": f"({beta} * {q} + {gamma} * {p + q})"}
    near = {f"{o}_n{k}": f"floor({e} + 0.5)" for k, e in (("x", f"{o}_rx"), ("y", f"{o}_ry"), ("z", f"(0 - {o}_rx - {o}_ry)"))}
    off = {f"{o}_e{k}": f"abs({o}_n{k} - {e})" for k, e in (("x", f"{o}_rx"), ("y", f"{o}_ry"), ("z", f"(0 - {o}_rx - {o}_ry)"))}
    lattice = {
        f"{o}_lx": f"cast(CASE WHEN {o}_ex > {o}_ey AND {o}_ex > {o}_ez THEN 0 - {o}_ny - {o}_nz ELSE {o}_nx END AS bigint)",
        f"{o}_ly": f"cast(CASE WHEN {o}_ex > {o}_ey AND {o}_ex > {o}_ez THEN {o}_ny WHEN {o}_ey > {o}_ez THEN 0 - {o}_nx - {o}_nz ELSE {o}_ny END AS bigint)",
    }
    layers = [xyz, dots, {f"{o}_best": best}, {f"{o}_face": face}, weights, real, near, off, lattice]
    return _layers(d, sql, layers + _place(d, res, f"{o}_face", f"{o}_lx", f"{o}_ly", out), [f"{o}f", f"{o}x", f"{o}y"])


def _root(x: str, y: str) -> str:
    return f"(({x} + {ROOT_OFFSET}) * 8 + {y} + {ROOT_OFFSET})"


def _up(d, r: int, x: str, y: str, digit: str) -> tuple[str, str, str]:
    """(digit, parent's x, parent's y) of a lattice point of resolution r: the digit is the residue modulo the factor."""
    p, q = FACTORS[(r - 1) % 2]
    k = 5 if (r - 1) % 2 == 0 else 3  # zeta modulo the factor
    by_residue = [0] * 7
    for j in range(6):
        by_residue[pow(k, j, 7)] = 1 + j
    x0, y0 = f"({x} - {d.pick([0, *(u[0] for u in UNITS)], digit)})", f"({y} - {d.pick([0, *(u[1] for u in UNITS)], digit)})"
    up = _times(x0, y0, str(p + q), f"({-q})")
    return d.pick(by_residue, f"((({x} + {k} * {y}) % 7 + 7) % 7)"), d.idiv(up[0], "7"), d.idiv(up[1], "7")


def cell_id(d, sql: str, res: int, cell: str, out: str) -> str:
    """Column {out}: the 64-bit id of a placed cell (columns {cell}f, {cell}x, {cell}y)."""
    return _layers(d, sql, _cell_id(d, res, cell, out), [out])


def _cell_id(d, res: int, cell: str, out: str) -> list[dict[str, str]]:
    x, y, layers, digits = f"{cell}x", f"{cell}y", [], []
    for r in range(res, 0, -1):
        g = f"{out}_g{r}"
        digit, _, _ = _up(d, r, x, y, "0")
        _, ux, uy = _up(d, r, x, y, g)
        layers += [{g: digit}, {f"{out}_x{r}": ux, f"{out}_y{r}": uy}]
        digits.append(f"cast({g} AS bigint) * {1 << ROOT_SHIFT - 3 * r}")
        x, y = f"{out}_x{r}", f"{out}_y{r}"
    head = f"cast({res} AS bigint) * {1 << RES_SHIFT} + cast({cell}f AS bigint) * {1 << FACE_SHIFT} + cast({_root(x, y)} AS bigint) * {1 << ROOT_SHIFT}"
    return [*layers, {out: " + ".join([head, *digits])}]


def _field(d, ident: str, shift: int, size: int) -> str:
    return f"({d.idiv(ident, str(1 << shift))} % {size})"


def cell_of_id(d, sql: str, res: int, ident: str, out: str) -> str:
    """Columns {out}f, {out}x, {out}y of the lattice point that an id of resolution ``res`` names: its root, times the
    factors, plus the units of its digits."""
    return _layers(d, sql, _cell_of_id(d, res, ident, out), [f"{out}f", f"{out}x", f"{out}y"])


def _cell_of_id(d, res: int, ident: str, out: str) -> list[dict[str, str]]:
    layers = [{f"{out}f": f"cast({_field(d, ident, FACE_SHIFT, 32)} AS int)", f"{out}_x0": f"{_field(d, ident, ROOT_SHIFT + 3, 8)} - {ROOT_OFFSET}", f"{out}_y0": f"{_field(d, ident, ROOT_SHIFT, 8)} - {ROOT_OFFSET}"}]
    for r in range(1, res + 1):
        p, q = FACTORS[(r - 1) % 2]
        x, y = _times(f"{out}_x{r - 1}", f"{out}_y{r - 1}", str(p), f"({q})")
        g = f"cast({_field(d, ident, ROOT_SHIFT - 3 * r, 8)} AS int)"
        layers.append({f"{out}_x{r}": f"{x} + {d.pick([0, *(u[0] for u in UNITS)], g)}", f"{out}_y{r}": f"{y} + {d.pick([0, *(u[1] for u in UNITS)], g)}"})
    return [*layers, {f"{out}x": f"{out}_x{res}", f"{out}y": f"{out}_y{res}"}]


def ancestor(d, sql: str, res: int, to: int, ident: str, out: str) -> str:
    """Column {out}: the id without its digits beyond resolution ``to``, under the name that its place has."""
    g = f"{out}_short"
    short = f"{d.idiv(ident, str(1 << ROOT_SHIFT - 3 * to))} * {1 << ROOT_SHIFT - 3 * to} - cast({res - to} AS bigint) * {1 << RES_SHIFT}"
    layers = [{g: short}, *_cell_of_id(d, to, g, f"{out}_p"), *_place(d, to, f"{out}_pf", f"{out}_px", f"{out}_py", f"{out}_q"), *_cell_id(d, to, f"{out}_q", out)]
    return _layers(d, sql, layers, [out])


def parent(d, sql: str, res: int, ident: str, out: str) -> str:
    return ancestor(d, sql, res, res - 1, ident, out)


def distance(d, sql: str, res: int, one: str, two: str, out: str) -> str:
    """Column {out}: the least number of steps between two placed cells; NULL from ``reach`` on."""
    p, q = edge(res)
    n = 7**res
    o = out
    cx, cy = _corner(d, res, f"{o}_c")
    kx, ky = _corner(d, res, f"{o}_c2")
    mine = _turned(d, f"({one}x - {cx})", f"({one}y - {cy})", f"(0 - 2 * {o}_c)")
    other = _turned(d, f"({two}x - {kx})", f"({two}y - {ky})", f"(0 - 2 * {o}_c2)")
    v2 = lambda c: d.pick([t[c] for t in FACES], f"{two}f")
    ways = [_turned(d, f"{o}_bx", f"{o}_by", k) for k in (f"{o}_k", f"({o}_k - 5)")]
    norm = lambda w: f"greatest(abs({o}_ax - {w[0]}), abs({o}_ay - {w[1]}), abs({o}_ax - {w[0]} + {o}_ay - {w[1]}))"
    cross = lambda w: f"({o}_ax * {w[1]} - {o}_ay * {w[0]})"
    # a way counts where it turns by half a circle at most
    left = f"CASE WHEN {o}_k <= 2 OR ({o}_k = 3 AND {cross(ways[0])} >= 0) THEN {norm(ways[0])} END"
    right = f"CASE WHEN {o}_k >= 3 OR ({o}_k = 2 AND {cross(ways[1])} <= 0) THEN {norm(ways[1])} END"
    sectors = [k for t in SECTOR_OF for k in t]
    layers = [
        {f"{o}_wx": f"({one}x * {p + q} + {one}y * {q})", f"{o}_wy": f"({one}y * {p} - {one}x * {q})"},
        {f"{o}_c": f"CASE WHEN {n} - {o}_wx - {o}_wy >= {o}_wx AND {n} - {o}_wx - {o}_wy >= {o}_wy THEN 0 WHEN {o}_wx >= {o}_wy THEN 1 ELSE 2 END"},
        {f"{o}_v": d.pick([k for t in FACES for k in t], f"({one}f * 3 + {o}_c)")},
        {f"{o}_c2": f"CASE {o}_v WHEN {v2(0)} THEN 0 WHEN {v2(1)} THEN 1 WHEN {v2(2)} THEN 2 END"},
        {f"{o}_ax": mine[0], f"{o}_ay": mine[1], f"{o}_bx": other[0], f"{o}_by": other[1], f"{o}_k": f"(({d.pick(sectors, f'({two}f * 3 + {o}_c2)')} - {d.pick(sectors, f'({one}f * 3 + {o}_c)')} + 5) % 5)"},
        {f"{o}_w": f"least({left}, {right})"},
        {out: f"CASE WHEN {o}_w < {reach(res)} THEN {o}_w END"},
    ]
    return _layers(d, sql, layers, [out])


def centre(d, sql: str, res: int, cell: str, out: str) -> str:
    """Columns {out}lat, {out}lon: the middle of a placed cell."""
    p, q = edge(res)
    n = float(7**res)
    o = out
    weights = {f"{o}_b": f"(({cell}x * {p + q} + {cell}y * {q}) / {_number(n)})", f"{o}_g": f"(({cell}y * {p} - {cell}x * {q}) / {_number(n)})"}
    at = {f"{o}_{a}": f"((1 - {o}_b - {o}_g) * {d.pick([VERTICES[t[0]][i] for t in FACES], f'{cell}f')} + {o}_b * {d.pick([VERTICES[t[1]][i] for t in FACES], f'{cell}f')} + {o}_g * {d.pick([VERTICES[t[2]][i] for t in FACES], f'{cell}f')})" for i, a in enumerate("xyz")}
    return _layers(d, sql, [weights, at, {f"{o}lat": f"degrees(atan2({o}_z, sqrt({o}_x * {o}_x + {o}_y * {o}_y)))", f"{o}lon": f"degrees(atan2({o}_y, {o}_x))"}], [f"{o}lat", f"{o}lon"])


def disk(d, sql: str, res: int, cell: str, steps: str, most: int, out: str) -> str:
    """A row for each lattice point within ``steps`` (at most ``most``) of a placed cell, with the columns {out}f, {out}x,
    {out}y of its cell. Around a pentagon two points can be one cell: count distinct cells."""
    offsets = [(x, y) for x in range(-most, most + 1) for y in range(-most, most + 1) if abs(x + y) <= most]
    size = [max(abs(x), abs(y), abs(x + y)) for x, y in offsets]
    rows, i = d.numbered(len(offsets), f"{out}_i"), f"{out}_i"
    sql = f"SELECT *, {d.pick([x for x, _ in offsets], i)} AS {out}_dx, {d.pick([y for _, y in offsets], i)} AS {out}_dy, {d.pick(size, i)} AS {out}_n FROM ({sql}) b CROSS JOIN {rows}"
    sql = f"SELECT *, {cell}x + {out}_dx AS {out}_tx, {cell}y + {out}_dy AS {out}_ty FROM ({sql}) w WHERE {out}_n <= {steps}"
    return place(d, sql, res, f"{cell}f", f"{out}_tx", f"{out}_ty", out, (f"{cell}x", f"{cell}y"))
