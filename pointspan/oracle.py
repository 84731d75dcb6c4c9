"""SQL text for the point engine's queries, to be run by another engine."""

from __future__ import annotations

from pointspan.functions.geometry import EPS32, Box, Sphere

SIDE, DEPTH = 3, 6

EV = "SELECT event_id AS id, event_type AS ptype, CAST(value AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS z, props FROM events"
EMB = "SELECT vec_id AS id, CAST(label AS VARCHAR) AS ptype, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"
KEY = "((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 32768 + l_partkey) * 2048 + l_suppkey AS id, l_returnflag AS ptype"
LI = f"SELECT {KEY}, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS z FROM lineitem"
DUP = f"SELECT {KEY}, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS z FROM lineitem"
ORD = "SELECT o_orderkey AS id, o_orderstatus AS ptype, CAST(o_totalprice AS DOUBLE) AS x, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM orders"
AXES = "xyz"


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def d2(x: str, y: str, z: str, ox: str, oy: str, oz: str) -> str:
    dx, dy, dz = (f"(CAST({o} AS DOUBLE) - {p})" for o, p in ((ox, x), (oy, y), (oz, z)))
    return f"({dx} * {dx} + {dy} * {dy} + {dz} * {dz})"


def pair_d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({b}.{c} - {a}.{c}) * ({b}.{c} - {a}.{c})" for c in AXES) + ")"


def in_box(box: Box) -> str:
    v = box.values()
    return "(" + " AND ".join(f"{a} BETWEEN {num(p)} AND {num(p + s)}" for a, p, s in zip(AXES, v[:3], v[3:], strict=True)) + ")"


def in_sphere(s: Sphere) -> str:
    return f"({d2('x', 'y', 'z', repr(s.cx), repr(s.cy), repr(s.cz))} <= {num(s.r * s.r)})"


def octant(x: str, y: str, z: str, mx: str, my: str, mz: str) -> str:
    return f"(1 + CAST({x} >= {mx} AS INTEGER) + 2 * CAST({y} >= {my} AS INTEGER) + 4 * CAST({z} >= {mz} AS INTEGER))"


def vertices(prefix: str = "o") -> list[list[str]]:
    return [[f"({prefix}{a} + {prefix}d{a})" if i >> k & 1 else f"{prefix}{a}" for k, a in enumerate(AXES)] for i in range(8)]


def nearest(center: list[str]) -> list[str]:
    return [f"least(greatest({c}, o{a}), o{a} + od{a})" for c, a in zip(center, AXES, strict=True)]


def coded(test, center: list[str]) -> str:
    inside = " + ".join(f"CAST({test(v)} AS INTEGER)" for v in vertices())
    return f"(CASE WHEN {test(nearest(center))} THEN greatest({inside}, 1) ELSE 0 END)"


def box_code(box: Box) -> str:
    v = box.values()
    test = lambda p: "(" + " AND ".join(f"{c} BETWEEN {num(q)} AND {num(q + s)}" for c, q, s in zip(p, v[:3], v[3:], strict=True)) + ")"
    return coded(test, [num(c) for c in box.midplane()])


def sphere_code(s: Sphere) -> str:
    center = [repr(c) for c in (s.cx, s.cy, s.cz)]
    return coded(lambda p: f"({d2(*p, *center)} <= {num(s.r * s.r)})", [num(c) for c in (s.cx, s.cy, s.cz)])


def auto_box(points: str) -> str:
    low = ", ".join(f"min({a}) - abs(min({a})) * {num(EPS32)} AS o{a}, max({a}) - min({a}) AS s{a}" for a in AXES)
    return f"SELECT {', '.join(f'o{a}, s{a} + greatest(s{a}, greatest(abs(o{a}), 1.0)) * 2 * {num(EPS32)} AS od{a}' for a in AXES)} FROM (SELECT {low} FROM ({points}))"


def clip(boxes: str, box: Box) -> str:
    v = box.values()
    low = {a: f"least(greatest(o{a}, {num(p)}), {num(p + s)})" for a, p, s in zip(AXES, v[:3], v[3:], strict=True)}
    high = {a: f"least(greatest({low[a]} + od{a}, {num(p)}), {num(p + s)})" for a, p, s in zip(AXES, v[:3], v[3:], strict=True)}
    return f"SELECT id, {', '.join(f'{low[a]} AS c{a}, {high[a]} - {low[a]} AS cd{a}' for a in AXES)} FROM ({boxes}) WHERE {' AND '.join(f'{high[a]} - {low[a]} > 0' for a in AXES)}"


def morton(box: Box) -> str:
    v = box.values()
    cells = ", ".join(f"least(CAST(floor(least(greatest(({a} - {num(p)}) / {num(s)}, 0.0), 1.0) * 2097152.0) AS BIGINT), 2097151) AS c{a}" for a, p, s in zip(AXES, v[:3], v[3:], strict=True))
    bits = " + ".join(f"((c{a} // {2**i}) % 2) * {2 ** (3 * i + k)}" for i in range(21) for k, a in enumerate(AXES))
    return f"SELECT id, CAST({bits} AS BIGINT) AS morton FROM (SELECT id, {cells} FROM ({EV}))"


def cube(box: Box, side: int = SIDE) -> str:
    v = box.values()
    cell = lambda a, p, s: f"least(CAST(CASE WHEN {a} = {num(p + s)} THEN {side - 1} ELSE floor(({a} - {num(p)}) / {num(s)} * {side}) END AS BIGINT), {side - 1})"
    x, y, z = (cell(a, p, s) for a, p, s in zip(AXES, v[:3], v[3:], strict=True))
    return f"(CASE WHEN {in_box(box)} THEN ({x} * {side} + {y}) * {side} + {z} ELSE {side**3} END)"


def cube_columns(box: Box, side: int = SIDE) -> str:
    v = box.values()
    step = (f"(cube_id // {side * side})", f"((cube_id // {side}) % {side})", f"(cube_id % {side})")
    return ", ".join(f"CASE WHEN cube_id = {side**3} THEN {num(p)} ELSE {num(p)} + {i} * {num(s / side)} END AS o{a}, CASE WHEN cube_id = {side**3} THEN {num(s)} ELSE {num(s / side)} END AS od{a}" for a, i, p, s in zip(AXES, step, v[:3], v[3:], strict=True))


def cube_boxes(box: Box, side: int = SIDE) -> str:
    return f"SELECT cube_id, {cube_columns(box, side)} FROM (SELECT unnest(range({side**3 + 1})) AS cube_id) AS c"


def nearest_cube(box: Box, center: tuple[float, ...]) -> str:
    at = [repr(c) for c in center]
    dist = d2(*nearest([num(c) for c in center]), *at)
    cubes = f"SELECT cube_id, {cube_columns(box)} FROM (SELECT DISTINCT {cube(box)} AS cube_id FROM ({EV}))"
    return f"SELECT cube_id, sqrt({dist}) AS dist FROM ({cubes}) ORDER BY {dist}, cube_id LIMIT 1"


def index(points: str, box: Box, threshold: int, select: str, by_type: bool = False) -> str:
    """The leaf partition to ``DEPTH`` levels, unrolled; tables ``nodes`` and ``placed``."""
    group = "ptype, cube_id" if by_type else "cube_id"
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in group.split(", "))
    keep = ", ".join(f"o{a}, od{a}" for a in AXES)
    out = [f"l1 AS (SELECT *, '0' AS p1, {cube_columns(box)} FROM (SELECT id, ptype, x, y, z, {cube(box)} AS cube_id FROM ({points})))"]
    for level in range(2, DEPTH + 1):
        digit = octant("x", "y", "z", *[f"(o{a} + od{a} / 2)" for a in AXES])
        old = ", ".join(f"p{i}" for i in range(1, level))
        moved = ", ".join(f"CASE WHEN ((d - 1) // {2**k}) % 2 = 1 THEN o{a} + od{a} / 2 ELSE o{a} END AS o{a}, od{a} / 2 AS od{a}" for k, a in enumerate(AXES))
        out.append(f"l{level} AS (SELECT id, ptype, x, y, z, cube_id, {old}, p{level - 1} || CAST(d AS VARCHAR) AS p{level}, {moved} FROM (SELECT *, {digit} AS d FROM l{level - 1}))")
    counts = " UNION ALL ".join(f"SELECT {group}, p{i} AS tag, CAST({i} AS BIGINT) AS level, count(*) AS n, {', '.join(f'min({c}) AS {c}' for c in keep.split(', '))} FROM l{i} GROUP BY {group}, p{i}" for i in range(1, DEPTH + 1))
    out.append(f"counted AS ({counts})")
    out.append(f"real AS (SELECT c.*, (c.n <= {threshold} OR c.level >= {DEPTH}) AS is_leaf FROM counted AS c LEFT JOIN counted AS u ON {same('u', 'c')} AND u.tag = substr(c.tag, 1, length(c.tag) - 1) WHERE c.level = 1 OR u.n > {threshold})")
    whole = "PARTITION BY ptype " if by_type else ""
    out.append(f"leaves AS (SELECT *, CAST(sum(n) OVER ({whole}ORDER BY cube_id, tag) - n AS BIGINT) AS start FROM real WHERE is_leaf)")
    out.append(f"nodes AS (SELECT r.*, s.start, s.start + r.n AS stop FROM real AS r JOIN (SELECT {', '.join(f'r.{c}' for c in group.split(', '))}, r.tag, min(f.start) AS start FROM real AS r JOIN leaves AS f ON {same('f', 'r')} AND substr(f.tag, 1, length(r.tag)) = r.tag GROUP BY {', '.join(f'r.{c}' for c in group.split(', '))}, r.tag) AS s ON {same('s', 'r')} AND s.tag = r.tag)")
    out.append(f"placed AS (SELECT p.id, p.cube_id, f.tag AS leaf_tag, CAST(f.start + row_number() OVER (PARTITION BY {', '.join(f'p.{c}' for c in group.split(', '))}, f.tag ORDER BY p.id) - 1 AS BIGINT) AS pos FROM l{DEPTH} AS p JOIN leaves AS f ON {same('f', 'p')} AND substr(p.p{DEPTH}, 1, length(f.tag)) = f.tag)")
    return f"WITH {', '.join(out)} {select}" if not select.lstrip().upper().startswith("WITH") else f"WITH {', '.join(out)}, {select.lstrip()[5:]}"
