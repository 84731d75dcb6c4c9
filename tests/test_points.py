"""The point engine against brute force, known answers and its own invariants."""

import importlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointspan import cli, queries
from pointspan.functions import geometry as g
from pointspan.functions.profiles import log_profile
from pointspan.operators import joins, knn, navigate, search
from pointspan.operators.kdtree import PointTree
from pointspan.plans.index import build_index
from pointspan.plans.packed import pack, pack_index, unpack
from pointspan.sources import store
from pointspan.sources.points import PointFrame, blobs, header_box, uniform
from pointspan.streaming.filters import stream_inside

rng = np.random.default_rng(11)
XYZ = np.vstack([rng.random((350, 3)) * 100, np.tile([[10.0, 20.0, 30.0]], (50, 1))])
BALL, CUBE = g.Sphere(40.0, 45.0, 50.0, 30.0), g.Box(10.0, 20.0, 30.0, 40.0, 30.0, 20.0)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, "A" if i % 3 else "B", *map(float, p), float(i % 7)) for i, p in enumerate(XYZ)]
    odd = [(1000, "A", float("nan"), 1.0, 1.0, 0.0), (1001, "A", None, 1.0, 1.0, 0.0), (1002, "A", float("inf"), 1.0, 1.0, 0.0)]
    return PointFrame(spark.createDataFrame(rows + odd, "id long, particle_type string, x double, y double, z double, f double").repartition(3).cache())


@pytest.fixture(scope="module")
def index(frame):
    with pytest.warns(UserWarning, match="hold more than"):
        built = build_index(frame, 3, 20, 8)
    return type(built)(built.points.cache(), built.nodes.cache(), built.cubes, built.box, built.side, built.threshold, built.depth)


def in_ball(s=BALL):
    d = XYZ - [s.cx, s.cy, s.cz]
    return {i for i, v in enumerate((d * d).sum(axis=1)) if v <= s.r * s.r}


def in_cube(b=CUBE):
    low, high = np.array(b.values()[:3]), np.array(b.values()[:3]) + b.values()[3:]
    return set(np.flatnonzero(((XYZ >= low) & (XYZ <= high)).all(axis=1)).tolist())


def ids(df, name="id"):
    return sorted(r[name] for r in df.select(name).collect())


coordinate = st.floats(-1e6, 1e6, allow_subnormal=False)
boxes = st.tuples(coordinate, coordinate, coordinate, *[st.floats(1e-2, 1e6)] * 3).map(g.Box.of)


@settings(max_examples=100, deadline=None)
@given(boxes, boxes)
def test_box_rules(a, b):
    assert a.max_depth() > 0
    for i in range(8):
        child = a.child(i)
        assert child.dx == a.dx / 2
        assert a.vertex(i + 1) == pytest.approx(tuple(p + (i >> k & 1) * s for k, (p, s) in enumerate(zip(a.values()[:3], a.values()[3:], strict=True))))
    part = a.clip(b)
    if part:
        assert all(q >= p for p, q in zip(b.values()[:3], part.values()[:3], strict=True))
    around = a.neighbors()
    assert len(around) == 26 and a not in around
    assert a.project(a.midplane()) == a.midplane()


@pytest.mark.parametrize("values", [[0, 0, 0, 1, 1], [0, 0, 0, 1, 1, float("nan")], [0, 0, 0, 1, 1, -1], [0, 0, 0, 0, 1, 1], [1e10, 0, 0, 1e-12, 1, 1], [float("inf"), 0, 0, 1, 1, 1]])
def test_bad_boxes(values):
    with pytest.raises(g.BoundingBoxError):
        g.Box.of(values)


def test_bad_arguments(frame):
    with pytest.raises(ValueError):
        g.Sphere.of((1, 2), 3)
    with pytest.raises(ValueError):
        g.Box.of(CUBE).vertex(9)
    with pytest.raises(NotImplementedError):
        CUBE.project((0, 0, 0), -1)
    with pytest.raises(ValueError):
        frame.select_fields(["nothing"])
    with pytest.raises(ValueError):
        build_index(frame, 3, 0)
    with pytest.raises(ValueError):
        frame.of_type("Z", check=True)
    with pytest.raises(NotImplementedError):
        knn.nearest(frame.df, (0, 0, 0), p=3)
    assert header_box(5).values() == (0, 0, 0, 5, 5, 5) and frame.select_fields("f") == ["f"] and frame.select_fields("all") == ["f"]


def test_strict_search(frame):
    assert set(ids(search.inside(frame.df, BALL))) == in_ball()
    assert set(ids(search.subset(frame, CUBE, "f").df)) == in_cube()
    assert search.count_inside(frame.df, CUBE).first()["n"] == len(in_cube())


def test_filter_reaches_the_scan(spark, sf):
    plan = search.inside(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), g.Sphere(1000.0, 0.0, 0.0, 500.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in plan and "LessThanOrEqual(o_totalprice" in plan


def test_index_rules(frame, index):
    nodes = index.nodes.collect()
    by = {(n.cube_id, n.tag): n for n in nodes}
    assert sum(n.n for n in nodes if n.level == 1) == len(XYZ)
    for n in nodes:
        assert n.level == len(n.tag) and n.stop - n.start == n.n
        kids = [m for m in nodes if m.cube_id == n.cube_id and m.tag[:-1] == n.tag]
        assert n.is_leaf == (not kids) and (not n.is_leaf or n.n <= 20 or n.level == 8)
        if kids:
            assert sum(m.n for m in kids) == n.n and min(m.start for m in kids) == n.start
            assert n.n > 20
    points = index.points.collect()
    assert sorted(p.pos for p in points) == list(range(len(XYZ)))
    for p in points:
        leaf = by[p.cube_id, p.leaf_tag]
        assert leaf.is_leaf and leaf.start <= p.pos < leaf.stop
        for a in "xyz":
            assert leaf[f"o{a}"] <= p[a] <= leaf[f"o{a}"] + leaf[f"od{a}"]


def halving(rows, box, threshold, depth):
    """Nodes (tag, n) and the leaf of each row, by halving one box after the other."""
    nodes, leaf = [], {}

    def go(tag, o, d, own):
        nodes.append((tag, len(own)))
        if len(own) <= threshold or len(tag) >= depth:
            leaf.update(dict.fromkeys((i for i, *_ in own), tag))
            return
        middle = [p + s / 2 for p, s in zip(o, d, strict=True)]
        parts = {}
        for row in own:
            parts.setdefault(1 + sum((row[a + 1] >= middle[a]) << a for a in range(3)), []).append(row)
        for digit in sorted(parts):
            go(tag + str(digit), [middle[a] if digit - 1 >> a & 1 else o[a] for a in range(3)], [s / 2 for s in d], parts[digit])

    go("0", box[:3], box[3:], rows)
    return sorted(nodes), leaf


def test_deep_index(spark):
    """Points closer than 2**-30 of the box, equal points, points on borders: as by halving, at the depth that the box allows."""
    box = g.Box(0.1, -7.3, 2.0, 1.1, 3.7, 0.9)
    near = [(0.7, -5.0 + k * 1e-9, 2.5) for k in range(12)]
    borders = [(0.1 + 1.1 * i / 16, -7.3 + 3.7 * j / 8, 2.0 + 0.9 * ((i * j) % 5) / 4) for i in range(17) for j in range(9)]
    rows = [(i, *map(float, p)) for i, p in enumerate(near + borders + [(0.3, -6.0, 2.1)] * 5)]
    df = spark.createDataFrame([(i, "A", *p) for i, *p in rows], "id long, particle_type string, x double, y double, z double")
    built = build_index(PointFrame(df), 1, 2, 40, box)
    inside = [r for r in rows if all(p <= v <= p + s for v, p, s in zip(r[1:], box.values()[:3], box.values()[3:], strict=True))]
    outside = [r for r in rows if r not in inside]
    at = [(0, inside)] + [(1, outside)] * bool(outside)
    want, leaf = [], {}
    for cube, own in at:
        nodes, leaves = halving(own, box.values(), 2, 40)
        want += [(cube, *n) for n in nodes]
        leaf |= {i: (cube, tag) for i, tag in leaves.items()}
    assert sorted((n.cube_id, n.tag, n.n) for n in built.nodes.collect()) == sorted(want)
    placed = {p.id: (p.cube_id, p.leaf_tag) for p in built.points.collect()}
    assert placed == leaf and max(len(t) for _, t in leaf.values()) == 40
    order = sorted(leaf, key=lambda i: (*leaf[i], i))
    assert [p.id for p in built.points.orderBy("pos").collect()] == order
    found = navigate.locate(built, df.select(F.col("id").alias("qid"), "x", "y", "z")).collect()
    assert {r.qid: (r.cube_id, r.leaf_tag) for r in found} == leaf


@pytest.mark.parametrize("shape", [BALL, CUBE])
def test_leaf_search(index, frame, shape):
    strict, loose = set(ids(search.inside(frame.df, shape))), ids(search.in_leaves(index, shape))
    runs = sorted((c.start, c.stop) for c in search.chunks(index, shape).collect())
    assert strict <= set(loose) and len(loose) == len(set(loose))
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))
    place = {p.pos: p.id for p in index.points.collect()}
    assert sorted(place[i] for a, b in runs for i in range(a, b)) == loose
    whole = [place[i] for c in search.chunks(index, shape).filter("partial = 0").collect() for i in range(c.start, c.stop)]
    assert set(whole) <= strict


def test_navigation(index):
    held = {r.cube_id: r.tag for r in navigate.containing(index, (50.0, 50.0, 50.0)).collect()}
    assert 13 in held
    assert navigate.size(index).first()["n"] == len(XYZ)
    assert ids(navigate.children(index, "0", 13), "tag") == sorted(r.tag for r in index.nodes.collect() if r.cube_id == 13 and r.level == 2)
    assert navigate.by_tag(index, "09").count() == 0 and navigate.parent("0") is None


def brute_knn(q, k, upper=math.inf):
    d = sorted((math.sqrt(float(((p - q) ** 2).sum())), i) for i, p in enumerate(XYZ))
    return [(i, v) for v, i in d if v < upper][:k]


def test_knn(spark, frame):
    asked = [(0, 50.0, 50.0, 50.0), (1, 10.0, 20.0, 30.0), (2, -900.0, 0.0, 0.0), (3, 0.0, 0.0, 5000.0)]
    df = spark.createDataFrame(asked, "qid long, x double, y double, z double")
    for k, upper in ((5, None), (60, None), (5, 40.0), (500, None)):
        found = {}
        for r in knn.nearest_batch(df, frame.df, k, upper).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.id, r.dist))
        for qid, *q in asked:
            want = brute_knn(np.array(q), k, upper or math.inf)
            got = sorted(found.get(qid, []))
            assert [g_[1] for g_ in got] == [i for i, _ in want]
            assert [g_[2] for g_ in got] == pytest.approx([v for _, v in want])
    assert [r.id for r in knn.nearest(frame.df, (50, 50, 50), 5).collect()] == [i for i, _ in brute_knn(np.array([50, 50, 50]), 5)]


@pytest.mark.parametrize("p", [1, math.inf])
def test_knn_measures(spark, frame, p):
    asked = [(0, 50.0, 50.0, 50.0), (1, 10.0, 20.0, 30.0), (2, -900.0, 0.0, 4000.0)]
    found = knn.nearest_batch(spark.createDataFrame(asked, "qid long, x double, y double, z double"), frame.df, 7, p=p).collect()
    for qid, *q in asked:
        far = np.abs(XYZ - np.array(q))
        dist = far.sum(axis=1) if p == 1 else far.max(axis=1)
        want = sorted((v, i) for i, v in enumerate(dist))[:7]
        got = sorted((r["rank"], r.id, r.dist) for r in found if r.qid == qid)
        assert [(i, v) for _, i, v in got] == [(i, pytest.approx(v)) for v, i in want]


def moved(spark, run):
    """What a job gives, and the bytes that its tasks shuffle and write."""
    status = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteBytes() + s.outputBytes() for s in (lambda found: [found.apply(i) for i in range(found.size())])(status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = total()
    return run(), total() - before


def test_knn_blocks_on_odd_points(spark, monkeypatch):
    """Small blocks, a point repeated more often than a block is long, a rare type, far and equal queries, ties, null types: as by brute force."""
    for name, value in (("BLOCK", 64), ("BLOCKS", 1 << 20)):
        monkeypatch.setattr(knn, name, value)
    r = np.random.default_rng(5)
    at = np.vstack([r.exponential(5.0, (900, 3)), np.tile([[3.0, 3.0, 3.0]], (700, 1)), r.integers(0, 4, (400, 3)).astype(float), [[1e6, 0.0, 0.0]]])
    kinds = [None if i % 11 == 0 else "rare" if i in (7, 1999) else f"t{i % 2}" for i in range(len(at))]
    points = spark.createDataFrame([(i, kinds[i], *map(float, v)) for i, v in enumerate(at)], "id long, kind string, x double, y double, z double")
    asked = [(int(i), *map(float, at[i])) for i in range(0, len(at), 37)] + [(9000, 3.0, 3.0, 3.0), (9001, -1e7, 5.0, 1e3), (9002, 3.5, 3.0, 3.0)]
    queries_ = spark.createDataFrame(asked, "qid long, x double, y double, z double")
    for k, by, p, upper in ((4, ("kind",), 2, None), (30, (), 2, None), (4, (), 1, 2.0), (900, ("kind",), math.inf, None)):
        found = {}
        for row in knn.nearest_batch(queries_, points, k, upper, by, p).collect():
            found.setdefault((row.qid, row["kind"] if by else 0), []).append((row["rank"], row.id, row.dist))
        want = {}
        for qid, *q in asked:
            d = at - np.array(q)
            dist = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) if p == 2 else np.abs(d[:, 0]) + np.abs(d[:, 1]) + np.abs(d[:, 2]) if p == 1 else np.abs(d).max(axis=1)
            for kind in set(kinds) if by else [0]:
                own = sorted((v, i) for i, v in enumerate(dist) if (not by or kinds[i] == kind) and (upper is None or v < upper))[:k]
                if own:
                    want[qid, kind] = [(rank, i, v) for rank, (v, i) in enumerate(own, 1)]
        assert {key: sorted(v) for key, v in found.items()} == want


def test_knn_moves_points_not_pairs(spark):
    """Queries meet their neighbours within a task: what is shuffled and written grows with the points, not with the pairs looked at."""
    old = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: (spark.conf.get(name, None), spark.conf.set(name, value))[0] for name, value in old.items()}
    try:
        points = spark.range(30_000).select("id", (F.col("id") % 3).cast("string").alias("kind"), *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
        few = points.filter("id % 10 = 0").select(F.col("id").alias("qid"), "x", "y", "z")
        n, size = moved(spark, lambda: knn.nearest_batch(few, points, 3, by=("kind",)).count())
    finally:
        for name, value in old.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    assert n == 27_000 and size < 6e6


def grid(nx, y0, ny):
    return np.array([(x, y) for x in range(nx) for y in range(y0, y0 + ny)], dtype=float)


def test_known_answers(spark):
    tree = PointTree(grid(5, 2, 6), spark=spark)
    rows = lambda df: [(r["rank"], r.id, round(r.dist, 6)) for r in df.orderBy("qid", "rank").collect()]
    x = [[0, 0], [2.2, 2.9]]
    assert rows(tree.query(x, 1)) == [(1, 0, 2.0), (1, 13, 0.223607)]
    assert rows(tree.query(x, [2])) == [(2, 6, 2.236068), (2, 19, 0.806226)]
    assert rows(tree.query(x, 2)) == rows(tree.query(x, [1, 2])) == [(1, 0, 2.0), (2, 6, 2.236068), (1, 13, 0.223607), (2, 19, 0.806226)]
    assert rows(tree.query([[0, 0]], 2, distance_upper_bound=2.1)) == [(1, 0, 2.0), (2, 30, math.inf)]
    balls = PointTree(grid(5, 0, 5), spark=spark)
    assert [r.ids for r in balls.query_ball_point([[2, 0], [3, 3]], 1).orderBy("qid").collect()] == [[5, 10, 11, 15], [13, 17, 18, 19, 23]]


def test_joins(frame):
    near = {(i, j) for i in range(400) for j in range(400) if ((XYZ[i] - XYZ[j]) ** 2).sum() <= 81.0}
    assert {(r.id, r.other_id) for r in joins.ball_tree(frame.df, frame.df, 9.0).collect()} == near
    assert {(r.i, r.j) for r in joins.pairs(frame.df, 9.0).collect()} == {(i, j) for i, j in near if i < j}
    lists = {r.id: r.others for r in joins.ball_tree(frame.df, frame.df, 9.0, True).collect()}
    assert lists[1000] == [] and lists[399] == sorted(j for i, j in near if i == 399)
    counts = [r.n for r in joins.count_neighbors(frame.df, frame.df, (4.5, 9.0)).orderBy("r").collect()]
    assert counts[1] == len(near)
    assert [r.n for r in joins.count_neighbors(frame.df, frame.df, (4.5, 9.0), cumulative=False).orderBy("r").collect()] == [counts[0], counts[1] - counts[0]]
    plan = joins.pairs(frame.df, 9.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_counts(a, wa, b, wb, radii, cumulative):
    dx, dy, dz = (a[:, None, c] - b[None, :, c] for c in range(3))
    d2, product = dx * dx + dy * dy + dz * dz, wa[:, None] * wb[None, :]
    sums = [product[d2 <= r * r].sum() for r in radii]
    return sums if cumulative else np.diff([0.0, *sums]).tolist()


def test_counts_by_blocks(spark, monkeypatch):
    """Blocks and units of a few points, distances on the radii, equal and odd points, weights with nulls: as by brute force."""
    monkeypatch.setattr(joins, "COUNT_BLOCK", 40)
    monkeypatch.setattr(joins, "UNIT", 4000)
    r = np.random.default_rng(8)
    a = np.vstack([np.round(r.normal(0, 2, (500, 3)), 1), r.integers(0, 6, (300, 3)), np.full((60, 3), 1.5)])
    b = np.vstack([r.normal(0, 2, (300, 3)), r.integers(-2, 4, (300, 3)), [[1e9, 0, 0]]])
    wa, wb = r.integers(-2, 5, len(a)).astype(float), r.integers(0, 3, len(b)).astype(float)
    frames = [spark.createDataFrame([(i, *map(float, v), None if w == 0 else float(w)) for i, (v, w) in enumerate(zip(p, ws, strict=True))] + [(5000, None, 0.0, 0.0, 1.0), (5001, math.nan, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, w double") for p, ws in ((a, wa), (b, wb))]
    radii = (0.5, 1.0, 2.0, 3.0)
    for cumulative in (True, False):
        for weights, sums in ((("w", "w"), (wa, wb)), ((None, None), (np.ones(len(a)), np.ones(len(b))))):
            found = joins.count_neighbors(*frames, radii, *weights, cumulative).orderBy("r").collect()
            assert [(x.r, x.n) for x in found] == list(zip(radii, brute_counts(a, sums[0], b, sums[1], radii, cumulative), strict=True))
    assert [x.n for x in joins.count_neighbors(frames[0], frames[1].filter("false"), radii).collect()] == [0.0] * 4


def test_count_of_a_crowd(spark):
    """60,000 points that are all within a radius are counted without meeting each other."""
    points = spark.range(60_000).select("id", *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
    status = spark.sparkContext._jsc.sc().statusStore()
    seconds = lambda: sum(s.executorRunTime() for s in (lambda found: [found.apply(i) for i in range(found.size())])(status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))) / 1e3
    before = seconds()
    assert [x.n for x in joins.count_neighbors(points, points, (1e-9, 10.0)).orderBy("r").collect()] == [60_000.0, 60_000.0**2]
    assert seconds() - before < 60


def test_saving(spark, frame, index, tmp_path):
    path = f"{tmp_path}/p"
    clean = PointFrame(frame.df.filter(g.finite()), frame.bounding_box())
    clean.save(path)
    back = store.read_points(spark, path)
    assert back.box == clean.box and ids(back.df) == ids(clean.df) and set(back.fields) == {"f"}
    with pytest.raises(FileExistsError):
        clean.save(path)
    clean.save(path, overwrite=True, fields=None, particle_types=["B"])
    assert store.read_points(spark, path).types() == ["B"]
    with pytest.raises(ValueError):
        store.read_index(spark, path)
    first = store.write_index(index, f"{tmp_path}/i")
    assert store.write_index(index, first) == f"{first}_cubes" and store.has_index(spark, first)
    again = store.read_index(spark, first)
    assert ids(search.in_leaves(again, BALL)) == ids(search.in_leaves(index, BALL))


def test_packed_form(index):
    rows = {r.cube_id: bytes(r.packed) for r in pack_index(index).collect()}
    nodes = [n.asDict() for n in index.nodes.filter("cube_id = 13").orderBy("tag").collect()]
    meta, back = unpack(rows[13])
    assert [(b["tag"], b["n"]) for b in back] == [(n["tag"], n["n"]) for n in nodes] and meta["threshold"] == 20
    assert pack(nodes, 20, created=0.0) == pack(nodes, 20, created=0.0)
    with pytest.raises(ValueError):
        unpack(rows[13][:-4] + b"\1\2\3\4")


def test_sources(spark, frame):
    assert uniform(spark, 100).df.filter("x >= 0 AND x < 1000").count() == 100
    assert blobs(spark, 500).df.filter("x BETWEEN 0 AND 100").count() == 500
    assert frame.slices({"A": [(0, 10)], "B": [(0, 4)]}).df.count() == len([i for i in range(10) if i % 3]) + 2
    assert frame.attach(spark.createDataFrame([(1, 5)], "id long, extra int")).df.filter("extra = 5").count() == 1
    with pytest.raises(ValueError):
        PointFrame.of(np.zeros((3, 4)), spark)
    assert sorted(r.pos for r in frame.reorder("f", "id").collect()) == list(range(403))


def test_command_line(spark, frame, tmp_path):
    frame.df.filter(g.finite()).write.parquet(f"{tmp_path}/raw.parquet")
    out = cli.main([f"{tmp_path}/raw.parquet", f"{tmp_path}/out", "-n", "3", "-p", "50", "--depth", "4"], spark)
    assert store.read_index(spark, out, ["A"]).points.count() == len([i for i in range(400) if i % 3])
    with pytest.raises(SystemExit):
        cli.main([f"{tmp_path}/raw.parquet", f"{tmp_path}/out"], spark)


def test_log_profile(spark):
    values = np.random.default_rng(3).random(3000) * 50 + 0.01
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(values)] + [(0.0, 1.0)], "r double, t double")
    found = {r.bin: r for r in log_profile(df, F.col("r"), F.col("t"), least=20).collect()}
    logs, t = np.log10(values), np.arange(3000) % 7
    at = np.digitize(logs, np.histogram_bin_edges(logs, bins=15))
    for i in range(15):
        own = t[at == i]
        assert found[i].n == len(own) and found[i].mean == pytest.approx(own.mean() if len(own) > 20 else 0.0)
    assert sorted(found) == list(range(15)) and log_profile(df.limit(0), F.col("r"), F.col("t")).count() == 15


def test_command_line_options(tmp_path):
    (tmp_path / "some.txt").write_text("-p\n100\n-n\n5\n")
    args = cli.parse(["-t", "0", "Gas", "-x", "1.5", "-n", "4", "-c", f"{tmp_path}/some.txt", "--", "snap", "out"])
    assert (args.particle_threshold, args.side_length, args.particle_types, args.x, args.snapshot, args.output) == (100, 4, ["PartType0", "Gas"], 1.5, "snap", "out")
    assert cli.parse(["snap", "-v"]).verbose and cli.parse(["snap"]).particle_threshold == 400


def test_stream(spark, frame, tmp_path):
    frame.df.write.parquet(f"{tmp_path}/in")
    stream = stream_inside(spark.readStream.schema(frame.df.schema).parquet(f"{tmp_path}/in"), BALL)
    q = stream.writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert set(ids(spark.table("near"))) == in_ball()


def test_hdf5_says_what_it_needs():
    source = importlib.import_module("pointspan.sources.hdf5")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            source.open_file("x")


@pytest.mark.parametrize("name", ["sphere_strict_ids", "full_morton", "node_table", "leaf_partition", "sphere_chunks", "knn_batch", "query_pairs", "radial_profile"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    rows = lambda df: sorted(map(repr, (tuple(float(v) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df[columns].itertuples(index=False))))
    assert rows(ours) == rows(theirs)
