"""Queries of the point engine over the driver's tables, and their SQL.

Point sets: ``ev`` (events), ``emb`` (three components of embeddings), ``li``
and ``dup`` (line items; dup has many equal points) and ``ord`` (orders, flat).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspan import oracle as sql
from pointspan.functions import geometry as g
from pointspan.functions.profiles import log_profile
from pointspan.operators import joins, knn, navigate, search
from pointspan.plans.index import Index, all_cube_boxes, build_index, cube_of
from pointspan.shared import table
from pointspan.sources.points import ID, TYPE, PointFrame, auto_box, inverse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BOX_A = g.Box(50.0, 20.0, 100.0, 150.0, 60.0, 300.0)
SPH_A = g.Sphere(150.0, 75.0, 360.0, 97.3)
SPH_OUT = g.Sphere(700.0, 75.0, 360.0, 600.7)
SPH_NONE = g.Sphere(5000.0, 5000.0, 5000.0, 1.5)
SPH_ALL = g.Sphere(245.0, 75.0, 360.0, 5000.0)
BOX_E = g.Box(-0.1, -0.1, -0.1, 0.2, 0.2, 0.2)
GRID = g.Box(0.0, 0.0, 0.0, 500.0, 150.0, 720.0)
SIDE, DEPTH = sql.SIDE, sql.DEPTH
RADII = (0.02, 0.035, 0.05)


def events(spark: SparkSession, sf_dir: str) -> PointFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(3.6e9)
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias(ID), F.col("event_type").alias(TYPE), F.col("value").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), hours.alias("z"), F.col("props").alias("props"))
    return PointFrame(df, name="events")


def embeddings(spark: SparkSession, sf_dir: str) -> PointFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ID), F.col("label").cast("string").alias(TYPE), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    return PointFrame(df, name="embeddings")


def lineitems(spark: SparkSession, sf_dir: str, flat: bool = False) -> PointFrame:
    """Line items have no single key; the id packs the four columns that make one."""
    names = ("l_quantity", "l_discount", "l_tax") if flat else ("l_quantity", "l_extendedprice", "l_discount")
    key = ((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * 32768 + F.col("l_partkey")) * 2048 + F.col("l_suppkey")
    df = table(spark, sf_dir, "lineitem").select(key.alias(ID), F.col("l_returnflag").alias(TYPE), *[F.col(c).cast("double").alias(a) for c, a in zip(names, g.AXES, strict=True)])
    return PointFrame(df, name="flat" if flat else "lineitem")


def orders(spark: SparkSession, sf_dir: str) -> PointFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ID), F.col("o_orderstatus").alias(TYPE), F.col("o_totalprice").cast("double").alias("x"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return PointFrame(df, name="orders")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of batch searches: every row whose id is divisible by 50."""
    return events(spark, sf_dir).df.filter("id % 50 = 0").select(F.col(ID).alias("qid"), *g.AXES)


def balls(spark: SparkSession) -> DataFrame:
    """Three balls: in the box, out of it in part, and away from it."""
    rows = [(i, b.cx, b.cy, b.cz, b.r) for i, b in enumerate((SPH_A, SPH_OUT, SPH_NONE))]
    return spark.createDataFrame(rows, "qid long, x double, y double, z double, r double")


def query(name: str, oracle: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def xyz():
    return [F.col(a) for a in g.AXES]


# Geometry

query("box_contains", f"SELECT id, coalesce({sql.in_box(BOX_A)}, false) AS inside FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, BOX_A.contains(*xyz()).alias("inside")))
query("sphere_contains", f"SELECT id, coalesce({sql.in_sphere(SPH_A)}, false) AS inside FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, SPH_A.within(*xyz()).alias("inside")))
query("count_inside_box", f"SELECT count(*) AS n FROM ({sql.EV}) WHERE {sql.in_box(BOX_A)}")(lambda s, d: search.count_inside(events(s, d).df, BOX_A))
query("count_inside_sphere", f"SELECT count(*) AS n FROM ({sql.EV}) WHERE {sql.in_sphere(SPH_OUT)}")(lambda s, d: search.count_inside(events(s, d).df, SPH_OUT))
query("octant_code", f"SELECT id, {sql.octant('x', 'y', 'z', *map(repr, GRID.midplane()))} AS octant FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, g.octant(*xyz(), *map(F.lit, GRID.midplane())).alias("octant")))
query("first_octant", f"SELECT id, {sql.octant('x', 'y', 'z', *map(repr, GRID.midplane()))} - 1 AS octant FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, (g.octant(*xyz(), *map(F.lit, GRID.midplane())) - 1).alias("octant")))
query("full_morton", sql.morton(GRID))(lambda s, d: events(s, d).df.select(ID, g.morton(GRID.columns(), *xyz()).alias("morton")))
query("normalize_to_box", f"SELECT id, {', '.join(f'least(greatest(({a} - {p!r}) / {q!r}, 0.0), 1.0) AS n{a}' for a, p, q in zip('xyz', BOX_A.values()[:3], BOX_A.values()[3:], strict=True))} FROM ({sql.EV})")(
    lambda s, d: events(s, d).df.select(ID, *[c.alias(f"n{a}") for a, c in zip(g.AXES, g.normalize(BOX_A.columns(), *xyz()), strict=True)])
)
query("project_point_on_box", f"SELECT id, {', '.join(f'least(greatest({a}, {p!r}), {p + q!r}) AS p{a}' for a, p, q in zip('xyz', BOX_A.values()[:3], BOX_A.values()[3:], strict=True))} FROM ({sql.EV})")(
    lambda s, d: events(s, d).df.select(ID, *[c.alias(f"p{a}") for a, c in zip(g.AXES, g.project(BOX_A.columns(), *xyz()), strict=True)])
)


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of its own around every event."""
    return events(spark, sf_dir).df.select(ID, (F.col("x") - 20.0).alias("ox"), (F.col("y") - 10.0).alias("oy"), (F.col("z") - 30.0).alias("oz"), F.lit(40.0).alias("odx"), F.lit(25.0).alias("ody"), F.lit(60.0).alias("odz"))


def boxed(box: g.BoxColumns, corner: str, size: str | None = None) -> list:
    """A box's columns under names of their own."""
    low = [c.alias(f"{corner}{a}") for a, c in zip(g.AXES, box.corner(), strict=True)]
    return low + ([c.alias(f"{size}{a}") for a, c in zip(g.AXES, box.size(), strict=True)] if size else [])


BOXES = f"SELECT id, x - 20.0 AS ox, y - 10.0 AS oy, z - 30.0 AS oz, 40.0::DOUBLE AS odx, 25.0::DOUBLE AS ody, 60.0::DOUBLE AS odz FROM ({sql.EV})"


@query("clip_boxes", sql.clip(BOXES, BOX_A))
def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, size, ok = g.clip(g.BoxColumns.named(), BOX_A.columns())
    return small_boxes(spark, sf_dir).filter(ok).select(ID, *[c.alias(f"c{a}") for a, c in zip(g.AXES, low, strict=True)], *[c.alias(f"cd{a}") for a, c in zip(g.AXES, size, strict=True)])


@query("child_boxes", f"SELECT id, k AS octant, {', '.join(f'o{a} + ((k // {2**i}) % 2) * (od{a} / 2) AS c{a}, od{a} / 2 AS cd{a}' for i, a in enumerate('xyz'))} FROM ({BOXES}), (SELECT unnest(range(8)) AS k) AS o")
def child_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = small_boxes(spark, sf_dir).withColumn("octant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return df.select(ID, "octant", *boxed(g.BoxColumns.named().child(F.col("octant")), "c", "cd"))


@query("neighbor_boxes", f"SELECT id, k AS place, {', '.join(f'o{a} + ((k // {3**i}) % 3 - 1) * od{a} AS n{a}' for i, a in enumerate('xyz'))} FROM ({BOXES}), (SELECT unnest(range(27)) AS k) AS o WHERE k <> 13")
def neighbor_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = small_boxes(spark, sf_dir).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long")))).filter("place <> 13")
    return df.select(ID, "place", *boxed(g.BoxColumns.named().neighbor(F.col("place")), "n"))


@query("box_vertices", f"SELECT id, k + 1 AS vertex, {', '.join(f'CASE WHEN (k // {2**i}) % 2 = 1 THEN o{a} + od{a} ELSE o{a} END AS v{a}' for i, a in enumerate('xyz'))} FROM ({BOXES}), (SELECT unnest(range(8)) AS k) AS o")
def box_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = small_boxes(spark, sf_dir).select(ID, F.posexplode(g.vertices_array(g.BoxColumns.named())).alias("k", "v"))
    return df.select(ID, (F.col("k") + 1).cast("long").alias("vertex"), *[F.col("v")[a].alias(f"v{a}") for a in g.AXES])


query("box_center", f"SELECT id, {', '.join(f'o{a} + od{a} / 2 AS m{a}' for a in 'xyz')} FROM ({BOXES})")(lambda s, d: small_boxes(s, d).select(ID, *[c.alias(f"m{a}") for a, c in zip(g.AXES, g.BoxColumns.named().center(), strict=True)]))
query("sphere_to_box", f"SELECT id, x - 5.5 AS ox, y - 5.5 AS oy, z - 5.5 AS oz, 11.0::DOUBLE AS odx, 11.0::DOUBLE AS ody, 11.0::DOUBLE AS odz FROM ({sql.EV})")(
    lambda s, d: events(s, d).df.select(ID, *boxed(g.BoxColumns.around(*xyz(), F.lit(5.5)), "o", "od"))
)
query("euclidean_distance", f"SELECT id, sqrt({sql.d2('x', 'y', 'z', '150.0', '75.0', '360.0')}) AS dist FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, g.distance(*xyz(), F.lit(150.0), F.lit(75.0), F.lit(360.0)).alias("dist")))
query("dataset_bounding_box", sql.auto_box(sql.EV))(lambda s, d: events(s, d).df.agg(*auto_box()))
query("box_box_overlap", f"SELECT id, {sql.box_code(BOX_A)} AS code FROM ({BOXES})")(lambda s, d: small_boxes(s, d).select(ID, BOX_A.overlap(g.BoxColumns.named()).alias("code")))
query("sphere_box_overlap", f"SELECT id, {sql.sphere_code(SPH_A)} AS code FROM ({BOXES})")(lambda s, d: small_boxes(s, d).select(ID, SPH_A.overlap(g.BoxColumns.named()).alias("code")))


@query("box_validity", f"SELECT id, {' AND '.join(f'isfinite(o{a}) AND isfinite(od{a}) AND od{a} > 0 AND od{a} >= greatest(abs(o{a}) + od{a}, 1.0) * {g.EPS64!r}' for a in 'xyz')} AS valid FROM (SELECT id, ox, oy, oz, odx - (id % 50) AS odx, ody, CASE WHEN id % 20 = 0 THEN 1e-20 ELSE odz END AS odz FROM ({BOXES}))")
def box_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = small_boxes(spark, sf_dir).withColumn("odx", F.col("odx") - F.col(ID) % 50).withColumn("odz", F.when(F.col(ID) % 20 == 0, 1e-20).otherwise(F.col("odz")))
    return df.select(ID, g.box_valid(g.BoxColumns.named()).alias("valid"))


# Index


BUILT: dict[tuple, Index] = {}


def make(frame: PointFrame, threshold: int, box: g.Box | None = None, by_type: bool = False) -> Index:
    """An index of a point set, built once in a session and written to the shared folder, as a saved index is used again."""
    spark = frame.df.sparkSession
    key = (spark.sparkContext.applicationId, tuple(frame.df.inputFiles()), frame.name, tuple(map(str, frame.df.schema)), threshold, box, by_type)
    if key not in BUILT:
        BUILT[key] = build_index(frame, SIDE, threshold, DEPTH, box, by_type)
    return BUILT[key]


query("cube_assign", f"SELECT id, {sql.cube(GRID)} AS cube_id FROM ({sql.EV})")(lambda s, d: events(s, d).df.select(ID, cube_of(GRID, SIDE, *xyz()).cast("long").alias("cube_id")))
query("cube_offsets", f"WITH c AS (SELECT {sql.cube(GRID)} AS cube_id, count(*) AS n FROM ({sql.EV}) GROUP BY 1) SELECT cube_id, n, CAST(sum(n) OVER (ORDER BY cube_id) - n AS BIGINT) AS start FROM c")(lambda s, d: make(events(s, d), 50, GRID).cubes.select(F.col("cube_id").cast("long"), "n", "start"))
query("cube_boxes", sql.cube_boxes(GRID))(lambda s, d: all_cube_boxes(events(s, d).df, GRID, SIDE).withColumn("cube_id", F.col("cube_id").cast("long")))
query("octant_counts", f"SELECT {sql.octant('x', 'y', 'z', *map(repr, GRID.midplane()))} AS octant, count(*) AS n FROM ({sql.EV}) GROUP BY 1")(lambda s, d: events(s, d).df.groupBy(g.octant(*xyz(), *map(F.lit, GRID.midplane())).alias("octant")).agg(F.count("*").alias("n")))

NODE = ("cube_id", "tag", "level", "n", "start", "stop", "is_leaf", "ox", "oy", "oz", "odx", "ody", "odz")
node_columns = lambda df: df.select(F.col("cube_id").cast("long"), "tag", F.col("level").cast("long"), "n", "start", "stop", "is_leaf", *NODE[7:])

query("node_table", sql.index(sql.EV, GRID, 50, f"SELECT {', '.join(NODE)} FROM nodes"))(lambda s, d: node_columns(make(events(s, d), 50, GRID).nodes))
query("node_table_lineitem", sql.index(sql.LI, g.Box(0.0, 900.0, 0.0, 51.0, 105000.0, 0.11), 50, f"SELECT {', '.join(NODE)} FROM nodes"))(lambda s, d: node_columns(make(lineitems(s, d), 50, g.Box(0.0, 900.0, 0.0, 51.0, 105000.0, 0.11)).nodes))
query("node_table_duplicates", sql.index(sql.DUP, g.Box(0.0, 0.0, 0.0, 51.0, 0.11, 0.09), 20, f"SELECT {', '.join(NODE)} FROM nodes"))(lambda s, d: node_columns(make(lineitems(s, d, True), 20, g.Box(0.0, 0.0, 0.0, 51.0, 0.11, 0.09)).nodes))
query("leaf_partition", sql.index(sql.EV, GRID, 50, "SELECT id, cube_id, leaf_tag, pos FROM placed"))(lambda s, d: make(events(s, d), 50, GRID).points.select(ID, F.col("cube_id").cast("long"), "leaf_tag", "pos"))
query("leaf_fill_histogram", sql.index(sql.EV, GRID, 50, "SELECT n, count(*) AS leaves FROM nodes WHERE is_leaf GROUP BY 1"))(lambda s, d: navigate.leaf_fill(make(events(s, d), 50, GRID)))
query("tree_size", f"SELECT count(*) AS n FROM ({sql.EV})")(lambda s, d: navigate.size(make(events(s, d), 50, GRID)))
query("leaves_by_level", sql.index(sql.EV, GRID, 50, "SELECT level, count(*) AS leaves FROM nodes WHERE is_leaf GROUP BY 1"))(lambda s, d: make(events(s, d), 50, GRID).leaves.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("leaves")))
query("node_by_tag", sql.index(sql.EV, GRID, 50, "SELECT cube_id, n, start, stop FROM nodes WHERE tag = '03'"))(lambda s, d: navigate.by_tag(make(events(s, d), 50, GRID), "03").select(F.col("cube_id").cast("long"), "n", "start", "stop"))
query("node_children", sql.index(sql.EV, GRID, 50, "SELECT tag, n FROM nodes WHERE cube_id = 13 AND length(tag) = 2"))(lambda s, d: navigate.children(make(events(s, d), 50, GRID), "0", 13).select("tag", "n"))
query("containing_node", sql.index(sql.EV, GRID, 50, "SELECT cube_id, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY cube_id ORDER BY level DESC, tag DESC) AS r FROM nodes WHERE 170.5 BETWEEN ox AND ox + odx AND 60.25 BETWEEN oy AND oy + ody AND 250.5 BETWEEN oz AND oz + odz) WHERE r = 1"))(lambda s, d: navigate.containing(make(events(s, d), 50, GRID), (170.5, 60.25, 250.5)).select(F.col("cube_id").cast("long"), "tag", "n"))
query("locate_points", sql.index(sql.EV, GRID, 50, "SELECT id AS qid, cube_id, leaf_tag FROM placed WHERE id % 50 = 0"))(
    lambda s, d: navigate.locate(make(events(s, d), 50, GRID), asked(s, d)).select("qid", F.col("cube_id").cast("long"), "leaf_tag")
)
query("index_by_type", sql.index(sql.EV, GRID, 50, "SELECT ptype AS particle_type, cube_id, tag, n, start FROM nodes", True))(lambda s, d: make(events(s, d), 50, GRID, True).nodes.select(TYPE, F.col("cube_id").cast("long"), "tag", "n", "start"))
query("sort_index", sql.index(sql.EV, GRID, 50, "SELECT pos, id FROM placed"))(lambda s, d: make(events(s, d), 50, GRID).points.select("pos", ID))
query("reorder_by_x", f"SELECT id, CAST(row_number() OVER (ORDER BY x, id) - 1 AS BIGINT) AS pos FROM ({sql.EV})")(lambda s, d: events(s, d).reorder("x", ID).select(ID, F.col("pos").cast("long")))
query("invert_index", f"SELECT id AS pos, CAST(row_number() OVER (ORDER BY x, id) - 1 AS BIGINT) AS value FROM ({sql.EV})")(
    lambda s, d: inverse(events(s, d).reorder("x", ID).select(F.col("pos").cast("long"), F.col(ID).alias("value")))
)

# Range search

ids = lambda df: df.select(ID)
for name, shape, test in (("sphere", SPH_A, sql.in_sphere(SPH_A)), ("box", BOX_A, sql.in_box(BOX_A)), ("sphere_outside", SPH_OUT, sql.in_sphere(SPH_OUT)), ("sphere_empty", SPH_NONE, sql.in_sphere(SPH_NONE)), ("sphere_everything", SPH_ALL, sql.in_sphere(SPH_ALL))):
    query(f"{name}_strict_ids", f"SELECT id FROM ({sql.EV}) WHERE {test}")(lambda s, d, shape=shape: ids(search.inside(events(s, d).df, shape)))
for name, shape, code in (("sphere", SPH_A, sql.sphere_code(SPH_A)), ("box", BOX_A, sql.box_code(BOX_A))):
    leaf = f"WITH hit AS (SELECT cube_id, tag, {code} AS code FROM nodes WHERE is_leaf) SELECT p.id, CAST(h.code < 8 AS INTEGER) AS partial FROM placed AS p JOIN hit AS h ON p.cube_id = h.cube_id AND p.leaf_tag = h.tag WHERE h.code > 0"
    query(f"{name}_nonstrict_ids", sql.index(sql.EV, GRID, 50, leaf))(lambda s, d, shape=shape: search.in_leaves(make(events(s, d), 50, GRID), shape).select(ID, "partial"))
    run = f"SELECT h.cube_id, h.tag, h.start, h.stop, CAST(h.code < 8 AS INTEGER) AS partial FROM (SELECT *, {code} AS code FROM nodes) AS h LEFT JOIN (SELECT cube_id, tag, {code} AS code FROM nodes) AS u ON u.cube_id = h.cube_id AND u.tag = substr(h.tag, 1, length(h.tag) - 1) WHERE h.code > 0 AND (h.code = 8 OR h.is_leaf) AND coalesce(u.code, 0) < 8"
    query(f"{name}_chunks", sql.index(sql.EV, GRID, 50, run))(lambda s, d, shape=shape: search.chunks(make(events(s, d), 50, GRID), shape).withColumn("cube_id", F.col("cube_id").cast("long")))
    query(f"{name}_chunk_rows", sql.index(sql.EV, GRID, 50, f"WITH hit AS (SELECT cube_id, tag, {code} AS code FROM nodes WHERE is_leaf) SELECT p.pos FROM placed AS p JOIN hit AS h ON p.cube_id = h.cube_id AND p.leaf_tag = h.tag WHERE h.code > 0"))(lambda s, d, shape=shape: search.expand(search.chunks(make(events(s, d), 50, GRID), shape)))
    strict = sql.in_sphere(shape) if name == "sphere" else sql.in_box(shape)
    query(f"{name}_indexed_ids", sql.index(sql.EV, GRID, 50, f"SELECT p.id, p.pos FROM placed AS p JOIN ({sql.EV}) AS e ON e.id = p.id WHERE {strict}"))(
        lambda s, d, shape=shape: search.inside_indexed(make(events(s, d), 50, GRID), shape).select(ID, "pos")
    )
query("masked_cubes_range", sql.index(sql.EV, GRID, 50, f"WITH hit AS (SELECT cube_id, tag, {sql.sphere_code(SPH_A)} AS code FROM nodes WHERE is_leaf AND cube_id IN (4, 12, 13, 14)) SELECT p.id FROM placed AS p JOIN hit AS h ON p.cube_id = h.cube_id AND p.leaf_tag = h.tag WHERE h.code > 0"))(lambda s, d: ids(search.in_leaves(make(events(s, d), 50, GRID), SPH_A, (4, 12, 13, 14))))
query("sphere_subset_fields", f"SELECT id, x, y, z, props FROM ({sql.EV}) WHERE {sql.in_sphere(SPH_A)}")(lambda s, d: search.subset(events(s, d), SPH_A, "props").df)
query("box_subset_all_fields", f"SELECT id, x, y, z, props FROM ({sql.EV}) WHERE {sql.in_box(BOX_A)}")(lambda s, d: search.subset(events(s, d), BOX_A, "all").df)
query("box_embeddings", f"SELECT id, x, y, z FROM ({sql.EMB}) WHERE {sql.in_box(BOX_E)}")(lambda s, d: search.subset(embeddings(s, d), BOX_E).df)
query("circle_orders", f"SELECT id FROM ({sql.ORD}) WHERE {sql.in_sphere(g.Sphere(150000.0, 9500.0, 0.0, 2000.3))}")(lambda s, d: ids(search.inside(orders(s, d).df, g.Sphere(150000.0, 9500.0, 0.0, 2000.3))))
query("range_by_type", f"SELECT ptype AS particle_type, count(*) AS n FROM ({sql.EV}) WHERE {sql.in_sphere(SPH_A)} GROUP BY 1")(lambda s, d: search.inside(events(s, d).df, SPH_A).groupBy(TYPE).agg(F.count("*").alias("n")))
query("ball_point_batch", f"SELECT q.id AS qid, p.id FROM ({sql.EV}) AS q, ({sql.EV}) AS p WHERE q.id % 50 = 0 AND {sql.pair_d2('q', 'p')} <= {40.3 * 40.3!r}")(lambda s, d: search.ball_point(asked(s, d), events(s, d).df, 40.3))
query("ball_point_lengths", sql.index(sql.EV, GRID, 50, " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS qid, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM nodes WHERE is_leaf AND {sql.sphere_code(s_)} > 0" for i, s_ in enumerate((SPH_A, SPH_OUT, SPH_NONE)))))(lambda s, d: search.ball_lengths(make(events(s, d), 50, GRID), balls(s)))
query(
    "balls_nonstrict_batch",
    sql.index(sql.EV, GRID, 50, f"SELECT q.id AS qid, CAST(sum(n) AS BIGINT) AS n FROM ({sql.EV}) AS q, nodes WHERE q.id % 50 = 0 AND is_leaf AND {' + '.join(f'pow(greatest(o{a} - q.{a}, 0, q.{a} - (o{a} + od{a})), 2)' for a in 'xyz')} <= {40.3 * 40.3!r} GROUP BY 1"),
)(lambda s, d: search.balls_nonstrict(make(events(s, d), 50, GRID), asked(s, d).withColumn("r", F.lit(40.3))).groupBy("qid").agg(F.count("*").alias("n")))

# Nearest neighbours

C = (151.3, 74.6, 361.9)
CENTER = sql.d2("x", "y", "z", *map(repr, C))
query("knn_single", f"SELECT row_number() OVER (ORDER BY dist, id) AS rank, id, dist FROM (SELECT id, sqrt({CENTER}) AS dist FROM ({sql.EV})) ORDER BY dist, id LIMIT 10")(lambda s, d: knn.nearest(events(s, d).df, C, 10))
query("knn_upper_bound", f"SELECT row_number() OVER (ORDER BY dist, id) AS rank, id, dist FROM (SELECT id, sqrt({CENTER}) AS dist FROM ({sql.EV})) WHERE dist < 20.5 ORDER BY dist, id LIMIT 100")(lambda s, d: knn.nearest(events(s, d).df, C, 100, 20.5))
query("knn_manhattan", f"SELECT row_number() OVER (ORDER BY dist, id) AS rank, id, dist FROM (SELECT id, abs({C[0]!r} - x) + abs({C[1]!r} - y) + abs({C[2]!r} - z) AS dist FROM ({sql.EV})) ORDER BY dist, id LIMIT 10")(lambda s, d: knn.nearest(events(s, d).df, C, 10, p=1))
BATCH = f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid{{by}} ORDER BY dist, id) AS rank FROM (SELECT q.id AS qid, p.id, p.ptype, sqrt({sql.pair_d2('q', 'p')}) AS dist FROM ({sql.EV}) AS q, ({sql.EV}) AS p WHERE q.id % 50 = 0))"
query("knn_batch", BATCH.format(by="") + " WHERE rank <= 10")(lambda s, d: knn.nearest_batch(asked(s, d), events(s, d).df, 10))
DIFF = [f"abs(q.{a} - p.{a})" for a in g.AXES]
for name, p, measure in (("manhattan", 1, " + ".join(DIFF)), ("maximum", knn.FAR, f"greatest({', '.join(DIFF)})")):
    query(f"knn_batch_{name}", BATCH.format(by="").replace(f"sqrt({sql.pair_d2('q', 'p')})", measure) + " WHERE rank <= 4")(lambda s, d, p=p: knn.nearest_batch(asked(s, d), events(s, d).df, 4, p=p))
query("knn_kth_ranks", BATCH.format(by="") + " WHERE rank IN (2, 5)")(lambda s, d: knn.ranks(knn.nearest_batch(asked(s, d), events(s, d).df, 5), asked(s, d), (2, 5), 0))
query("knn_by_type", BATCH.format(by=", ptype").replace("SELECT qid,", "SELECT ptype AS particle_type, qid,") + " WHERE rank <= 3")(lambda s, d: knn.nearest_batch(asked(s, d), events(s, d).df, 3, by=(TYPE,)))
query("nearest_one", f"SELECT id, sqrt({CENTER}) AS dist FROM ({sql.EV}) ORDER BY {CENTER}, id LIMIT 1")(lambda s, d: knn.nearest_one(events(s, d).df, C))
query("nearest_cube", sql.nearest_cube(GRID, (720.5, 80.25, 300.5)))(lambda s, d: knn.nearest_cube(make(events(s, d), 50, GRID), (720.5, 80.25, 300.5)).withColumn("cube_id", F.col("cube_id").cast("long")))
query("radius_for_m", f"SELECT max(dist) AS radius FROM (SELECT sqrt({CENTER}) AS dist FROM ({sql.EV}) ORDER BY 1 LIMIT 100)")(lambda s, d: knn.radius_for(events(s, d).df, C, 100))

# Joins

TYPES = "a.ptype < b.ptype"
NEAR = f"FROM ({sql.EMB}) AS a, ({sql.EMB}) AS b WHERE {sql.pair_d2('a', 'b')} <= {0.05 * 0.05!r}"
query("ball_tree_pairs", f"SELECT a.id, b.id AS other_id {NEAR}")(lambda s, d: joins.ball_tree(embeddings(s, d).df, embeddings(s, d).df, 0.05))
query("ball_tree_lists", f"SELECT a.id, CAST(count(*) AS BIGINT) AS n, CAST(sum(b.id) AS BIGINT) AS total {NEAR} GROUP BY 1")(lambda s, d: joins.ball_tree(embeddings(s, d).df, embeddings(s, d).df, 0.05, True).select(ID, F.size("others").cast("long").alias("n"), F.aggregate("others", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))
query("query_pairs", f"SELECT a.id AS i, b.id AS j {NEAR} AND a.id < b.id")(lambda s, d: joins.pairs(embeddings(s, d).df, 0.05))
COUNT = lambda value, test: " UNION ALL ".join(f"SELECT CAST({r!r} AS DOUBLE) AS r, round(coalesce(sum({value}), 0), 6) AS n FROM ({sql.EMB}) AS a, ({sql.EMB}) AS b WHERE {test(i, r)}" for i, r in enumerate(RADII))
upto = lambda i, r: f"{sql.pair_d2('a', 'b')} <= {r * r!r}"
within = lambda i, r: upto(i, r) + (f" AND {sql.pair_d2('a', 'b')} > {RADII[i - 1] ** 2!r}" if i else "")
rounded = lambda df: df.withColumn("n", F.round("n", 6))
query("count_neighbors_multi_r", COUNT("1.0::DOUBLE", upto))(lambda s, d: rounded(joins.count_neighbors(embeddings(s, d).df, embeddings(s, d).df, RADII)))
query("count_neighbors_binned", COUNT("1.0::DOUBLE", within))(lambda s, d: rounded(joins.count_neighbors(embeddings(s, d).df, embeddings(s, d).df, RADII, cumulative=False)))
query("count_neighbors_weighted", COUNT("CAST((a.id % 3) * (b.id % 5) AS DOUBLE)", upto))(lambda s, d: rounded(joins.count_neighbors(embeddings(s, d).df.withColumn("wa", F.col(ID) % 3), embeddings(s, d).df.withColumn("wb", F.col(ID) % 5), RADII, "wa", "wb")))
query("sparse_distance_matrix", f"SELECT a.id AS i, b.id AS j, sqrt({sql.pair_d2('a', 'b')}) AS v {NEAR}")(lambda s, d: joins.distance_matrix(embeddings(s, d).df, embeddings(s, d).df, 0.05))
query("attach_field", f"SELECT e.id, e.x, f.v FROM ({sql.EV}) AS e LEFT JOIN (SELECT id, y * 2 AS v FROM ({sql.EV}) WHERE id % 2 = 0) AS f ON e.id = f.id")(lambda s, d: events(s, d).attach(events(s, d).df.filter("id % 2 = 0").select(ID, (F.col("y") * 2).alias("v")), "v").df.select(ID, "x", "v"))
query("leaf_chunk_join", sql.index(sql.EV, GRID, 400, "SELECT a.cube_id AS cube_a, a.tag AS tag_a, b.cube_id AS cube_b, b.tag AS tag_b FROM nodes AS a, nodes AS b WHERE a.is_leaf AND b.is_leaf AND " + " AND ".join(f"b.o{a} <= a.o{a} + a.od{a} + 5.0 AND b.o{a} + b.od{a} >= a.o{a} - 5.0" for a in "xyz")))(
    lambda s, d: (lambda i: joins.chunk_join(i.leaves, i.leaves, 5.0).select(F.col("cube_id_a").cast("long").alias("cube_a"), "tag_a", F.col("cube_id_b").cast("long").alias("cube_b"), "tag_b"))(make(events(s, d), 400, GRID))
)

# Recipes


@query(
    "radial_profile",
    f"SELECT CAST(floor({CENTER} / 631.0) AS BIGINT) AS bin, count(*) AS n, round(CASE WHEN count(*) > 10 THEN avg(y) ELSE 0 END, 6) AS mean_y FROM ({sql.EV}) WHERE {sql.in_sphere(g.Sphere(*C, 97.3))} GROUP BY 1",
)
def radial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a field in shells around a centre; shells of few points count as 0."""
    near = search.subset(events(spark, sf_dir), g.Sphere(*C, 97.3), "all").df
    shell = F.floor(g.distance2(*xyz(), *map(F.lit, C)) / 631.0).alias("bin")
    return near.groupBy(shell).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") > 10, F.avg("y")).otherwise(0.0), 6).alias("mean_y"))


@query(
    "radial_profile_log",
    f"WITH p AS (SELECT log10(sqrt({CENTER})) AS l, y FROM ({sql.EV}) WHERE {sql.in_sphere(SPH_ALL)} AND {CENTER} > 0), e AS (SELECT min(l) AS lo, (max(l) - min(l)) / 15 AS w FROM p), b AS (SELECT CAST(floor((l - lo) / w) AS BIGINT) + 1 AS bin, y FROM p, e) SELECT i AS bin, round(pow(10, lo + w * i + w / 2), 6) AS center, count(y) AS n, round(CASE WHEN count(y) > 100 THEN avg(y) ELSE 0 END, 6) AS mean FROM (SELECT unnest(range(15)) AS i) AS r CROSS JOIN e LEFT JOIN b ON b.bin = r.i GROUP BY i, lo, w",
)
def radial_profile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a field in 15 shells of equal width in log10 of the radius."""
    near = search.subset(events(spark, sf_dir), SPH_ALL, "all").df
    out = log_profile(near, g.distance(*xyz(), *map(F.lit, C)), F.col("y"))
    return out.select("bin", F.round("center", 6).alias("center"), "n", F.round("mean", 6).alias("mean"))


query("type_counts", f"SELECT ptype AS particle_type, count(*) AS n FROM ({sql.EV}) GROUP BY 1")(lambda s, d: events(s, d).counts())
query("type_switch", f"SELECT id FROM ({sql.LI}) WHERE ptype = 'R'")(lambda s, d: ids(lineitems(s, d).of_type("R").df))
query("sliced_scan", f"SELECT id FROM ({sql.EV}) WHERE id BETWEEN 100 AND 199 OR id BETWEEN 500 AND 549")(lambda s, d: ids(events(s, d).slices([(100, 200), (500, 550)]).df))
query("decimate", f"SELECT id, x FROM ({sql.EV}) WHERE id % 10 = 0")(lambda s, d: events(s, d).decimate(10).df.select(ID, "x"))
query("temperature_in_sphere", f"SELECT min(t) AS lowest, max(t) AS highest FROM (SELECT (y * y + z * z) * 0.5 * 1.6 AS t FROM ({sql.EV}) WHERE {sql.in_sphere(SPH_A)})")(lambda s, d: search.inside(events(s, d).df, SPH_A).select(((F.col("y") * F.col("y") + F.col("z") * F.col("z")) * 0.5 * 1.6).alias("t")).agg(F.min("t").alias("lowest"), F.max("t").alias("highest")))
query("molecular_weight", f"SELECT id, 4.0 / (1.0 + 3.0 * 0.76 + 4.0 * 0.76 * (y / 150.0)) AS mu, 4.0 / (1.0 + 3.0 * 0.76 + 4.0 * 0.76 * (y / 150.0)) * (5.0 / 3.0 - 1.0) * z AS temperature FROM ({sql.EV})".replace("4.0", "4e0").replace("1.0", "1e0").replace("3.0", "3e0").replace("0.76", "0.76e0").replace("5.0", "5e0"))(
    lambda s, d: events(s, d).df.withColumn("mu", F.lit(4.0) / (F.lit(1.0) + F.lit(3.0) * F.lit(0.76) + F.lit(4.0) * F.lit(0.76) * (F.col("y") / F.lit(150.0)))).select(ID, "mu", (F.col("mu") * (F.lit(5.0) / F.lit(3.0) - F.lit(1.0)) * F.col("z")).alias("temperature"))
)
