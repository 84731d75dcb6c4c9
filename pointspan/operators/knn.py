"""Nearest neighbours, always exact; ties go to the smaller id.

One query is a top-k over a scan.  Many queries go in two steps over blocks
of points (``cuts``): a query looks at its own block, and then at the other
blocks that come as near to it as its k-th neighbour there, mostly one or none.
Blocks have about as many points each, wherever they are crowded; the points
of each value of ``by`` have blocks of their own.  Points are shuffled once a
step, and of the pairs only each query's k nearest in a block leave it.  Ids
are whole numbers; a null id comes last among equally near ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pointspan.functions.geometry import AXES, Box, distance2, finite
from pointspan.operators.cuts import BLOCK, BLOCKS, SAMPLE, Block, Cuts, columns, kth, placed, sampled
from pointspan.plans.index import Index, node_box
from pointspan.shared import materialize
from pointspan.sources.points import ID

FAR = float("inf")
#: Stands for a null id, which comes after all others.
LAST = (1 << 63) - 1


def metric(dx: Column, dy: Column, dz: Column, p: float) -> Column:
    if p == 1:
        return F.abs(dx) + F.abs(dy) + F.abs(dz)
    if p == 2:
        return F.sqrt(dx * dx + dy * dy + dz * dz)
    if p == FAR:
        return F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))
    raise NotImplementedError(f"p = {p} isn't supported")


def nearest(points: DataFrame, center, k: int = 1, upper: float | None = None, p: float = 2, measure=None) -> DataFrame:
    """``rank, id, dist`` of the k points nearest to one centre, closer than ``upper``.

    ``measure`` is a function of the three columns that gives a distance of
    the caller's own.
    """
    cols, at = [F.col(a) for a in AXES], [F.lit(float(c)) for c in center]
    dist = measure(*cols) if measure else metric(*[c - v for c, v in zip(at, cols, strict=True)], p)
    found = points.filter(finite()).select(ID, dist.alias("dist"))
    if upper is not None and upper < FAR:
        found = found.filter(F.col("dist") < upper)
    top = found.orderBy("dist", ID).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy("dist", ID))).select("rank", ID, "dist")


def nearest_batch(queries: DataFrame, points: DataFrame, k: int, upper: float | None = None, by: tuple[str, ...] = (), p: float = 2) -> DataFrame:
    """``qid, rank, id, dist`` of each query's (``qid, x, y, z``) k nearest points; ``by``: per value of these columns of the points.

    ``p`` is 1, 2 or infinity: in each of these measures, two points are no nearer than on any one axis.
    """
    if k < 1:
        raise ValueError("k must be positive")
    points, queries = points.filter(finite()), queries.filter(finite())
    spark, kept = points.sparkSession, points.schema
    rows = points.groupBy(*by).agg(F.count("*").alias("_n")).collect()
    n = sum(r["_n"] for r in rows)
    if not n or queries.isEmpty():
        return empty(queries, by, points)
    groups = spark.createDataFrame([(*r[: len(by)], g) for g, r in enumerate(rows)], T.StructType([*[T.StructField(c, kept[c].dataType) for c in by], T.StructField("_g", T.IntegerType(), False)]))
    named = points.select(F.coalesce(F.col(ID).cast("long"), F.lit(LAST)).alias(ID), *AXES, *by)
    if by:
        same = [F.col(f"_p.{c}").eqNullSafe(F.col(f"_q.{c}")) for c in by]
        named = named.alias("_p").join(F.broadcast(groups.alias("_q")), reduce(Column.__and__, same))
    else:
        named = named.withColumn("_g", F.lit(0))
    named = named.select("_g", ID, *AXES)
    cuts, crowded, parts = trees(named, n, k, len(rows))
    if crowded:
        # So many equal points that no cut parts them: of those, only the k smallest ids can be among the nearest.
        named = named.withColumn("_r", F.row_number().over(W.partitionBy("_g", *AXES).orderBy(ID))).filter(F.col("_r") <= k).drop("_r")
    blocks = named.mapInArrow(lambda batches: placed(cuts, batches, (ID, *AXES)), f"_block int, {ID} long, x double, y double, z double")
    qtype = queries.schema["qid"].dataType.simpleString()
    asked = queries.select("qid", *[F.col(a).cast("double").alias(a) for a in AXES]).crossJoin(F.broadcast(groups.select("_g"))).withColumn("_far", F.lit(FAR if upper is None else float(upper)))
    keep = ("_g", "qid", *AXES, "_far")
    asked = asked.mapInArrow(lambda batches: placed(cuts, batches, keep), f"_block int, _g int, qid {qtype}, x double, y double, z double, _far double")
    schema = f"_g int, qid {qtype}, x double, y double, z double, _far double, ids array<bigint>, dists array<double>, others array<int>"
    # A few blocks a task: their work is not in proportion to their bytes, by which AQE would put them together.
    dealt = lambda df: df.repartition(min(512, max(min(parts, 8), -(-parts // 4))), "_block").groupBy("_block")
    look = lambda q, home: dealt(q).cogroup(dealt(blocks)).applyInArrow(lambda a, b: looked(a, b, cuts if home else None, k, p), schema)
    first = materialize(look(asked, True), "near")
    open_ = first.filter(F.size("others") > 0)
    more = look(open_.select(F.explode("others").alias("_block"), *keep), False)
    row = lambda df, *c: df.select("_g", "qid", *c).select("_g", "qid", (F.col("pos") + 1).alias("rank"), F.col("col.ids").alias(ID), F.col("col.dists").alias("dist"))
    spread = F.posexplode(F.arrays_zip("ids", "dists"))
    whole = row(first.filter(F.size("others") == 0), spread)
    rank = F.row_number().over(W.partitionBy("_g", "qid").orderBy("dist", ID))
    merged = row(open_, spread).unionByName(row(more, spread)).withColumn("rank", rank).filter(F.col("rank") <= k)
    out = whole.unionByName(merged)
    if upper is not None and upper < FAR:
        out = out.filter(F.col("dist") < upper)
    if by:
        out = out.join(F.broadcast(groups), "_g")
    return out.select("qid", *by, "rank", F.nullif(F.col(ID), F.lit(LAST)).cast(kept[ID].dataType).alias(ID), "dist")


def trees(points: DataFrame, n: int, k: int, groups: int) -> tuple[dict[int, tuple[Cuts, int]], bool, int]:
    """For each group ``_g`` a tree of cuts and the number of its first block; whether some block is crowded by equal points; the number of blocks."""
    rate = min(1.0, SAMPLE / n)
    most = max(BLOCK, n / BLOCKS, 8 * k) * rate
    found = sampled(points, n).toArrow()
    g, at = np.asarray(found["_g"]), columns(found)
    order = np.argsort(g, kind="stable")
    start = np.searchsorted(g[order], np.arange(groups + 1))
    out, blocks, crowded = {}, 0, False
    for i in range(groups):
        tree = Cuts(at[order[start[i] : start[i + 1]]], int(most), max(8, math.ceil(2 * k * rate)))
        out[i] = (tree, blocks)
        blocks += tree.leaves
        crowded |= tree.crowded > 4 * most
    return out, crowded, blocks


def looked(asked, block, cuts: dict[int, tuple[Cuts, int]] | None, k: int, p: float):
    """The queries of one block (Arrow tables) with their nearest in it, and with ``cuts`` the other blocks that may hold nearer ones."""
    import pyarrow as pa

    q, far = columns(asked), np.asarray(asked["_far"], np.float64)
    if len(q):
        at, ids, dist = Block(columns(block), np.asarray(block[ID], np.int64), k, p).nearest(q, far)
        far = np.minimum(far, kth((at, ids, dist), len(q), k))
    else:
        at, ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near, other = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if cuts is not None and len(q):
        tree, before = cuts[asked["_g"][0].as_py()]
        near, other = tree.reached(q, far)
        away = other != tree.place(q)[near]
        near, other = near[away], other[away] + before
    lists = lambda at, v, kind: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(q) + 1)), pa.int32()), pa.array(v, kind), type=pa.list_(pa.field("element", kind)))
    kept = {c: asked[c] for c in ("_g", "qid", *AXES)}
    return pa.table(kept | {"_far": pa.array(far), "ids": lists(at, ids, pa.int64()), "dists": lists(at, dist, pa.float64()), "others": lists(near, other, pa.int32())})


def empty(queries: DataFrame, by: tuple[str, ...], points: DataFrame) -> DataFrame:
    return queries.limit(0).select("qid", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in by], F.lit(0).alias("rank"), F.lit(None).cast("long").alias(ID), F.lit(0.0).alias("dist"))


def ranks(found: DataFrame, queries: DataFrame, wanted: Iterable[int], n: int) -> DataFrame:
    """Some ranks of every query; a missing neighbour has infinite distance and the id ``n``."""
    asked = queries.select("qid").withColumn("rank", F.explode(F.array(*map(F.lit, wanted))))
    return asked.join(found, ["qid", "rank"], "left").select("qid", "rank", F.coalesce(ID, F.lit(n).cast("long")).alias(ID), F.coalesce("dist", F.lit(FAR)).alias("dist"))


def nearest_one(points: DataFrame, center) -> DataFrame:
    """``id, dist`` of the nearest point."""
    at = distance2(*[F.col(a) for a in AXES], *[F.lit(float(c)) for c in center])
    best = points.filter(finite()).agg(F.min(F.struct(at.alias("d2"), F.col(ID).alias(ID))).alias("x"))
    return best.select(F.col("x")[ID].alias(ID), F.sqrt(F.col("x")["d2"]).alias("dist"))


def nearest_cube(index: Index, center) -> DataFrame:
    """``cube_id, dist`` of the cube whose box is nearest to a point."""
    from pointspan.functions.geometry import project

    at = [F.lit(float(c)) for c in center]
    dist = distance2(*at, *project(node_box(), *at))
    best = index.cubes.agg(F.min(F.struct(dist.alias("d2"), F.col("cube_id").alias("cube_id"))).alias("x"))
    return best.select(F.col("x")["cube_id"].alias("cube_id"), F.sqrt(F.col("x")["d2"]).alias("dist"))


def radius_for(points: DataFrame, center, m: int) -> DataFrame:
    """``radius`` of the smallest ball around a centre that holds m points."""
    return nearest(points, center, m).agg(F.max("dist").alias("radius"))


def search_box(center, dist: float, box: Box) -> Box | None:
    """The box around a ball, within another box."""
    return Box(*[c - dist for c in center], *[2 * dist] * 3).clip(box)
