"""Range search: points, chunks and nodes in a shape.

Strict results need the points and the shape only: one scan with the shape's
box pushed into it and the exact test behind.  Non-strict results are all
points of the leaves that the shape touches; they and chunks come from the
index.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, Shape, sphere_overlap
from pointspan.plans.index import Index, node_box
from pointspan.sources.points import ID, PointFrame


def inside(df: DataFrame, shape: Shape) -> DataFrame:
    """Strict search: the rows in a shape."""
    return df.filter(shape.contains(*[F.col(a) for a in AXES]))


def count_inside(df: DataFrame, shape: Shape) -> DataFrame:
    return inside(df, shape).agg(F.count("*").alias("n"))


def subset(frame: PointFrame, shape: Shape, fields=None) -> PointFrame:
    """A lazy sub-dataset: positions, id and the fields asked for; its box is the shape's."""
    names = frame.select_fields(fields)
    return PointFrame(inside(frame.df, shape).select(ID, *AXES, *names), shape.bounding_box(), f"{frame.name} in a shape")


def touched(index: Index, shape: Shape) -> DataFrame:
    """Nodes with ``code``, how far the shape covers their box, where it touches it."""
    return index.nodes.withColumn("code", shape.overlap(node_box())).filter("code > 0")


def chunks(index: Index, shape: Shape, cubes: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Disjoint runs of ``pos``: whole nodes inside the shape, and leaves it touches (``partial`` 1).

    A node that is wholly inside is left out if its parent is too.
    """
    key = [*index.by, "cube_id"]
    hit = masked(touched(index, shape), cubes)
    parents = hit.filter("code = 8 AND NOT is_leaf").select(*key, F.col("tag").alias("_parent"), F.lit(True).alias("_whole"))
    own = hit.filter("code = 8 OR is_leaf").withColumn("_parent", F.expr("substring(tag, 1, level - 1)"))
    return own.join(parents, [*key, "_parent"], "left").filter("_whole IS NULL").select(*key, "tag", "start", "stop", (F.col("code") < 8).cast("int").alias("partial"))


def masked(df: DataFrame, cubes: Iterable[int] | DataFrame | None) -> DataFrame:
    """Keep some cubes only: a list of ids or a frame with ``cube_id``."""
    if cubes is None:
        return df
    if isinstance(cubes, DataFrame):
        return df.join(cubes.select("cube_id").distinct(), "cube_id", "left_semi")
    return df.filter(F.col("cube_id").isin(*cubes))


def nodes_in(index: Index, shape: Shape) -> DataFrame:
    """Nodes wholly inside, with ``partial`` 0, and leaves that are touched only, with 1."""
    return chunks(index, shape)


def pruned(index: Index, shape: Shape) -> DataFrame:
    """The points of the cubes that a shape touches: a filter on the column that saved indexes are partitioned by."""
    found = index.cubes.filter(shape.overlap(node_box()) > 0).select("cube_id").distinct()
    cubes = sorted(r["cube_id"] for r in found.collect())  # side**3 + 1 rows at most
    at = F.col("cube_id")
    return index.points.filter(at.isin(cubes) if len(cubes) <= 256 else at.between(cubes[0], cubes[-1]))


def in_leaves(index: Index, shape: Shape, cubes: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Non-strict search: the rows of all leaves that the shape touches, with ``partial``."""
    key = [*index.by, "cube_id"]
    leaves = masked(touched(index, shape), cubes).filter("is_leaf").select(*key, F.col("tag").alias("leaf_tag"), (F.col("code") < 8).cast("int").alias("partial"))
    return pruned(index, shape).join(leaves, [*key, "leaf_tag"])


def inside_indexed(index: Index, shape: Shape, cubes: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Strict search through the index: only rows of leaves that the shape cuts are tested (and those left over from the grid)."""
    untested = (F.col("partial") == 0) & (F.col("cube_id") < index.side**3)
    return in_leaves(index, shape, cubes).filter(untested | shape.contains(*[F.col(a) for a in AXES])).drop("partial")


def leaves_of_balls(index: Index, queries: DataFrame) -> DataFrame:
    """``qid`` and the leaves that each ball touches; ``queries`` has ``qid, x, y, z, r``.

    A ball names the cubes of the grid that its box meets, so balls and leaves
    are joined by cube, all of them in one plan.
    """
    first, last = [], []
    for a, p, s in zip(AXES, index.box.values()[:3], index.box.values()[3:], strict=True):
        # A touch counts, so the cubes that only share a side with the ball's box are named as well.
        cell = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(index.side - 1)).cast("int")  # noqa: B023, E731
        low, high = ((F.col(a) + sign * F.col("r") - F.lit(p)) / F.lit(s) * index.side for sign in (-1, 1))
        first.append(cell(low - 1e-6))
        last.append(cell(high + 1e-6))
    steps = [F.sequence(i, j) for i, j in zip(first, last, strict=True)]
    cubes = queries.select("*", F.explode(steps[0]).alias("_ix")).select("*", F.explode(steps[1]).alias("_iy")).select("*", F.explode(steps[2]).alias("_iz"))
    grid = cubes.withColumn("cube_id", (F.col("_ix") * index.side + F.col("_iy")) * index.side + F.col("_iz")).drop("_ix", "_iy", "_iz")
    every = grid.unionByName(queries.withColumn("cube_id", F.lit(index.side**3)))
    at = [F.col(c) for c in ("_x", "_y", "_z", "_r")]
    named = every.withColumnsRenamed({"x": "_x", "y": "_y", "z": "_z", "r": "_r"})
    return named.join(index.leaves, "cube_id").withColumn("code", sphere_overlap(*at, node_box())).filter("code > 0").drop("_x", "_y", "_z", "_r")


def balls_nonstrict(index: Index, queries: DataFrame) -> DataFrame:
    """``qid`` and the rows of all leaves that each ball touches."""
    key = [*index.by, "cube_id"]
    leaves = leaves_of_balls(index, queries).select("qid", *key, F.col("tag").alias("leaf_tag"))
    return index.points.join(leaves, [*key, "leaf_tag"])


def expand(chunk_rows: DataFrame) -> DataFrame:
    """The single places of chunks."""
    return chunk_rows.select(F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"))


def ball_point(queries: DataFrame, points: DataFrame, radius: float, small: int = 1000) -> DataFrame:
    """``qid, id`` of all points within ``radius`` (closed) of each query (``qid, x, y, z``): a grid join."""
    from pointspan.operators.joins import pairs_within

    return pairs_within(queries.withColumnRenamed("qid", ID), points, radius).select(F.col("id_a").alias("qid"), F.col("id_b").alias("id"))


def ball_lengths(index: Index, queries: DataFrame) -> DataFrame:
    """``qid, n`` for balls ``qid, x, y, z, r``: points of the leaves that each touches; 0 where it touches none."""
    found = leaves_of_balls(index, queries).groupBy("qid").agg(F.sum("n").alias("n"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))
