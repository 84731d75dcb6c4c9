"""Walking an index: nodes by tag, by point, and what they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, box_contains, finite
from pointspan.operators.knn import nearest_one
from pointspan.plans.index import Index, cube_of, node_box, tag_of, with_cells
from pointspan.sources.points import ID


def walk(index: Index) -> DataFrame:
    """All nodes in the order of a walk from the root, cube by cube."""
    return index.nodes.orderBy(*index.by, "cube_id", "tag")


def by_tag(index: Index, tag: str, cube_id: int | None = None) -> DataFrame:
    found = index.nodes.filter(F.col("tag") == tag)
    return found if cube_id is None else found.filter(F.col("cube_id") == cube_id)


def children(index: Index, tag: str, cube_id: int) -> DataFrame:
    return index.nodes.filter((F.col("cube_id") == cube_id) & (F.expr("substring(tag, 1, level - 1)") == tag)).orderBy("tag")


def parent(tag: str) -> str | None:
    return tag[:-1] or None


def rows_of(index: Index, tag: str, cube_id: int) -> DataFrame:
    return index.points.filter((F.col("cube_id") == cube_id) & F.col("leaf_tag").startswith(tag))


def containing(index: Index, *points) -> DataFrame:
    """For every cube, the deepest node whose box holds all of the points."""
    tests = [box_contains(node_box(), *[F.lit(float(c)) for c in p]) for p in points]
    key = [*index.by, "cube_id"]
    held = index.nodes.filter(reduce(lambda a, b: a & b, tests))
    deepest = F.max(F.struct("level", "tag", "n", "start", "stop")).alias("x")
    return held.groupBy(*key).agg(deepest).select(*key, "x.tag", "x.level", "x.n", "x.start", "x.stop")


def locate(index: Index, queries: DataFrame) -> DataFrame:
    """``qid, cube_id, leaf_tag``: the leaf around each query (``qid, x, y, z``, and ``cube_id`` where it isn't to follow from the place).

    Queries that aren't numbers, or whose part of the space has no node, have no row.
    """
    at = queries.filter(finite())
    if "cube_id" not in queries.columns:
        at = at.withColumn("cube_id", cube_of(index.box, index.side, *[F.col(a) for a in AXES]))
    deepest = index.leaves.agg(F.max("level")).first()[0] or 1
    paths = with_cells(at.select("qid", "cube_id", *AXES), index.box, index.side, deepest - 1).select("qid", "cube_id", tag_of(f"{deepest - 1}").alias("path"))
    cut = paths.withColumn("leaf_tag", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring("path", F.lit(1), n))))
    leaves = index.leaves.select(*index.by, "cube_id", F.col("tag").alias("leaf_tag"))
    return cut.join(leaves, ["cube_id", "leaf_tag"]).select("qid", *index.by, "cube_id", "leaf_tag")


def nearest_in_node(index: Index, tag: str, cube_id: int, center) -> DataFrame:
    return nearest_one(rows_of(index, tag, cube_id).select(ID, *AXES), center)


def leaf_fill(index: Index) -> DataFrame:
    """How many leaves hold how many rows."""
    return index.leaves.groupBy("n").agg(F.count("*").alias("leaves"))


def extremes(index: Index) -> DataFrame:
    """Tags of a shallowest and a deepest leaf."""
    return index.leaves.agg(F.min(F.struct("level", "cube_id", "tag")).alias("a"), F.max(F.struct("level", "cube_id", "tag")).alias("b")).select(F.col("a.tag").alias("shallowest"), F.col("b.tag").alias("deepest"))


def size(index: Index) -> DataFrame:
    return index.nodes.filter("level = 1").agg(F.sum("n").alias("n"))
