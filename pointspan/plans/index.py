"""The spatial index: a grid of cubes, and in each cube an adaptive octree.

The index is columns and two narrow tables, not a structure in memory:

``points``  the rows with ``cube_id``, ``leaf_tag`` and ``pos``
``nodes``   every node: ``cube_id, tag, level, n, start, stop, is_leaf`` and its box
``cubes``   every cube that has rows: ``cube_id, n, start, stop`` and its box

A node's tag is "0" for the root, then a digit 1 to 8 for each step down, so
the order of tags is the order of a walk.  A node is a leaf if it has at most
``threshold`` rows or its level (the root's is 1) reaches ``depth``.

A row's place at some level is three whole numbers, its cells along the axes.
Rows are counted by cell at level ``STEP + 1`` in the first pass, and that
aggregate is rolled up to all levels above; only rows of nodes that are still
too full take part in a pass ``STEP`` levels deeper.  Then every row meets its
leaf in the narrow table of counted cells, and one range partitioning by leaf
and id puts all rows in their final order, so neither a full leaf nor a full
cube is the work of one task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.functions.geometry import AXES, Box, BoxColumns, finite
from pointspan.shared import materialize
from pointspan.sources.points import ID, TYPE, PointFrame

THRESHOLD, MOST_DEPTH, STEP, BLOCK = 400, 52, 7, 5
CELL = ("_cx", "_cy", "_cz")
EPS = 2.0**-52
BOX = ("ox", "oy", "oz", "odx", "ody", "odz")


def cubes_per_side(parallelism: int) -> int:
    """The smallest side of 3 to 32 with a cube, and one left over, for each worker."""
    return next((c for c in range(3, 33) if c**3 + 1 >= parallelism), 32)


def cube_of(box: Box, side: int, x: Column, y: Column, z: Column) -> Column:
    """The cube of a point; points outside the box go to the cube ``side**3``."""
    cells, inside = [], F.lit(True)
    for v, p, s in zip((x, y, z), box.values()[:3], box.values()[3:], strict=True):
        cells.append(F.when(v == p + s, F.lit(side - 1)).otherwise(F.floor((v - F.lit(p)) / F.lit(s) * side)).cast("int"))
        inside = inside & v.between(p, p + s)
    ix, iy, iz = (F.least(c, F.lit(side - 1)) for c in cells)
    return F.when(inside, (ix * side + iy) * side + iz).otherwise(F.lit(side**3))


def cube_box(box: Box, side: int, cube: Column) -> dict[str, Column]:
    """A cube's box; that of the points left over is the whole box."""
    steps = (F.floor(cube / (side * side)), F.floor(cube / side) % side, cube % side)
    over = cube == side**3
    out = {}
    for a, step, p, s in zip(AXES, steps, box.values()[:3], box.values()[3:], strict=True):
        out[f"o{a}"] = F.when(over, F.lit(p)).otherwise(F.lit(p) + step * F.lit(s / side))
        out[f"od{a}"] = F.when(over, F.lit(s)).otherwise(F.lit(s / side))
    return {k: out[k] for k in BOX}


def all_cube_boxes(df: DataFrame, box: Box, side: int) -> DataFrame:
    grid = df.sparkSession.range(side**3 + 1).select(F.col("id").cast("int").alias("cube_id"))
    return grid.withColumns(cube_box(box, side, F.col("cube_id")))


def child_box(box: dict[str, Column], digit: Column) -> dict[str, Column]:
    """The box of child 1 to 8: halves, from the root downwards."""
    out = {}
    for i, a in enumerate(AXES):
        half = box[f"od{a}"] / 2
        out[f"o{a}"] = F.when(F.shiftright(digit - 1, i).bitwiseAND(F.lit(1)) == 1, box[f"o{a}"] + half).otherwise(box[f"o{a}"])
        out[f"od{a}"] = half
    return {k: out[k] for k in BOX}


def halved(v: str, corner: str, size: str, levels: int) -> str:
    """SQL of the cell along an axis by halving ``levels`` times, with the sums rounded as those of the nodes' boxes."""
    middle = "acc.o + acc.d / 2"
    step = f"struct(if({v} >= {middle}, {middle}, acc.o) AS o, acc.d / 2 AS d, acc.c * 2 + if({v} >= {middle}, 1L, 0L) AS c)"
    return f"aggregate(sequence(1, {levels}), struct({corner} AS o, {size} AS d, 0L AS c), (acc, k) -> {step}, acc -> acc.c)"


def with_cells(df: DataFrame, box: Box, side: int, levels: int) -> DataFrame:
    """Add every row's cells ``levels`` below its cube's root.

    A division gives the cell, but for points so near to a border that
    rounding could count: these are halved down step by step.
    """
    if not levels:
        return df.withColumns({c: F.lit(0).cast("long") for c in CELL})
    last, out = 2**levels - 1, []
    boxed = df.select("*", *[c.alias(k) for k, c in cube_box(box, side, F.col("cube_id")).items()])
    scaled = boxed.selectExpr("*", *[f"({a} - o{a}) / od{a} * {2.0**levels!r}D AS {c}_at" for c, a in zip(CELL, AXES, strict=True)])
    for c, a, p, s in zip(CELL, AXES, box.values()[:3], box.values()[3:], strict=True):
        slack = (levels + 8) * EPS * 2.0**levels * max(1.0, side * max(abs(p), abs(p + s)) / s)
        plain = f"least(greatest(CAST(floor({c}_at) AS BIGINT), 0L), {last}L)"
        out.append(f"if(abs({c}_at - rint({c}_at)) <= {slack!r}D, {halved(a, f'o{a}', f'od{a}', levels)}, {plain}) AS {c}")
    return scaled.selectExpr(*[f"`{c}`" for c in df.columns], *out)


def up(levels: str | int) -> dict[str, Column]:
    """The cells some levels above; ``levels`` is a number or SQL."""
    return {c: F.expr(f"shiftright({c}, {levels})") for c in CELL}


def tag_of(levels: str) -> Column:
    """The tag of the cells ``levels`` (SQL) below a root."""
    bits = [f"{2**i} * (shiftright({c}, {levels} - k) & 1)" for i, c in enumerate(CELL)]
    return F.expr(f"concat('0', array_join(transform(if({levels} > 0, sequence(1, {levels}), array()), k -> CAST(1 + {' + '.join(bits)} AS STRING)), ''))")


@dataclass(frozen=True)
class Index:
    """Points with their index; ``by`` are the columns that set indexes apart (none, or the type)."""

    points: DataFrame
    nodes: DataFrame
    cubes: DataFrame
    box: Box
    side: int
    threshold: int
    depth: int
    by: tuple[str, ...] = ()

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.filter("is_leaf")


def build_index(frame: PointFrame, side: int | None = None, threshold: int = THRESHOLD, depth: int | None = None, box: Box | None = None, by_type: bool = False, cube_column: str | None = None) -> Index:
    """Index a point frame.

    ``by_type`` gives every particle type an index of its own in the same
    tables.  ``cube_column`` takes the rows' cubes from a column (0 to
    ``side**3``) instead of from their place.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    box = Box.of(box) if box is not None else frame.bounding_box()
    side = side or cubes_per_side(frame.df.sparkSession.sparkContext.defaultParallelism)
    if not 1 <= side <= 32:
        raise ValueError("there are 1 to 32 cubes on a side")
    depth = depth if depth is not None else min(max(box.max_depth(), 1), MOST_DEPTH)
    if depth < 1:
        raise ValueError("the depth must be positive")
    by = (TYPE,) if by_type else ()
    rows = frame.df.filter(finite())
    cube = F.col(cube_column) if cube_column else cube_of(box, side, *[F.col(a) for a in AXES])
    rows = rows.withColumn("cube_id", cube.cast("int"))
    key = [*by, "cube_id"]
    tables, counts, level, full = [], [], 0, None
    while True:
        deep = min(max(level, 1) + STEP, depth)
        placed = with_cells(rows.select(*key, *AXES), box, side, deep - 1)
        if full is not None:
            # Only rows of nodes that are too full go on.
            above = placed.withColumns({f"{c}_up": shifted for c, shifted in up(deep - level).items()})
            same = reduce(lambda a, b: a & b, [above[k].eqNullSafe(full[k]) for k in key] + [above[f"{c}_up"] == full[c] for c in CELL])
            placed = above.join(full, same, "left_semi").drop(*[f"{c}_up" for c in CELL])
        counted = materialize(placed.groupBy(*key, *CELL).agg(F.count("*").alias("n")), "cells")
        new = materialize(prefix_nodes(counted, key, level, deep, threshold, depth), "nodes")
        tables.append(new)
        counts.append((level, deep, counted))
        full = new.filter((F.col("level") == deep) & ~F.col("is_leaf")).select(*key, *CELL)
        level = deep
        if level >= depth or full.isEmpty():
            break
    nodes = reduce(DataFrame.unionByName, tables)
    table, cubes = offsets(with_boxes(nodes, box, side), key, by, box, side)
    table = materialize(table, "nodes")
    points = in_order(placed_rows(rows, nodes, counts, key, box, side), key, by)
    over = table.filter(F.col("is_leaf") & (F.col("n") > threshold)).limit(1).count()
    if over:
        warnings.warn(f"leaves at level {depth} hold more than {threshold} points; there may be many equal ones", stacklevel=2)
    return Index(points.select(*rows.columns, "leaf_tag", "pos"), table, cubes, box, side, threshold, depth, by)


def prefix_nodes(counted: DataFrame, key: list[str], level: int, deep: int, threshold: int, depth: int) -> DataFrame:
    """Roll the counts of level ``deep`` up to every level under ``level``; a cell is a node if its parent is too full."""
    every = counted.withColumn("level", F.explode(F.sequence(F.lit(level + 1), F.lit(deep))))
    sums = every.withColumns(up(f"{deep} - level")).groupBy(*key, "level", *CELL).agg(F.sum("n").alias("n"))
    siblings = W.partitionBy(*key, "level", *up(1).values())
    # The children's sum is the parent's count, as every row of the parent is in one of them.
    parent = sums.withColumn("_parent", F.sum("n").over(siblings)).filter((F.col("_parent") > threshold) | (F.col("level") == 1)).drop("_parent")
    return parent.withColumns({"is_leaf": (F.col("n") <= threshold) | (F.col("level") >= depth), "tag": tag_of("(level - 1)")})


def with_boxes(nodes: DataFrame, box: Box, side: int) -> DataFrame:
    """The nodes' boxes from those of their cubes, digit by digit."""
    at = nodes.withColumns(cube_box(box, side, F.col("cube_id")))
    start = F.struct(*[F.col(k).alias(k) for k in BOX])
    digits = F.transform(F.filter(F.split(F.expr("substring(tag, 2)"), ""), lambda c: c != ""), lambda c: c.cast("int"))
    down = F.aggregate(digits, start, lambda acc, d: F.struct(*[c.alias(k) for k, c in child_box({k: acc[k] for k in BOX}, d).items()]))
    rest = [c for c in nodes.columns if c not in CELL]
    return at.withColumn("_box", down).select(*rest, *[F.col("_box")[k].alias(k) for k in BOX])


def offsets(nodes: DataFrame, key: list[str], by: tuple[str, ...], box: Box, side: int) -> tuple[DataFrame, DataFrame]:
    """``start`` and ``stop`` of every node and cube in the order of cube and tag.

    A node starts after the rows of all leaves whose tags come before its own.
    These are added up within blocks of tags that begin alike, then over blocks.
    """
    sums = nodes.filter("level = 1").select(*key, "n")
    order = W.partitionBy(*by).orderBy("cube_id") if by else W.orderBy("cube_id")  # side**3 + 1 rows at most
    cubes = sums.withColumn("start", F.sum("n").over(order) - F.col("n")).withColumn("stop", F.col("start") + F.col("n")).withColumns(cube_box(box, side, F.col("cube_id")))
    cubes = materialize(cubes, "cubes")
    own = F.when(F.col("is_leaf"), F.col("n")).otherwise(0)
    blocked = nodes.withColumns({"_block": F.substring("tag", 1, BLOCK), "_own": own})
    blocks = blocked.groupBy(*key, "_block").agg(F.sum("_own").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*key).orderBy("_block")) - F.col("_sum")  # some 8**(BLOCK - 1) rows a cube
    firsts = blocks.join(cubes.select(*key, F.col("start").alias("_cube")), key).select(*key, "_block", (F.col("_cube") + before).alias("_first"))
    within = F.sum("_own").over(W.partitionBy(*key, "_block").orderBy("tag")) - F.col("_own")
    started = blocked.withColumn("_within", within).join(firsts, [*key, "_block"]).withColumn("start", F.col("_first") + F.col("_within"))
    return started.select(*key, "tag", "level", "n", "is_leaf", *BOX, "start", (F.col("start") + F.col("n")).alias("stop")), cubes


def placed_rows(rows: DataFrame, nodes: DataFrame, counts: Iterable[tuple[int, int, DataFrame]], key: list[str], box: Box, side: int) -> DataFrame:
    """The rows with ``leaf_tag``: each pass's counted cells name the leaves found in it, and a row is in one of those only."""
    leaves = nodes.filter("is_leaf").select(*key, "level", *CELL, F.col("tag").alias("leaf_tag"))
    parts = []
    for level, deep, counted in counts:
        cells = counted.withColumns({f"{c}_own": F.col(c) for c in CELL}).withColumn("level", F.explode(F.sequence(F.lit(level + 1), F.lit(deep))))
        found = cells.withColumns(up(f"{deep} - level")).join(leaves, [*key, "level", *CELL])
        named = found.select(*key, *[F.col(f"{c}_own").alias(c) for c in CELL], "leaf_tag")
        parts.append(with_cells(rows, box, side, deep - 1).join(named, [*key, *CELL]).select(*rows.columns, "leaf_tag"))
    return reduce(DataFrame.unionByName, parts)


def in_order(points: DataFrame, key: list[str], by: tuple[str, ...]) -> DataFrame:
    """Write the rows in the order of leaf and id, and add ``pos``, their place in it.

    A range partition may hold many leaves or a part of one.  A row's place is
    its place in its partition and the sizes of the partitions before.
    """
    order = [*key, "leaf_tag", ID]
    stored = materialize(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "points")
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit(2**33 - 1))
    sizes = stored.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_n"), F.min(row).alias("_least"))  # a row for each partition and type
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n") if by else F.sum("_n").over(W.orderBy("_part")) - F.col("_n")
    starts = materialize(sizes.select(*by, "_part", (before - F.col("_least")).alias("_start")), "starts")
    return stored.withColumn("_part", part).join(F.broadcast(starts), [*by, "_part"]).withColumn("pos", F.col("_start") + row)


def node_box() -> BoxColumns:
    return BoxColumns.named(*BOX)
