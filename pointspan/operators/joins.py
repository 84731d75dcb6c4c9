"""Joins by distance.

Both sides get the cell of a grid as wide as the radius; one side is copied to
the 27 cells around its own, and an equi-join on cells followed by the exact
test gives every pair once.  The join is a sort-merge or hash join that AQE
can split where a cell is hot; there is no nested loop.

Counts of pairs need no pairs: space is cut into blocks (``cuts``), two blocks
whose boxes lie in one bin as a whole count as the product of their weights,
and only the others' points meet, in units of work of about equal size, where
the same is done with leaves of a few points.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, distance2, finite
from pointspan.operators.cuts import SAMPLE, Cuts, columns, pair_sums, placed, sampled, settled
from pointspan.shared import materialize
from pointspan.sources.points import ID

CELL = ("_cx", "_cy", "_cz")


def cell(axis: Column, size: float) -> Column:
    return F.floor(axis / F.lit(float(size)))


def gridded(df: DataFrame, size: float) -> DataFrame:
    return df.filter(finite()).withColumns({c: cell(F.col(a), size) for c, a in zip(CELL, AXES, strict=True)})


def around(df: DataFrame) -> DataFrame:
    """Copies of every row in the 27 cells around it."""
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(c) for c, s in zip(CELL, (i % 3 - 1, i // 3 % 3 - 1, i // 9 - 1), strict=True)]) for i in range(27)])
    return df.withColumn("_step", F.explode(steps)).withColumns({c: F.col(c) + F.col("_step")[c] for c in CELL}).drop("_step")


def sided(df: DataFrame, side: str, extra: Iterable[str] = ()) -> DataFrame:
    return df.select(*CELL, *[F.col(c).alias(f"{c}_{side}") for c in (ID, *AXES, *extra)])


def d2() -> Column:
    return distance2(*[F.col(f"{a}_a") for a in AXES], *[F.col(f"{a}_b") for a in AXES])


def pairs_within(a: DataFrame, b: DataFrame, radius: float, extra_a: Iterable[str] = (), extra_b: Iterable[str] = ()) -> DataFrame:
    """``id_a, id_b, d2`` (and the extra columns) of all pairs at most ``radius`` apart."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    # A little wider than the radius, so rounding in the cells' numbers loses no pair.
    size = radius * (1 + 1e-9)
    left = around(sided_grid(a, size, "a", extra_a))
    right = sided_grid(b, size, "b", extra_b)
    return left.join(right, list(CELL)).withColumn("d2", d2()).filter(F.col("d2") <= F.lit(float(radius) * float(radius))).drop(*CELL)


def sided_grid(df: DataFrame, size: float, side: str, extra: Iterable[str]) -> DataFrame:
    return sided(gridded(df, size), side, extra)


def ball_tree(a: DataFrame, b: DataFrame, radius: float, lists: bool = False) -> DataFrame:
    """For each point of ``a``, its neighbours in ``b``: pairs, or a sorted list (empty where there is none)."""
    pairs = pairs_within(a, b, radius).select(F.col("id_a").alias(ID), F.col("id_b").alias("other_id"))
    if not lists:
        return pairs
    found = pairs.groupBy(ID).agg(F.sort_array(F.collect_list("other_id")).alias("others"))
    return a.select(ID).join(found, ID, "left").withColumn("others", F.coalesce("others", F.array().cast("array<bigint>")))


def pairs(points: DataFrame, radius: float) -> DataFrame:
    """``i, j`` with i < j for every pair at most ``radius`` apart."""
    return pairs_within(points, points, radius).filter("id_a < id_b").select(F.col("id_a").alias("i"), F.col("id_b").alias("j"))


def merged_points(df: DataFrame, weight: str | None) -> DataFrame:
    """Equal points once, with the sum of their weights: many copies of a point cost one."""
    total = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return df.groupBy(*AXES).agg(F.min(ID).alias(ID), total.alias("w"))


def count_neighbors(a: DataFrame, b: DataFrame, radii: Iterable[float], weight_a: str | None = None, weight_b: str | None = None, cumulative: bool = True) -> DataFrame:
    """``r, n``: pairs (or sums of weights' products) at most r apart, or in the bins between the radii."""
    radii = sorted(float(r) for r in radii)
    if radii[-1] <= 0:
        raise ValueError("the radius must be positive")
    spark, squares = a.sparkSession, np.array([r * r for r in radii])
    merged = lambda df, weight: materialize(merged_points(df.filter(finite()), weight).select(ID, *[F.col(c).cast("double").alias(c) for c in AXES], "w").filter("w IS NOT NULL"), "merged")
    left = merged(a, weight_a)
    right = left if a.sameSemantics(b) and weight_a == weight_b else merged(b, weight_b)
    tree = counting_tree(left if right is left else left.unionByName(right))
    sides = [df.withColumn("_g", F.lit(0)).mapInArrow(lambda batches: placed({0: (tree, 0)}, batches, (*AXES, "w")), "_block int, x double, y double, z double, w double") for df in (left, right)]
    own, units_a, units_b = counting_units(*[block_table(df) for df in sides], squares)
    names = [f"n{i}" for i in range(len(radii))]
    if len(units_a):
        work = [side.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"_block": u[:, 0], "_u": u[:, 1]}), "_block int, _u int")), "_block").select("_u", *AXES, "w").repartition(min(512, int(u[-1, 1]) + 1), "_u") for side, u in zip(sides, (units_a, units_b), strict=True)]
        sums = work[0].groupBy("_u").cogroup(work[1].groupBy("_u")).applyInArrow(lambda x, y: counted(x, y, squares), ", ".join(f"{n} double" for n in names))
        whole = sums.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    else:
        whole = spark.range(1).select(*[F.lit(0.0).alias(n) for n in names])
    bins = [F.col(n) + F.lit(float(v)) for n, v in zip(names, own, strict=True)]
    found = [reduce(Column.__add__, bins[: i + 1]) if cumulative else bins[i] for i in range(len(radii))]
    return whole.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), n.alias("n")) for r, n in zip(radii, found, strict=True)])).alias("x")).select("x.r", "x.n")


#: Points of a counted block at least, blocks at about, and the pairs of one unit of work at least.
COUNT_BLOCK, COUNT_BLOCKS, UNIT, UNITS = 2048, 512, 1 << 24, 4096


def counting_tree(points: DataFrame) -> Cuts:
    n = points.count()
    found = columns(sampled(points, n).toArrow())
    return Cuts(found, int(max(COUNT_BLOCK, n / COUNT_BLOCKS) * min(1.0, SAMPLE / max(n, 1))))


def block_table(points: DataFrame) -> np.ndarray:
    """One row a block: its number, points, sum of weights, and the box of its points; some 1,000 rows at most."""
    found = points.groupBy("_block").agg(F.count("*"), F.sum("w"), *[f(a) for f in (F.min, F.max) for a in AXES]).collect()
    return np.array([tuple(r) for r in found], np.float64).reshape(-1, 9)


def counting_units(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by bin of the blocks whose pairs all share a bin; and of the others which blocks (first column) each unit of work takes.

    A unit is a block of ``a`` with some blocks of ``b``, of about as many pairs each.
    """
    own, out_a, out_b, unit = np.zeros(len(squares)), [], [], 0
    if not len(a) or not len(b):
        return own, np.zeros((0, 2), int), np.zeros((0, 2), int)
    first, last = settled(a[:, 3:6], a[:, 6:9], b[:, 3:6], b[:, 6:9], squares)
    product = a[:, 2][:, None] * b[:, 2][None, :]
    plain = (first == last) & np.isfinite(product)
    for i in range(len(squares)):
        own[i] = product[plain & (first == i)].sum()
    open_ = ~plain & (first < len(squares))
    pairs_ = a[:, 1][:, None] * b[:, 1][None, :] * open_
    unit_pairs = max(UNIT, pairs_.sum() / UNITS)
    for i in np.flatnonzero(open_.any(axis=1)):
        blocks = np.flatnonzero(open_[i])
        done, rows = np.cumsum(pairs_[i, blocks]), np.cumsum(b[blocks, 1])
        part = (done - pairs_[i, blocks]) // unit_pairs + (rows - b[blocks, 1]) // (1 << 20)
        part = unit + np.unique(part, return_inverse=True)[1]
        out_a += [(a[i, 0], u) for u in range(unit, part[-1] + 1)]
        out_b += zip(b[blocks, 0], part, strict=True)
        unit = part[-1] + 1
    return own, np.array(out_a, int).reshape(-1, 2), np.array(out_b, int).reshape(-1, 2)


def counted(a, b, squares: np.ndarray):
    """The sums by bin of one unit (Arrow tables), as one row."""
    import pyarrow as pa

    found = pair_sums(columns(a), np.asarray(a["w"]), columns(b), np.asarray(b["w"]), squares) if len(a) and len(b) else np.zeros(len(squares))
    return pa.table({f"n{i}": [float(v)] for i, v in enumerate(found)})


def distance_matrix(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``i, j, v`` with the distance of every pair at most ``radius`` apart."""
    return pairs_within(a, b, radius).select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.sqrt("d2").alias("v"))


def chunk_join(leaves: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Leaves of one index with the leaves of another that come within ``radius`` of them.

    Boxes are dealt to the cells of a grid as wide as the largest box and the
    radius, so this is an equi-join too.
    """
    widest = max(leaves.agg(F.greatest(F.max("odx"), F.max("ody"), F.max("odz"))).first()[0] or 1.0, nodes.agg(F.greatest(F.max("odx"), F.max("ody"), F.max("odz"))).first()[0] or 1.0)
    size = (widest + radius) * (1 + 1e-9)
    box = ("ox", "oy", "oz", "odx", "ody", "odz")
    named = lambda df, s: df.select("cube_id", "tag", "start", "stop", *box).select(*[cell(F.col(f"o{a}"), size).alias(c) for a, c in zip(AXES, CELL, strict=True)], *[F.col(c).alias(f"{c}_{s}") for c in ("cube_id", "tag", "start", "stop", *box)])
    near = F.lit(True)
    for a in AXES:
        low, high = F.col(f"o{a}_a") - radius, F.col(f"o{a}_a") + F.col(f"od{a}_a") + radius
        near = near & (F.col(f"o{a}_b") <= high) & (F.col(f"o{a}_b") + F.col(f"od{a}_b") >= low)
    return around(named(leaves, "a")).join(named(nodes, "b"), list(CELL)).filter(near).select(*[f"{c}_{s}" for s in "ab" for c in ("cube_id", "tag", "start", "stop")])
