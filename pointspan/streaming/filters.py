"""Range filters over a stream of points: they hold no state, so any stream can pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, Box, Shape
from pointspan.operators.search import inside
from pointspan.plans.index import cube_of


def stream_inside(stream: DataFrame, shape: Shape) -> DataFrame:
    return inside(stream, shape)


def stream_cubes(stream: DataFrame, box: Box, side: int) -> DataFrame:
    """The stream with each point's cube in a fixed grid."""
    return stream.withColumn("cube_id", cube_of(box, side, *[F.col(a) for a in AXES]))


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, box: Box, side: int) -> DataFrame:
    """Points per time window and cube, with a watermark for late ones."""
    return stream_cubes(stream, box, side).withWatermark(time, late).groupBy(F.window(time, width), "cube_id").agg(F.count("*").alias("n"))
