"""A facade in the manner of SciPy's KDTree over the operators."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, Sphere
from pointspan.operators import joins, knn, search
from pointspan.plans.index import Index, build_index
from pointspan.sources.points import ID, PointFrame, header_box

FAR = float("inf")


class PointTree:
    """Points to be asked; every answer is a DataFrame.

    ``boxsize`` is a box of 1, 3 or 6 numbers.  The index is built when a
    non-strict answer first needs it.
    """

    def __init__(self, data, leafsize: int = 400, boxsize=None, spark: SparkSession | None = None, **ignored):
        if ignored:
            warnings.warn(f"ignored: {sorted(ignored)}", stacklevel=2)
        self.frame = PointFrame.of(data, spark, header_box(boxsize) if boxsize is not None else None)
        self.leafsize, self._index = leafsize, None
        self.spark = self.frame.df.sparkSession

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = build_index(self.frame, threshold=self.leafsize)
        return self._index

    @property
    def n(self) -> int:
        return self.frame.df.count()

    @property
    def mins(self) -> tuple[float, ...]:
        return tuple(self.frame.df.agg(*[F.min(a) for a in AXES]).first())

    @property
    def maxes(self) -> tuple[float, ...]:
        return tuple(self.frame.df.agg(*[F.max(a) for a in AXES]).first())

    @property
    def sort_index(self) -> DataFrame:
        return self.index.points.select("pos", ID)

    def queries(self, x) -> DataFrame:
        """Query points as ``qid, x, y, z``: a frame with these, or one or many tuples."""
        if isinstance(x, DataFrame):
            return x
        rows = [x] if not hasattr(x[0], "__len__") else x
        rows = [(i, *[float(v) for v in r], *[0.0] * (3 - len(r))) for i, r in enumerate(rows)]
        return self.spark.createDataFrame(rows, "qid long, x double, y double, z double")

    def query(self, x, k=1, distance_upper_bound: float = FAR, p: float = 2, eps: float = 0, workers: int = 1) -> DataFrame:
        """``qid, rank, id, dist``; k is a number or a list of ranks, and what is missing is (inf, n)."""
        if p != 2:
            raise NotImplementedError(f"p = {p} isn't supported for batches")
        if eps or workers != 1:
            warnings.warn("eps and workers are ignored", stacklevel=2)
        wanted = list(range(1, k + 1)) if isinstance(k, int) else list(k)
        asked = self.queries(x)
        found = knn.nearest_batch(asked, self.frame.df, max(wanted), distance_upper_bound)
        return knn.ranks(found, asked, wanted, self.n)

    def query_ball_point(self, x, r: float, strict: bool = True, return_length: bool = False, return_sorted: bool = True, p: float = 2) -> DataFrame:
        """``qid`` with the sorted ids within r, or their number; not strict: of all leaves that are touched."""
        if p != 2:
            warnings.warn("p is ignored", stacklevel=2)
        asked = self.queries(x)
        if strict:
            if return_length:
                raise ValueError("lengths need strict=False")
            pairs = search.ball_point(asked, self.frame.df, r)
            lists = pairs.groupBy("qid").agg((F.sort_array(F.collect_list("id")) if return_sorted else F.collect_list("id")).alias("ids"))
            return asked.select("qid").join(lists, "qid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
        balls = asked.withColumn("r", F.lit(float(r)))
        if return_length:
            return search.ball_lengths(self.index, balls)
        return search.balls_nonstrict(self.index, balls).groupBy("qid").agg(F.sort_array(F.collect_list(ID)).alias("ids"))

    def query_ball_tree(self, other: PointTree, r: float) -> DataFrame:
        return joins.ball_tree(self.frame.df, other.frame.df, r, lists=True)

    def query_pairs(self, r: float) -> DataFrame:
        return joins.pairs(self.frame.df, r)

    def count_neighbors(self, other: PointTree, r, weights: tuple[str | None, str | None] = (None, None), cumulative: bool = True) -> DataFrame:
        return joins.count_neighbors(self.frame.df, other.frame.df, r if hasattr(r, "__len__") else [r], *weights, cumulative)

    def sparse_distance_matrix(self, other: PointTree, max_distance: float) -> DataFrame:
        return joins.distance_matrix(self.frame.df, other.frame.df, max_distance)
