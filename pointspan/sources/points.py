"""Point sets: a DataFrame with id, coordinates, an optional type and any fields."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.functions.geometry import AXES, EPS32, UNIT, Box, finite

TYPE, ID = "particle_type", "id"
DEFAULT_TYPE = "PartTypeIM"


@dataclass(frozen=True)
class PointFrame:
    """Points with their box; every operation gives a new, lazy frame."""

    df: DataFrame
    box: Box | None = None
    name: str = "points"
    path: str | None = None
    meta: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, data, spark: SparkSession | None = None, box=None, particle_type: str = DEFAULT_TYPE, name: str = "points", dims: Iterable[str] = AXES) -> PointFrame:
        """From a path, DataFrame, pandas frame, N x (1 to 3) array or another point frame.

        Missing axes are 0, more than three are an error; a missing id is
        given by :func:`number_rows`.
        """
        if isinstance(data, PointFrame):
            return data
        if isinstance(data, str):
            return load(spark or SparkSession.active(), data, box)
        if not isinstance(data, DataFrame):
            spark = spark or SparkSession.active()
            if hasattr(data, "ndim") and not hasattr(data, "columns"):
                if data.ndim != 2 or not 1 <= data.shape[1] <= 3:
                    raise ValueError(f"positions must be N x 1 to N x 3, not {data.shape}")
                data = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(data)], ", ".join(["id long", *[f"{a} double" for a in AXES[: data.shape[1]]]]))
            else:
                data = spark.createDataFrame(data)
        dims = [d for d in dims if d in data.columns]
        if not dims:
            raise ValueError("no column x, y or z")
        for axis in AXES:
            data = data.withColumn(axis, F.col(axis).cast("double") if axis in data.columns else F.lit(0.0))
        if ID not in data.columns:
            data = number_rows(data)
        if TYPE not in data.columns:
            data = data.withColumn(TYPE, F.lit(particle_type))
        return cls(data, Box.of(box) if box is not None else None, name)

    def bounding_box(self) -> Box:
        """The given box, or the one around all points."""
        if self.box:
            return self.box
        row = self.df.agg(*auto_box()).first()
        return UNIT if row["ox"] is None else Box(*[row[c] for c in ("ox", "oy", "oz", "odx", "ody", "odz")])

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in (ID, TYPE, *AXES)]

    def types(self) -> list[str]:
        return [r[0] for r in self.df.select(TYPE).distinct().orderBy(TYPE).collect()]

    def counts(self) -> DataFrame:
        return self.df.groupBy(TYPE).agg(F.count("*").alias("n"))

    def of_type(self, *names: str, check: bool = False) -> PointFrame:
        """The points of some types; with ``check``, a name that isn't there is an error."""
        if check and (unknown := set(names) - set(self.types())):
            raise ValueError(f"no such particle type: {sorted(unknown)}")
        return replace(self, df=self.df.filter(F.col(TYPE).isin(*names)), box=self.box)

    def slices(self, ranges: Iterable[tuple[int, int]] | Mapping[str, Iterable[tuple[int, int]]], order: str = ID) -> PointFrame:
        """Rows whose ``order`` is in any of the ranges (from, to before), for all types or by type."""
        inside = lambda rs: _any((F.col(order) >= a) & (F.col(order) < b) for a, b in rs)
        test = _any((F.col(TYPE) == t) & inside(rs) for t, rs in ranges.items()) if isinstance(ranges, Mapping) else inside(ranges)
        return replace(self, df=self.df.filter(test))

    def decimate(self, step: int, order: str = ID) -> PointFrame:
        return replace(self, df=self.df.filter(F.col(order) % step == 0))

    def attach(self, other: DataFrame, *names: str) -> PointFrame:
        """Add fields of another frame by id; points without a match get nulls."""
        taken = other.select(ID, *(names or [c for c in other.columns if c != ID]))
        if clash := set(taken.columns[1:]) & set(self.df.columns):
            raise ValueError(f"fields are there already: {sorted(clash)}")
        return replace(self, df=self.df.join(taken, ID, "left"))

    def select_fields(self, fields: str | Iterable[str] | None) -> list[str]:
        """None: no fields; "all": every field; a lone name is one field."""
        if fields is None:
            return []
        names = self.fields if fields == "all" else [fields] if isinstance(fields, str) else list(fields)
        if unknown := [n for n in names if n not in self.df.columns]:
            raise ValueError(f"no such field: {unknown}")
        return names

    def reorder(self, *by: str) -> DataFrame:
        """Rows with ``pos``, their place in an order."""
        return ranked(self.df, list(by))

    def save(self, path: str, overwrite: bool = False, fields="all", particle_types: Iterable[str] | None = None) -> str:
        """Write as Parquet, a folder for each type; see :mod:`pointspan.sources.store`."""
        from pointspan.sources.store import write_points

        return write_points(self, path, overwrite, fields, particle_types)


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def inverse(order: DataFrame) -> DataFrame:
    """The inverse of an order ``pos, value``: of each value, taken as a place, the place it had."""
    return order.select(F.col("value").cast("long").alias("pos"), F.col("pos").cast("long").alias("value"))


def number_rows(df: DataFrame) -> DataFrame:
    """An ``id`` for rows that have none: unique, in the order of files and rows, not gapless."""
    return df.withColumn(ID, F.monotonically_increasing_id())


def ranked(df: DataFrame, by: list[str], parts: int = 256) -> DataFrame:
    """``pos``, the gapless place of each row in the order of ``by``, without one task that sorts all.

    The first key is cut at approximate quantiles; places are counted within
    the runs, and the runs' sizes are added up.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(by[0], [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(by[0]) > c)) if cuts else F.lit(0)
    cut = df.withColumn("_run", run)
    before = F.coalesce(F.sum("count").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut.groupBy("_run").count().select("_run", before.alias("_start"))  # at most ``parts`` rows
    place = F.row_number().over(W.partitionBy("_run").orderBy(*by)) - 1
    return cut.withColumn("_at", place).join(F.broadcast(starts), "_run").withColumn("pos", F.col("_start") + F.col("_at")).drop("_run", "_at", "_start")


def auto_box(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Aggregates for the box around points, widened by a float's precision; null without points."""
    ok = finite(x, y, z)
    corner, size = [], []
    for axis, c in zip(AXES, (x, y, z), strict=True):
        low, high = F.min(F.when(ok, F.col(c))), F.max(F.when(ok, F.col(c)))
        start = low - F.abs(low) * EPS32
        span = high - low
        corner.append(start.alias(f"o{axis}"))
        size.append((span + F.greatest(span, F.greatest(F.abs(start), F.lit(1.0))) * 2 * EPS32).alias(f"od{axis}"))
    return [*corner, *size]


def header_box(values) -> Box:
    """A box from 1, 3 or 6 numbers: a cube's edge, sizes, or corner and sizes."""
    values = [float(v) for v in (values if hasattr(values, "__len__") else [values])]
    if len(values) == 1:
        values = [values[0]] * 3
    if len(values) == 3:
        values = [0.0] * 3 + values
    if len(values) != 6:
        raise ValueError(f"a box has 1, 3 or 6 values, not {len(values)}")
    return Box.of(values)


def uniform(spark: SparkSession, n: int, size: float = 1000.0, seed: int = 42) -> PointFrame:
    """Points spread evenly in a cube."""
    df = spark.range(n).select("id", F.lit(DEFAULT_TYPE).alias(TYPE), *[(F.rand(seed + i) * size).alias(a) for i, a in enumerate(AXES)])
    return PointFrame(df, Box(0.0, 0.0, 0.0, size, size, size), "uniform")


def blobs(spark: SparkSession, n: int, size: float = 100.0, seed: int = 42) -> PointFrame:
    """Three Gaussian blobs with 45, 30 and 15 % of the points, the rest spread evenly; normal velocities."""
    which = F.when(F.col("u") < 0.45, 0).when(F.col("u") < 0.75, 1).when(F.col("u") < 0.9, 2).otherwise(3)
    centers, widths = ((0.3, 0.3, 0.3), (0.7, 0.6, 0.5), (0.4, 0.8, 0.7)), (0.08, 0.05, 0.03)
    df = spark.range(n).withColumn("u", F.rand(seed)).withColumn("blob", which)
    for i, a in enumerate(AXES):
        value = F.rand(seed + 1 + i)
        for b in range(3):
            value = F.when(F.col("blob") == b, F.lit(centers[b][i]) + F.randn(seed + 4 + i) * widths[b]).otherwise(value)
        df = df.withColumn(a, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * size).withColumn(f"v{a}", F.randn(seed + 7 + i))
    return PointFrame(df.drop("u").withColumn(TYPE, F.lit(DEFAULT_TYPE)), Box(0.0, 0.0, 0.0, size, size, size), "blobs")


def load(spark: SparkSession, path: str, box=None) -> PointFrame:
    from pointspan.sources.store import read_points

    return read_points(spark, path, box)
