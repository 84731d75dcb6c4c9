"""Profiles of a field over logarithmic shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(low: float, high: float, bins: int) -> list[float]:
    """The ``bins + 1`` edges of bins of equal width."""
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def digitise(value: Column, low: float, high: float, bins: int) -> Column:
    """The number of edges at or below a value: 0 below all, ``bins + 1`` from the last one on."""
    at = F.floor((value - F.lit(low)) / F.lit((high - low) / bins)).cast("long") + 1
    return F.greatest(F.lit(0).cast("long"), F.least(at, F.lit(bins + 1).cast("long")))


def log_profile(rows: DataFrame, radius: Column, field: Column, bins: int = 15, least: int = 100) -> DataFrame:
    """``bin, center, n, mean`` for bins 0 to ``bins - 1`` of log10 of the radius; 0 where at most ``least`` rows are.

    Bins are numbered as :func:`digitise` does, so bin 0 is empty and the last
    one is left out, as in the recipe that this follows.  Radii of 0 take no
    part; a table without others has empty bins around 1.
    """
    own = rows.select(F.log10(radius).alias("_l"), field.alias("_v")).filter(radius > 0)
    low, high = (v if v is not None else 0.0 for v in own.agg(F.min("_l"), F.max("_l")).first())
    high = high if high > low else low + 1.0
    found = own.groupBy(digitise(F.col("_l"), low, high, bins).alias("bin")).agg(F.count("_v").alias("_n"), F.avg("_v").alias("_mean"))
    width = (high - low) / bins
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    n = F.coalesce("_n", F.lit(0))
    return every.join(found, "bin", "left").select("bin", F.pow(F.lit(10.0), F.lit(low) + F.lit(width) * F.col("bin") + F.lit(width / 2)).alias("center"), n.alias("n"), F.when(n > least, F.col("_mean")).otherwise(0.0).alias("mean"))
