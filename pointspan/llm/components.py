"""Connected components of a graph in a DataFrame.

Alternating large-star and small-star rounds: every node's neighbours are
hooked to its smallest neighbour, first the larger ones, then all that are not
larger.  Edges never grow in number, no task holds a component, and the rounds
grow with the logarithm of the largest component.  Each round is written to
the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.shared import materialize

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``a, b``); root is the smallest node reachable.

    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    pairs = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct()
    pairs, last = materialize(pairs, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(pairs.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).filter("low < high").distinct()
        # Now the neighbours of high that are smaller than it, and itself, go to the smallest.
        first = large.groupBy("high").agg(F.min("low").alias("m"))
        hooked = large.join(first, "high").select("low", "high", "m")
        small = hooked.select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("low").alias("high")), F.struct(F.col("m").alias("low"), F.col("high").alias("high")))).alias("e")).select("e.low", "e.high").filter("low < high").distinct()
        pairs = materialize(small, "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components: no end of the rounds")
    return pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")).unionAll(pairs.select("low", "low").distinct().toDF("node", "root"))
