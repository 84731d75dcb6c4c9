"""Sharding by a k-d tree over metadata (DataFrame functions only).

The rows of a node are cut at a weighted quantile along its widest dimension,
in proportion to the shards that either side gets, until every leaf is one
shard.  All nodes of a level are handled together by a few aggregations over
a narrow table; what comes to the driver is a row per node.  That table is
written anew with each level's nodes, and numbers of nodes go to the executors
as literal arrays, so all plans are short, alike and without broadcasts.

Rows are ordered by the chosen dimension, then by the text's CRC32, then by a
hash of the id.  A cut is searched digit by digit over that order: a
histogram of 2,048 bins per node, then the bin where the quantile lies is
cut again, until the bin holds little.  So equal texts stay together unless
so many are alike that one shard can't hold them, and a hot value is split.

Defined results: a null text has 0 bytes, the CRC32 of the empty text, and
size 16; null metadata count as the smallest value; an empty table gives an
empty result; repeated rows get slots of their own; other columns are not
looked at.  ``grown_shard`` is null, as this is no hash of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.shared import materialize

SHARDS = 40
#: A cut may miss its quantile by this share of a shard's bytes.
SLACK = 0.005
ROWS_PER_GROUP = 50_000

#: Metadata dimensions and their bits.  The order of rows along one is 44 bits, the dimension and then the CRC32, and 22 bits of the id's hash.
DIMS = (("size_class", 11), ("length_class", 11), ("text_crc32", 32))
DIGIT, HIGH, LOW = 11, 44, 22


def sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit(""))
    log = lambda c: F.least(F.lit(2047), F.floor(F.log2(c.cast("double") + 1) * 64)).cast("long")
    bytes_, chars = F.octet_length(raw).cast("long"), F.length(raw).cast("long")
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (bytes_ + 16).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        log(bytes_).alias("size_class"), log((bytes_ - chars) * 4096 / F.greatest(bytes_, F.lit(1))).alias("length_class"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 42).alias("low"), F.lit(1).cast("long").alias("node"),
    )
    thin = materialize(thin, "shards")
    n, total = thin.agg(F.count("*"), F.sum("size")).first()
    placed = kd_tree(thin, shards, total or 0)
    groups = max(16, -(-n // (shards * ROWS_PER_GROUP)))
    placed = placed.withColumn("_group", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(groups)).cast("int"))
    sizes = placed.groupBy("shard", "_group").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("_group").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("shard", "_group", F.coalesce(before, F.lit(0)).alias("_start"))
    row = F.row_number().over(W.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("_row", row).join(starts, ["shard", "_group"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def kd_tree(thin: DataFrame, shards: int, total: int) -> DataFrame:
    """The rows, whose ``node`` is 1 (the root), with their ``shard``.  The tree has ``shards`` leaves, so nodes are numbered below 4 * ``shards``."""
    slack = SLACK * total / shards
    places = {1: (0, shards)}  # node -> its first shard and how many; the children of k are 2k and 2k + 1
    at = thin
    while todo := {k: v for k, v in places.items() if v[1] > 1}:
        ranges = at.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(name).alias(f"{f.__name__}_{name}") for name, _ in DIMS for f in (F.min, F.max)])
        found = {}
        for r in ranges.collect():
            if r["node"] in todo:
                spread = [(r[f"max_{name}"] - r[f"min_{name}"]) / 2**bits for name, bits in DIMS]
                width = todo[r["node"]][1]
                found[r["node"]] = (spread.index(max(spread)), r["bytes"] * (width // 2) / width)
        cuts = find_cuts(at, found, slack)
        for k, (first, width) in todo.items():
            del places[k]
            places[2 * k], places[2 * k + 1] = (first, width // 2), (first + width // 2, width - width // 2)
        if cuts:  # else there are no rows
            dim, high, low = (by_node({k: cut[i] for k, cut in cuts.items()}) for i in range(3))
            right = (order(dim) > high) | ((order(dim) == high) & (F.col("low") >= low))
            at = materialize(at.withColumn("node", F.when(dim < 0, F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))), "shards")
    return at.withColumn("shard", by_node({k: first for k, (first, _) in places.items()}, "int")).drop("node")


def by_node(values: dict[int, int | float], kind: str = "long") -> Column:
    """What ``values`` has for the row's node, else -1.  A joined table would be broadcast, and stay on the driver until its garbage is collected."""
    numbers = ",".join(str(values.get(k, -1)) for k in range(max(values) + 1))
    return F.coalesce(F.get(F.split(F.lit(numbers), ",").cast(f"array<{kind}>"), F.col("node").cast("int")), F.lit(-1).cast(kind))


def order(dim: Column) -> Column:
    """The 44 bits that order rows along a dimension."""
    by_class = lambda name: F.shiftleft(F.col(name), 32).bitwiseOR(F.col("text_crc32"))
    return F.when(dim == 0, by_class("size_class")).when(dim == 1, by_class("length_class")).otherwise(F.shiftleft(F.col("text_crc32"), 11))


def find_cuts(at: DataFrame, nodes: dict[int, tuple[int, float]], slack: float) -> dict[int, tuple[int, int, int]]:
    """node -> (dimension, bytes to its left) gives node -> (dimension, high, low): rows below that go left.

    One aggregation for each digit of the order until what the digit's bin
    holds of the quantile is within ``slack`` of one of the bin's ends.
    """
    live = {k: (dim, 0, need) for k, (dim, need) in nodes.items()}
    found: dict[int, tuple[int, int, int]] = {}
    for shift in range(HIGH + LOW - DIGIT, -1, -DIGIT):
        if not live:
            break
        of = lambda f, kind="long": by_node({k: f(*v) for k, v in live.items()}, kind)
        to, need = of(lambda dim, prefix, need: dim), of(lambda dim, prefix, need: need, "double")
        high, low = order(to), F.col("low")
        done = shift + DIGIT  # bits below those that are fixed
        fixed = F.shiftright(high, max(0, done - LOW)) == of(lambda dim, prefix, need: prefix >> max(done, LOW))
        if done < LOW:
            fixed = fixed & (F.shiftright(low, done) == of(lambda dim, prefix, need: (prefix & (2**LOW - 1)) >> done))
        digit = F.shiftright(high, shift - LOW) if shift >= LOW else F.shiftright(low, shift)
        bins = at.filter((to >= 0) & fixed).groupBy("node", digit.bitwiseAND(F.lit(2**DIGIT - 1)).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(W.partitionBy("node").orderBy("bin"))
        ends = bins.withColumn("upto", upto).filter((F.col("upto") >= need) & (F.col("upto") - F.col("bytes") < need))
        for x in ends.collect():
            dim, prefix, need = live[x["node"]]
            inner = need - (x["upto"] - x["bytes"])  # of the bin's bytes, those that go left
            if shift == 0 or min(inner, x["bytes"] - inner) <= slack:
                end = prefix + ((x["bin"] + (inner > x["bytes"] - inner)) << shift)
                found[x["node"]] = (dim, end >> LOW, end & (2**LOW - 1))
                del live[x["node"]]
            else:
                live[x["node"]] = (dim, prefix + (x["bin"] << shift), inner)
    return found
