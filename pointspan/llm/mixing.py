"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / w`` with ``u`` from a hash
of its id, text and seed and ``w`` its quality weight.  Within a source, the order
by key is a weighted sample without replacement of any length.  A source's
token budget is met by complete epochs first (every document the same number
of times); what is left is a prefix of that order.

The prefix sum is distributed: keys are cut into bins, the bins' sizes are
added up per source, and only the bin in which the budget ends is cut again.
After ``LEVELS`` rounds the last bin holds about a millionth of its source,
and a window orders its few rows and finds the last key that is taken.  No task
sees a whole source.

Defined results: a null text has size 0; a null source is a source of its own
that comes last; documents of size 0 are taken 0 words (and in
:func:`mixed` as many times as there are whole epochs); an empty table gives
an empty result; rows that share id and text are drawn together, rows that
share an id (or have none) are told apart by their texts; input columns beyond
id, text and source are kept by :func:`mixed` only, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.llm.words import word_count
from pointspan.shared import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
BINS, LEVELS = 1024, 2
SEED = 20


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of characters that are no symbols."""
    raw = F.coalesce(text, F.lit(""))
    odd = F.length(raw) - F.length(F.translate(raw, "#*$%&|<>!", ""))
    return F.greatest(F.lit(0.1), 1 - odd / F.greatest(F.length(raw), F.lit(1)))


def key_column(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """The Efraimidis-Spirakis key: smaller keys come first."""
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target``: shares by weight, stopped at ``MOST`` times the source.

    With sources in order of ``MOST * size / weight``, the first ones stop at
    their limit; the others share what is left by weight.  A source is
    stopped if it would be above its limit once all before it are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(order, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    every = W.orderBy("limit_ratio", F.col("source").asc_nulls_last())
    before = every.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    run = (
        weighed.withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("limit_ratio", F.col("most") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("stopped", F.col("level") >= F.col("limit_ratio"))
    )
    level = F.min(F.when(~F.col("stopped"), F.struct("limit_ratio", F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return run.withColumn("rest", level).select("source", "source_size", F.when(F.col("stopped"), F.col("most")).otherwise(F.col("rest") * F.col("w")).alias("target"))


def keyed(docs: DataFrame, seed: int, *keep: str | Column) -> DataFrame:
    """The columns in ``keep``, and ``_source, _size, _key, _tie`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.xxhash64(F.col("doc_id").cast("long"), text)
    return docs.select(*keep, F.col("source").cast("string").alias("_source"), word_count(F.col("text")).alias("_size"), key_column(own, quality_weight(text), seed).alias("_key"), own.alias("_tie"))


def spot(level: int) -> Column:
    """The bin of a key: 1 - exp(-key) spreads the keys over [0, 1); a bin is a run of it."""
    return F.floor((1 - F.exp(-F.col("_key"))) * F.lit(float(BINS**level)))


def plan_mix(rows: DataFrame) -> DataFrame:
    """Per source ``s, source_size, target, epochs, bar``: rows whose (key, tie) is up to ``bar`` are taken once more.

    ``rows`` has the columns that :func:`keyed` makes, and is stored.
    """
    targets = materialize(source_targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))), "targets")
    budgets = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    same, full = F.col("_source").eqNullSafe(F.col("s")), rows.filter("_size > 0")
    ends = budgets.select("s", F.lit(0).cast("long").alias("end"), "need")
    for level in range(1, LEVELS + 1):
        bins = full.join(ends, same & (spot(level - 1) == F.col("end"))).groupBy("s", spot(level).alias("bin"), "need").agg(F.sum("_size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("s").orderBy("bin"))
        ends = bins.withColumn("upto", upto).filter(F.col("upto") > F.col("need")).groupBy("s").agg(F.min(F.struct("bin", "need", "upto", "words")).alias("x"))
        ends = materialize(ends.select("s", F.col("x.bin").alias("end"), (F.col("x.need") - (F.col("x.upto") - F.col("x.words"))).alias("need")), "ends")
    # Equal rows are one here, so the window holds the distinct texts of a millionth of a source.
    last = full.join(ends, same & (spot(LEVELS) == F.col("end"))).groupBy("s", "need", "_key", "_tie").agg(F.sum("_size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("s").orderBy("_key", "_tie").rowsBetween(W.unboundedPreceding, 0))
    # The document in which the budget ends is in if that comes nearer to it.
    taken = last.withColumn("in", upto - F.col("words") / 2 < F.col("need"))
    bars = taken.groupBy("s").agg(F.max(F.when(F.col("in"), F.struct("_key", "_tie"))).alias("bar"))
    # Sources whose last bin gives nothing take the bins before it.
    bars = ends.select(F.col("s").alias("_s"), "end").join(bars.select(F.col("s").alias("_t"), "bar"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    return materialize(budgets.drop("need").join(bars, F.col("s").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` of :func:`keyed` with their source's plan and the ``copies`` of each."""
    under = F.coalesce((spot(LEVELS) < F.col("end")) | (F.struct("_key", "_tie") <= F.col("bar")), spot(LEVELS) < F.col("end"), F.lit(False))
    more = ((F.col("_size") > 0) & under).cast("long")
    return rows.join(plan, F.col("_source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("epochs") + more)


def mixing(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document, the words that the mix takes of it."""
    rows = materialize(keyed(docs, seed, F.col("doc_id").cast("long").alias("doc_id")), "mix")
    return with_copies(rows, plan_mix(rows)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), F.col("_source").alias("source"), F.col("_key").alias("key"), "copies"
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix: every row as many times as it is taken.

    A row's copies follow from its key and its source's plan, so whole texts
    meet a table of a row per source only.
    """
    plan = plan_mix(materialize(keyed(docs, seed), "mix"))
    rows = with_copies(keyed(docs, seed, F.struct(*docs.columns).alias("_row")), plan)
    return rows.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
