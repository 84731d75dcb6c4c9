"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule rejects a document when one of its features reaches a cutoff.  The
cutoffs are chosen on labelled documents so that, with confidence
``1 - delta`` over all strata together, no stratum loses more than the share
``alpha`` of its good documents, counted among those that pass the base test
(the base test's own rejections come on top and have no such bound):

* a cutoff is a step of a fixed descending grid;
* a third of the labelled documents (by a hash of the id) only lays out the
  path: vectors of one step for each rule, from lenient ones (``MARGIN`` steps
  above all good documents seen) down to those that reject more and more of
  them (``SHARES``);
* the others, which the path does not depend on, test its vectors in order,
  all rules together, and stop at the first failure (a fixed sequence needs no
  correction among its own members);
* a vector with ``k`` false rejections among ``n`` good documents passes if
  the exact binomial tail ``P(Bin(n, alpha) <= k)`` is at most ``delta`` over
  the number of strata (Bonferroni);
* of the vectors that passed, the most lenient one is used that rejects as
  many labelled bad documents as any (all of them hold at once, so the choice
  among them costs nothing).

Strata are the values of one column.  A stratum with too few good documents to
pass even without a false rejection is pooled with all others of that kind; if
these are too few together, the smallest of the rest join them.  So one needs
``log(delta / strata) / log(1 - alpha)`` test documents, some 150 for one
stratum and 230 for five.

Defined results: a null text has no words (all counts 0) and fails the base
test; a null stratum belongs to the pooled one; labels that are null are not
used, and a doc_id labelled twice counts as good only if all its labels are;
with too few labels in all no rule passes, and only the base test rejects; a
null id has no label; an empty table gives an empty result; columns of the
input beyond the key, text and stratum are not looked at, and
:func:`keep_good` keeps them whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
ALPHA, DELTA = 0.02, 0.05
STEPS = 40
MARGIN, SHARES = 12, tuple(i / 1000 for i in range(1, 21))
#: Of the labelled documents, one in so many lays out the path.
FOLDS = 3

#: Name, feature over the base counts, and largest cutoff of each rule's grid; a cutoff is 0.85 times the one before.
RULES = (
    ("symbols", "n_symbols / n_words", 20.0),
    ("bangs", "n_bangs / n_words", 10.0),
    ("dup_lines", "n_dup_lines / n_lines", 1.0),
    ("repeats", "n_repeat_words / n_words", 1.0),
    ("capitals", "n_capitals / word_chars", 1.0),
    ("word_length", "word_chars / n_words", 400.0),
)


def cutoffs(top: float) -> list[float]:
    return [top * 0.85**i for i in range(STEPS)]


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more.

    The windows' hashes are sorted with their positions; a window whose
    neighbour has its hash is repeated.  The windows' union is then added up
    in order of position, at most three words each.
    """
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    keyed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twins = lambda s: F.filter(s, lambda x, j: F.coalesce(x["h"] == F.when(j > 0, F.get(s, j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    cover = lambda at: F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")), lambda acc: acc["sum"])
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    positions = lambda h: F.sort_array(F.transform(let(keyed(h), twins), lambda x: x["i"]))
    zero = F.lit(0).cast("long")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(cover(positions(h))))


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts over the whole text of every row; one narrow pass."""
    raw = F.coalesce(F.col(text), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), raw.alias("_text"), *keep)
        .withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        .withColumn("_lines", lines)
        .select(
            "doc_id", "stratum", *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            kept(r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("_words")).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            kept("[^!]+").alias("n_bangs"),
            kept("[^A-Z]+").alias("n_capitals"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def feature(expr: str) -> Column:
    over, under = expr.split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed in logarithms; 1 where k is above the mean, as such a cutoff can't pass."""
    odds = math.log(p) - math.log1p(-p)
    first = n.cast("double") * F.lit(math.log1p(-p))
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
        return F.struct(term.alias("term"), add(acc["sum"], term).alias("sum"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k > n * F.lit(p), F.lit(1.0)).otherwise(F.exp(summed))


def first_step(expr: str, top: float) -> Column:
    """The first step of a rule's grid that rejects a document (``STEPS``: none)."""
    return F.lit(STEPS) - F.size(F.filter(F.array(*map(F.lit, cutoffs(top))), lambda c: feature(expr) >= c))


def least_rows(alpha: float, level: float) -> int:
    """How many good documents pass at ``level`` if none is rejected."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def strata_apart(tested: DataFrame, alpha: float, delta: float) -> tuple[DataFrame, int]:
    """The strata (``stratum, count``) that can be tested on their own, and the number of groups with the pooled one."""
    by = materialize(tested.groupBy("stratum").count(), "strata")
    known, total = by.filter("stratum IS NOT NULL"), by.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    n = 0
    while True:
        apart = known.filter(F.col("count") >= n)
        k, held, smallest = apart.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.min("count")).first()
        need = least_rows(alpha, delta / (k + 1))
        if k and smallest < need:
            n = need if need > n else n + 1
        elif k and 0 < total - held < need:
            n = smallest + 1
        else:
            return apart, k + 1


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``key`` and each rule's cutoff (null: the rule isn't used): a row per stratum kept apart, of key ``=stratum``, and the pooled ``*``.

    ``labelled`` has the base counts, ``doc_id``, ``stratum`` and the boolean ``good``.
    """
    steps = [first_step(expr, top).alias(name) for name, expr, top in RULES]
    lays = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)) == 0
    known = materialize(labelled.filter("good IS NOT NULL AND NOT base_failed").select("stratum", "good", lays.alias("lays"), *steps), "labelled")
    apart, groups = strata_apart(known.filter("good AND NOT lays"), alpha, delta)
    named = known.join(apart.select("stratum", F.concat(F.lit("="), "stratum").alias("own")), "stratum", "left")
    keyed = named.select(F.coalesce("own", F.lit("*")).alias("key"), "good", "lays", *[name for name, _, _ in RULES])
    # The path: of each key and rule, the last step that rejects at most a share of the good documents.
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("step")) for name, _, _ in RULES])).alias("x")
    seen = keyed.filter("good AND lays").select("key", pairs).groupBy("key", F.col("x.rule").alias("rule")).agg(F.count("*").alias("n"), *[F.sum((F.col("x.step") <= i).cast("long")).alias(f"c{i}") for i in range(STEPS)])
    lost = F.array(*[F.col(f"c{i}") for i in range(STEPS)])
    deepest = lambda share: F.size(F.filter(lost, lambda c: c <= F.lit(share) * F.col("n"))) - 1
    path = F.array(*[F.greatest(F.lit(-1), deepest(0.0) - m) for m in range(MARGIN, -1, -1)], *[deepest(share) for share in SHARES])
    laid = seen.select("key", "rule", path.alias("path")).groupBy("key").agg(*[F.max(F.when(F.col("rule") == name, F.col("path"))).alias(f"path_{name}") for name, _, _ in RULES])
    laid = materialize(laid, "paths")
    # The test: of each document, the first vector of the path that rejects it.
    length = MARGIN + 1 + len(SHARES)
    reached = lambda name: F.lit(length) - F.size(F.filter(f"path_{name}", lambda s: s >= F.col(name)))
    tested = keyed.join(laid, "key").select("key", F.least(*[reached(name) for name, _, _ in RULES]).alias("at"), (F.col("good") & ~F.col("lays")).cast("long").alias("good"), (~F.col("good")).cast("long").alias("bad"))
    hits = tested.groupBy("key", "at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    upto = lambda column, i: F.sum(F.when(F.col("at") <= i, F.col(column)).otherwise(0))
    wide = hits.groupBy("key").agg(F.sum("good").alias("n"), F.array(*[F.struct(upto("good", i).alias("k"), upto("bad", i).alias("b")) for i in range(length)]).alias("all"))
    tried = wide.select("key", "n", F.posexplode("all").alias("at", "x"))
    failed = F.max((binomial_tail(F.col("x.k"), F.col("n"), alpha) > delta / groups).cast("int")).over(W.partitionBy("key").orderBy("at"))
    passed = tried.withColumn("failed", failed).filter("failed = 0").groupBy("key").agg(F.max(F.struct(F.col("x.b").alias("b"), (-F.col("at")).alias("back")))["back"].alias("back")).select("key", (-F.col("back")).alias("at"))
    value = lambda name, top: F.get(F.array(*map(F.lit, cutoffs(top))), F.get(f"path_{name}", F.col("at"))).alias(name)
    return passed.join(laid, "key").select("key", *[value(name, top) for name, _, top in RULES])


def cutoffs_for(
    docs: DataFrame, labels: DataFrame, alpha: float, delta: float, stratum: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """The counts of all rows (and the columns in ``keep``), written to the shared folder, and the strata's cutoffs."""
    counts = materialize(base_counts(docs, key, text, stratum, keep), "quality")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    return counts, materialize(choose_cutoffs(counts.drop(*keep).join(good, "doc_id"), alpha, delta), "cutoffs")


def judged(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``counts`` with ``kept``."""
    pooled = chosen.filter("key = '*'").first()  # one row at most
    own = chosen.filter("key <> '*'").select(F.expr("substring(key, 2)").alias("stratum"), F.lit(True).alias("_own"), *[F.col(name).alias(f"_{name}") for name, _, _ in RULES])
    verdict = ~F.col("base_failed")
    for name, expr, _ in RULES:
        cutoff = F.when(F.col("_own"), F.col(f"_{name}")).otherwise(F.lit(pooled[name] if pooled else None).cast("double"))
        verdict = verdict & F.coalesce(feature(expr) < cutoff, F.lit(True))
    return counts.join(own, "stratum", "left").withColumn("kept", verdict).select(*counts.columns, "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    The counts are made in one pass over the texts; choosing the cutoffs and
    applying them read only their narrow table.
    """
    counts, chosen = cutoffs_for(docs, labels, alpha, delta, stratum)
    return judged(counts, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    Rows and counts are written side by side in one pass; the cutoffs are
    chosen from the narrow columns, and the last scan only filters.
    """
    whole = docs.select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row"), F.col("text").alias("_raw"), F.col(stratum).alias("_stratum"))
    counts, chosen = cutoffs_for(whole, labels, alpha, delta, "_stratum", "_id", "_raw", ("_row",))
    return judged(counts, chosen).filter("kept").select("_row.*")
