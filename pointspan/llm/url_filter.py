"""URL filtering: fixed rules first, then mined association rules.

Fixed rules name a host and a path prefix; the longest that fits decides.
Where none fits, rules mined by FP-growth from labelled urls do.  An url is a
set of tokens that cover all of it: scheme, every label and word of its host,
every ending of its host, every path segment and its depth, extension, every
query key, fragment; values of over ``LONG`` characters are hashed.  A set of
tokens blocks if, among labelled urls, it has support and confidence, and if
chance can't explain its bad urls at any of the sets of its size.  Rules that
contain another one are dropped.  Rules are held in an inverted index by their
least frequent token; an url looks up its own tokens only.

All frequent tokens of all rows are mined, and sets of any size.  FP-growth runs
by conditional rows: after single tokens and pairs, the rows with a token, cut
to the tokens before it, go to one task, which extends sets depth first.  Only
minimal sets are asked for, so a branch ends, without loss, where its sets can't
block or can't be minimal: too few bad urls are left; a subset blocks; or a
token takes away no good url, so that the set without it has no worse figures.
Rows of many independent tokens can still have exponentially many sets; these
take time, and a token's distinct rows the memory of one task, but nothing is
cut.  Sets of k tokens must stand against chance at all sets of k tokens that
can be frequent, with ``CHANCE / 2**k`` for each k; their number is bounded from
above, as frequent sets can't be counted without listing them.  Matching looks
at all tokens of an url; tokens that the same labelled urls have are one there,
as each of them makes the same rules.

Labels of pages (:func:`page_labels`) come from the given labels of documents
whose text the page carries, and from a lexicon of words in hosts.

Defined results: a null url or one without ``://`` has an empty host and path,
no tokens, and is allowed; labels that are null or of unknown pages teach
nothing; without labels no rule is mined; repeated rows are judged alike; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspan.shared import materialize

#: Host, path prefix and verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, LEAST_ROWS, CONFIDENCE, CHANCE = 0.002, 5, 0.6, 0.01
LONG = 60
FOLDS, HELD = 5, 0
#: Fixed value: words that mark hosts of gambling, pills, adult pages, link farms and advertisements.
LEXICON = ("casino", "poker", "bets", "pills", "viagra", "adult", "porn", "xxx", "escort", "spam", "ads", "loans")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of an url; none without a host."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    value = lambda v: F.when(F.length(v) <= LONG, v).otherwise(F.sha2(v, 256))
    each = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name + "="), value(v)))
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    words = F.filter(F.split(host, "[^a-z0-9]+"), lambda w: w != "")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\A[^?#]*[?]([^#]*)", 1), F.lit(r"(?:\A|[&;])([^=&;]+)"), F.lit(1))
    rest = F.array(
        F.concat(F.lit("scheme="), value(F.lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1)))), F.concat(F.lit("depth="), F.size(parts).cast("string")),
        F.when(path.rlike(r"\.[A-Za-z0-9]+$"), F.concat(F.lit("ext="), value(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))))), F.when(url.contains("#"), F.lit("fragment")),
    )
    every = F.concat(each("end", endings), each("label", labels), each("word", words), each("dir", parts), each("key", keys), rest)
    return F.when(host != "", F.array_distinct(F.array_compact(every))).otherwise(F.array().cast("array<string>"))


def limits(kinds: int, sizes: dict[int, int], least: int, longest: int) -> np.ndarray:
    """What the evidence of a set of k tokens must exceed, by k; ``sizes`` counts rows by their number of frequent tokens.

    Each frequent set is in ``least`` rows, and a row has C(size, k) sets of k tokens.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(kinds, 1) + 1)))])
    found = np.full(longest + 2, -np.inf)
    for k in range(1, longest + 2):
        choose = lambda of: logs[of] - logs[k] - logs[of - k]  # noqa: B023, E731
        rows = [math.log(count) + choose(size) for size, count in sizes.items() if size >= k]
        sets = min(choose(kinds), np.logaddexp.reduce(rows) - math.log(least)) if rows else -np.inf
        found[k] = max(sets, 0.0) + k * math.log(2) - math.log(CHANCE)
    return np.maximum.accumulate(found)


def evidence(hits: np.ndarray, misses: np.ndarray, base: float) -> np.ndarray:
    """Chernoff's exponent of so many bad urls among so many, at a share of ``base``; grows with hits, falls with misses."""
    n = np.maximum(hits + misses, 1)
    term = lambda part, share: part * np.log(np.maximum(part, 1) / n / share)
    return np.where(hits > base * n, term(hits, base) + term(misses, 1 - base), 0.0)


def grow(misses: np.ndarray, near: dict[int, np.ndarray], bars: np.ndarray, least: int, confidence: float, base: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function that finds the rules of three tokens and more whose last token is the group's.

    ``misses`` has those of single tokens, ``near`` the tokens before each that make an open pair with it.
    """

    def each(key: tuple, group: pa.Table) -> pa.Table:
        token = key[0].as_py()
        prefix = group.column("prefix").combine_chunks()
        flat, row = prefix.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(prefix)), prefix.value_lengths().to_numpy(zero_copy_only=False))
        good, bad = group.column("misses").to_numpy().astype(float), group.column("hits").to_numpy().astype(float)
        found: list[tuple[int, ...]] = []
        masks: list[int] = []
        stack = [((token,), math.inf, misses, flat, row)]
        while stack:
            path, own, without, flat, row = stack.pop()
            # The rows of the path, cut to tokens that can follow its last.
            has, follows = np.full(len(bad), len(path) == 1), np.zeros(len(misses), bool)
            has[row[flat == path[-1]]] = True
            follows[near.get(path[-1], [])] = True
            of = sum(1 << t for t in path)
            rests = [rest for rest in (mask & ~of for mask in masks) if rest & (rest - 1) == 0]
            follows[[rest.bit_length() - 1 for rest in rests]] = False
            part = has[row] & follows[flat]
            flat, row = flat[part], row[part]
            hits, missed = np.bincount(flat, bad[row], len(misses)), np.bincount(flat, good[row], len(misses))
            # A token must take good urls from the set, and the set's last token from the set without that.
            open_ = (hits >= least) & (missed < own) & (missed < without)
            if len(path) > 1:  # pairs are known
                sure = open_ & (hits >= confidence * (hits + missed)) & (evidence(hits, missed, base) > bars[len(path) + 1])
                found.extend((*path, int(t)) for t in np.flatnonzero(sure))
                masks.extend(of | 1 << int(t) for t in np.flatnonzero(sure))
                open_ &= ~sure
            open_ &= (missed > 0) & (-hits * math.log(base) > bars[len(path) + 1])
            stay = open_[flat]
            flat, row = flat[stay], row[stay]
            # The smallest first, so that all subsets with the group's token come before a set.
            stack.extend(((*path, int(t)), missed[t], missed, flat, row) for t in np.flatnonzero(open_)[:0:-1])
        return pa.table({"rule": pa.array(found, pa.list_(pa.int32()))})

    return each


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[frozenset[str]]:
    """Minimal token sets that mark bad urls, of the tokens that stand for others; ``labelled`` has ``tokens`` and ``bad``."""
    return mine_with_equals(labelled, support, confidence)[0]


def mine_with_equals(labelled: DataFrame, support: float, confidence: float) -> tuple[list[frozenset[str]], dict[str, str]]:
    """Minimal token sets, and for each token that the same labelled urls have as one of theirs, that one."""
    labelled = materialize(labelled.filter("bad IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "labelled")
    spark = labelled.sparkSession
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    least, base = max(LEAST_ROWS, math.ceil(support * n)), min(max(bad / max(n, 1), 1e-6), 1 - 1e-6)
    if n < LEAST_ROWS or not 0 < bad < n:
        return [], {}
    hits, misses = F.sum(F.col("bad").cast("int")).alias("hits"), F.sum((~F.col("bad")).cast("int")).alias("misses")
    single = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    extent = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("extent")
    often = single.groupBy("token").agg(hits, misses, extent).filter(F.col("hits") + F.col("misses") >= least)
    # Of tokens that the same labelled urls have, the shortest stands for all, as their rules have the same figures.
    often = often.groupBy("extent", "hits", "misses").agg(F.min(F.struct(F.length("token").alias("l"), "token"))["token"].alias("token"), F.collect_list("token").alias("equals"))
    # At most 1 / support tokens for each token of a mean row; the most frequent first.
    names = sorted(often.select("token", "equals", "hits", "misses").collect(), key=lambda r: (-r["hits"] - r["misses"], r["token"]))
    if not names:
        return [], {}
    of_hits, of_misses = (np.array([r[c] for r in names], float) for c in ("hits", "misses"))
    bar = limits(len(names), {len(names): n}, least, 1)[1]
    able = (of_hits >= least) & (-of_hits * math.log(base) > bar)
    sure = able & (of_hits >= confidence * (of_hits + of_misses)) & (evidence(of_hits, of_misses, base) > bar)
    open_ = able & ~sure & (of_misses > 0) & (of_misses < n - bad)
    found = [frozenset([names[i]["token"]]) for i in np.flatnonzero(sure)]

    ids = spark.createDataFrame([(r["token"], i, bool(open_[i])) for i, r in enumerate(names)], "token string, id int, open boolean")
    own = single.join(F.broadcast(ids), "token").groupBy("row", "bad").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("open"), F.col("id")))).alias("items"))
    rows = materialize(own.groupBy("size", "items").agg(hits, misses), "items")
    sizes = rows.groupBy("size").agg(F.sum(F.col("hits") + F.col("misses")).alias("n"), F.max(F.size("items")).alias("longest")).collect()
    longest = max(r["longest"] for r in sizes)
    if longest > 1:
        bars = limits(len(names), {r["size"]: r["n"] for r in sizes}, least, longest)
        parts = rows.select("items", "hits", "misses", F.posexplode("items").alias("at", "token")).filter("at > 0").withColumn("prefix", F.slice("items", F.lit(1), F.col("at")))
        pairs = parts.select("token", F.explode("prefix").alias("other"), "hits", "misses").groupBy("token", "other").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
        near: dict[int, list[int]] = defaultdict(list)
        # At most 1 / support pairs for each pair of a mean row.
        for t, other, pair_hits, pair_misses in pairs.filter(F.col("hits") >= least).collect():
            if pair_misses < min(of_misses[t], of_misses[other]):
                if pair_hits >= confidence * (pair_hits + pair_misses) and evidence(pair_hits, pair_misses, base) > bars[2]:
                    found.append(frozenset([names[t]["token"], names[other]["token"]]))
                elif pair_misses > 0 and -pair_hits * math.log(base) > bars[2]:
                    near[t].append(other)
        wide = [t for t, others in near.items() if len(others) > 1]
        if wide and longest > 2:
            parts = parts.join(F.broadcast(spark.createDataFrame([(t,) for t in wide], "token int")), "token")
            parts = parts.groupBy("token", "prefix").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
            tasks = min(len(wide), 4 * spark.sparkContext.defaultParallelism)
            each = grow(of_misses, {t: np.array(others) for t, others in near.items()}, bars, least, confidence, base)
            grown = parts.repartition(tasks, "token").groupBy("token").applyInArrow(each, "rule array<int>")
            found += [frozenset(names[i]["token"] for i in r["rule"]) for r in grown.collect()]

    kept_rules: list[frozenset[str]] = []
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    for rule in sorted(set(found), key=lambda s: (len(s), sorted(s))):
        if not any(other <= rule for token in rule for other in index[token]):
            kept_rules.append(rule)
            index[min(rule)].append(rule)
    used = {t for rule in kept_rules for t in rule}
    return kept_rules, {t: r["token"] for r in names if r["token"] in used for t in r["equals"]}


def url_filter(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``; ``labelled`` has ``url`` and the boolean ``bad``."""
    parsed = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    seen = parsed(labelled.select(F.col("url").cast("string"), "bad").filter("bad IS NOT NULL")).select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "bad")
    mined, stands = mine_with_equals(seen, SUPPORT, CONFIDENCE)
    often = Counter(t for rule in mined for t in rule)
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    for rule in mined:
        index[min(rule, key=lambda t: (often[t], t))].append(rule)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for own in batch.column("tokens").to_pylist():
                have = {stands[t] for t in own if t in stands}
                hits.append(any(rule <= have for t in have for rule in index.get(t, ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hits, pa.bool_()), batch.column("says")], ["page_id", "host", "path", "rule", "hit", "says"])

    rule, says = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))).select("page_id", "host", "path", rule.alias("rule"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), says.alias("says"))
    judged = rows.mapInArrow(each, "page_id long, host string, path string, rule string, hit boolean, says string")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def letters(text: Column) -> Column:
    """A key of a text's letters and digits, whatever stands between them."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""))


def page_text(html: Column) -> Column:
    """The text of a page's article (of all of it, if it has none) without title, tags and entities."""
    article = F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)
    body = F.regexp_replace(F.when(article != "", article).otherwise(html), r"(?s)<h1>.*?</h1>|<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(sign))
    return body


def page_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, url, bad`` of every page.

    A page that carries a labelled document's text is bad if that is toxic or
    of low quality; a page whose host has a word of ``LEXICON`` is bad; all
    others count as good.
    """
    bad = F.max(F.coalesce(F.col("toxic") >= 1, F.lit(False)) | F.coalesce(F.col("quality") < 1, F.lit(False)))
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad.alias("bad"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), letters(F.col("text")).alias("key")).join(known, "doc_id").groupBy("key").agg(F.max("bad").alias("told"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), letters(page_text(F.col("html"))).alias("key"))
    words = F.split(host_of(F.col("url")), "[^a-z0-9]+")
    listed = F.arrays_overlap(words, F.array(*map(F.lit, LEXICON)))
    return own.join(texts, "key", "left").select("page_id", "url", (F.coalesce("told", F.lit(False)) | F.coalesce(listed, F.lit(False))).alias("bad"))


def learning(labelled: DataFrame) -> DataFrame:
    """The rows that may teach; the others are held out to measure the rules."""
    return labelled.filter(F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % FOLDS != HELD, F.lit(False)))
