"""Language-model scores by a hashed maximum-entropy model.

Counts.  Every training token is counted (pre-aggregated in each task, then
summed by token).  The commonest tokens' counts (``FREQUENT`` at most, those
above a count found in a histogram) are sent to all tasks; other tokens of a
document meet their counts in a join by token, where no token is frequent, so
none is hot.

Model.  Classes are nested, ``FAN`` in each.  The end and the ``HEAD - 1``
commonest words have three digits, that is a class of their own; all other
tokens have the digits of their hash, down to one of ``2**Size.bits`` leaves.
With the two tokens before as context,

    P(token) = product of P(digit | digits before it, context) * P(token | leaf)

and every digit's chance is a softmax over the counts' odds plus three hashed
features' weights: the token before, the one before that (a skip), and both
together, each with the digits so far.  Features are hashed from the tokens
themselves, whatever their rank.  Leaves and rows of features grow with the
square root of the vocabulary (``Size``), so that a task can hold the model; of
tokens that meet in a leaf each has its smoothed share of the leaf's count,
(c + 0.5) / (n + 0.5 v + 0.5) with the leaf's n tokens of v kinds, in every
context.

Training.  In each of ``ROUNDS`` rounds, every task starts from the same
weights, makes gradient steps (AdaGrad, on every position) over its training
documents of the round, and returns its change; changes are
added up block by block, by teams of ``TEAM`` tasks and teams of those, each as
they arrive and weighted by positions.  Each training
document takes part in one round.  Scoring reads weights by numpy over batches
of documents.

Defined results: a null or empty text is the end alone; without training rows
all counts are 0 (``train_tokens`` 0) and the model is even; an empty table
gives an empty result; repeated ids are rows of their own; a null id is held
out; very long texts are scored in chunks; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspan.llm.simhash import words
from pointspan.shared import materialize

FREQUENT = 1 << 17
#: Classes in a class, their bits, and how many tokens have digits of their own: half of what three digits can tell.
FAN, DIGIT, HEAD = 16, 4, 2048
#: Bits of a hash, and those that the first three digits of a hashed token take.
HASH, TOP = 32, 11
ROUNDS, STEP = 3, 16384
#: A step moves a weight by RATE * slope / sqrt(sum of squared slopes + EASE), so what is seen a few times moves little.
RATE, EASE = 0.3, 30.0
BLOCKS, TEAM, CHUNK, FLUSH = 32, 64, 1 << 15, 400_000
FOLDS, HELD = 5, 1
NONE, END = 0, 1
IMPOSSIBLE = np.float32(-1e4)


class Size:
    """The model's size for a vocabulary: bits of a leaf's number, levels of digits, rows of each feature table."""

    def __init__(self, vocabulary: int = 0):
        root = max(vocabulary, 1) ** 0.5
        log = lambda x: max(int(np.ceil(np.log2(x))), 0)
        self.bits = min(max(log(128 * root), TOP), HASH)
        self.row_bits = max(log(4 * root), 13)
        self.levels = 3 + -(-(self.bits - TOP) // DIGIT)
        self.total = self.levels * 3 * FAN << self.row_bits

    def wide(self, level: int) -> int:
        """The bits of a digit: fewer than ``DIGIT`` at the last level only."""
        return DIGIT if level < 3 else min(DIGIT, self.bits - TOP - DIGIT * (level - 3))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def count_tokens(train: DataFrame) -> DataFrame:
    """``token, c`` over all training texts (the end apart)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names = list(seen)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["token", "c"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > FLUSH:
                    yield from out()
        yield from out()

    return train.select("text").mapInArrow(each, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


K1, K2, K3, K4, K5 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x27D4EB2F165667C5))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * K4
    return x ^ (x >> np.uint64(32))


def contexts(before: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features: the token before, the skip, and both."""
    b, s = before.astype(np.uint64) * K1, skip.astype(np.uint64) * K2
    return mix(b), mix(s + K5), mix(mix(b) + s)


def place(size: Size, level: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the class that a token is in at a level, and its digit there.

    From level 3 on there are hashed tokens only, and the digits before are
    numbered without their first bit.
    """
    if level < 3:
        top = np.where(code <= HEAD, code - 1, HEAD + (np.maximum(code - HEAD - 1, 0) >> (HASH - TOP)))
        return top >> (12 - DIGIT * level), (top >> (8 - DIGIT * level)) & (FAN - 1)
    left, wide = HASH - TOP - DIGIT * (level - 3), size.wide(level)
    hashed = code - HEAD - 1
    return hashed >> left, (hashed >> (left - wide)) & ((1 << wide) - 1)


def rows_of(size: Size, level: int, node: np.ndarray, features: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """The row of each feature with the digits so far."""
    own, kind = (node.astype(np.uint64) + np.uint64((level + 1) << 40)) * K3, np.uint16 if size.row_bits <= 16 else np.int64
    return [(mix(f + own) >> np.uint64(64 - size.row_bits)).astype(kind) for f in features]


def views(weights: np.ndarray, size: Size) -> np.ndarray:
    """By level, feature, row and digit."""
    return weights.reshape(size.levels, 3, 1 << size.row_bits, FAN)


def odds_of(size: Size, head: np.ndarray, leaves: np.ndarray) -> list[np.ndarray]:
    """By level, the logarithms of each class's chances at its digits, from the masses of head tokens and leaves."""
    out, own = [], leaves
    log = lambda part, whole: np.where(part > 0, np.log(np.maximum(part, 1e-30) / np.maximum(whole, 1e-30)), IMPOSSIBLE).astype(np.float32)
    for level in range(size.levels - 1, -1, -1):
        if level == 2:
            own = np.concatenate([head, own])
        part = own.reshape(-1, 1 << size.wide(level))
        own = part.sum(axis=1)
        table = np.full((len(own), FAN), IMPOSSIBLE, dtype=np.float32)
        table[:, : part.shape[1]] = log(part, own[:, None])
        out.append(table)
    return out[::-1]


ONES, DIGITS = np.ones(FAN, dtype=np.float32), np.arange(FAN)


def chances(x: np.ndarray) -> np.ndarray:
    """The softmax of rows of logits, in place; logits are differences from odds, so they never come near the bound."""
    np.exp(np.minimum(x, 60, out=x), out=x)
    x /= (x @ ONES)[:, None]
    return x


def log_chances(size: Size, w: np.ndarray, odds: list[np.ndarray], before: np.ndarray, skip: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Natural logarithms of the model's chances; of hashed tokens, of their leaf."""
    out = np.empty(len(code))
    for at in range(0, len(code), CHUNK):
        c = code[at : at + CHUNK]
        features, own, live = contexts(before[at : at + CHUNK], skip[at : at + CHUNK]), np.zeros(len(c)), np.arange(len(c))
        for level in range(size.levels):
            if level == 3:
                live = np.flatnonzero(c > HEAD)
                c, features = c[live], tuple(f[live] for f in features)
            node, digit = place(size, level, c)
            x = odds[level].take(node, axis=0)
            for table, r in zip(w[level], rows_of(size, level, node, features), strict=True):
                x += table.take(r, axis=0)
            np.minimum(x, 60, out=x)
            own[live] += x[np.arange(len(c)), digit]
            own[live] -= np.log(np.exp(x, out=x) @ ONES)
        out[at : at + CHUNK] = own
    return out


def descend(size: Size, w: np.ndarray, past: np.ndarray, odds: list[np.ndarray], before: np.ndarray, skip: np.ndarray, code: np.ndarray) -> None:
    """One AdaGrad step for all digits of some tokens."""
    features = contexts(before, skip)
    for level in range(size.levels):
        if level == 3:
            live = np.flatnonzero(code > HEAD)
            code, features = code[live], tuple(f[live] for f in features)
        if not len(code):
            return
        node, digit = place(size, level, code)
        rows = rows_of(size, level, node, features)
        x = odds[level].take(node, axis=0)
        for table, r in zip(w[level], rows, strict=True):
            x += table.take(r, axis=0)
        miss = chances(x)
        miss[np.arange(len(code)), digit] -= 1
        flat = miss.ravel().astype(np.float64)  # else bincount casts each slope on its own, at five times the cost
        for table, seen, r in zip(w[level], past[level], rows, strict=True):
            # A step has more tokens than a table has rows, as a rule, so whole tables are updated at little cost.
            at = (r.astype(np.int64) * FAN)[:, None] + DIGITS
            slope = np.bincount(at.ravel(), flat, table.size).astype(np.float32).reshape(table.shape)
            square = slope * slope
            seen += square
            np.add(seen, EASE, out=square)
            slope /= np.sqrt(square, out=square)
            slope *= RATE
            table -= slope


class Codes:
    """Tokens as numbers: 0 is none, 1 is the end, up to HEAD are the commonest words, and above are hashes of other tokens.

    In lists of tokens, None is the end.
    """

    def __init__(self, names: list[bytes]):
        """``names``: the commonest tokens, in order."""
        over = HEAD + 1
        self.index = {w: i for i, w in enumerate(names)} | {None: len(names)}
        self.code = np.array([*range(2, min(len(names), HEAD - 1) + 2), *[over + crc32(w) for w in names[HEAD - 1 :]], END], dtype=np.int64)
        self.known = dict(zip(self.index, self.code.tolist(), strict=True))

    def of(self, tokens: list[bytes | None]) -> np.ndarray:
        get, over = self.known.get, HEAD + 1
        return np.array([get(t) or over + crc32(t) for t in tokens], dtype=np.int64)


def context(code: np.ndarray, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The tokens before and skipped of every token, for texts that begin at ``starts``."""
    before, skip = np.empty_like(code), np.empty_like(code)
    before[1:], before[starts] = code[:-1], NONE
    skip[1:], skip[starts] = before[:-1], NONE
    return before, skip


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list, list[bytes | None], np.ndarray]]:
    """Some rows' first columns, all their tokens, and where each row's begin; about ``most`` tokens at a time."""
    keys, tokens, starts = [], [], []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist() if column else [None] * batch.num_rows, batch.column(column), strict=True):
            keys.append(key)
            starts.append(len(tokens))
            tokens += words(text.as_py())
            tokens.append(None)
            if len(tokens) >= most:
                yield keys, tokens, np.array(starts)
                keys, tokens, starts = [], [], []
    if keys:
        yield keys, tokens, np.array(starts)


def train_round(train: DataFrame, names: list[bytes], weights: np.ndarray, turn: int, model: Size, odds: list[np.ndarray]) -> np.ndarray:
    """The weights after a round over the documents whose turn it is."""
    size = -(-model.total // BLOCKS)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, own = Codes(names), weights.copy()
        w, past = views(own, model), views(np.zeros(model.total, dtype=np.float32), model)
        seen = 0
        for _, tokens, starts in gathered(batches, 0, 8 * STEP):
            code = codes.of(tokens)
            before, skip = context(code, starts)
            for at in range(0, len(code), STEP):
                descend(model, w, past, odds, *(x[at : at + STEP] for x in (before, skip, code)))
            seen += len(code)
        if seen:
            change, team = (own - weights).astype(np.float16), TaskContext.get().partitionId() // TEAM
            for i in range(BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([team], pa.int32()), pa.array([seen], pa.int64()), pa.array([change[i * size : (i + 1) * size].tobytes()], pa.binary())], ["block", "team", "n", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The mean change of each block and team, adding them up as they arrive."""
        sums: dict[tuple, list] = {}
        for batch in batches:
            for block, team, n, change in zip(*batch.to_pydict().values(), strict=True):
                at = sums.setdefault((block, team), [0, 0.0])
                at[0], at[1] = at[0] + n, at[1] + n * np.frombuffer(change, dtype=np.float16).astype(np.float64)
        for (block, team), (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([team // TEAM], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())], ["block", "team", "n", "change"])

    schema = "block int, team int, n long, change binary"
    mine = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(ROUNDS)) == turn).select("text")
    # A round has a part of the documents, so its tasks take several partitions each and send fewer changes.
    parts, cores = mine.rdd.getNumPartitions(), train.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-parts // ROUNDS), min(parts, cores))
    summed, teams = mine.coalesce(tasks).mapInArrow(steps, schema), -(-tasks // TEAM)
    # A task adds up the blocks of a team of tasks, then of a team of teams, until there is one.
    while True:
        summed = summed.repartition(BLOCKS * teams, "block", "team").mapInArrow(add, schema)
        if teams == 1:
            break
        teams = -(-teams // TEAM)
    out = weights.copy()
    for r in summed.collect():  # the model's BLOCKS blocks
        out[r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["change"], dtype=np.float16)
    return out


def common_tokens(counts: DataFrame) -> tuple[int, list[bytes], np.ndarray]:
    """The least count of the tokens sent to all tasks (at most ``FREQUENT``), and those tokens with their counts, commonest first."""
    bins = counts.groupBy(F.floor(F.log2("c") * 256).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    least, left = 1 << 62, FREQUENT
    for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # a row for each 256th of a power of 2
        left -= r["n"]
        if left < 0:
            break
        least = r["least"]
    top = counts.filter(F.col("c") >= least).toArrow()
    tokens, found = top.column("token").to_pylist(), top.column("c").to_pylist()
    order = sorted(range(len(tokens)), key=lambda i: (-found[i], tokens[i]))
    return least, [tokens[i] for i in order], np.array([found[i] for i in order], dtype=np.int64)


def leaf_masses(counts: DataFrame, size: Size, names: list[bytes], found: np.ndarray) -> np.ndarray:
    """n + 0.5 v + 0.5 of each leaf, for its n tokens of v kinds that have no digits of their own."""
    leaf = F.shiftrightunsigned(F.crc32("token"), HASH - size.bits).cast("int")
    by_leaf = counts.groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # 128 times the vocabulary's square root, twice that at most
    mass = np.full(1 << size.bits, 0.5)
    mass[by_leaf.column("leaf").to_numpy()] += by_leaf.column("n").to_numpy() + 0.5 * by_leaf.column("v").to_numpy()
    own = np.array([crc32(w) >> (HASH - size.bits) for w in names[: HEAD - 1]], dtype=np.int64)
    np.subtract.at(mass, own, found[: HEAD - 1] + 0.5)
    return mass


def maxent_lm(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = rows.filter(~held_out(F.col("doc_id")))
    counts = materialize(count_tokens(train), "counts")
    ends = train.select("doc_id").count()
    least, names, found = common_tokens(counts)
    words_n, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = Size(vocabulary)
    mass = leaf_masses(counts, size, names, found)
    head = np.zeros(HEAD)
    head[: min(len(names), HEAD - 1) + 1] = np.concatenate([[ends], found[: HEAD - 1]]) + 0.5
    odds, log_mass = odds_of(size, head, mass), np.log10(mass).astype(np.float32)
    n_train, distinct = words_n + ends, vocabulary + (ends > 0)
    weights = np.zeros(size.total, dtype=np.float32)
    for turn in range(ROUNDS if ends else 0):
        weights = train_round(train, names, weights, turn, size, odds)
    whole, log_counts = float(np.log10(n_train + 0.5 * (distinct + 1))), np.log10(np.array([*found, ends]) + 0.5)
    nothing = float(np.log10(0.5))
    schema = "row long, token binary, times long, own struct<doc_id: long, n_tokens: long, n_known: long, base: double, score: double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, w = Codes(names), views(weights, size)
        row = TaskContext.get().partitionId() << 33
        get = codes.index.get
        for ids, tokens, starts in gathered(batches, 1, CHUNK):
            at = np.array([get(t, -1) for t in tokens], dtype=np.int64)
            rest = np.flatnonzero(at < 0)
            code, others = codes.code[at], [tokens[i] for i in rest.tolist()]
            code[rest] = [HEAD + 1 + crc32(t) for t in others]
            # Tokens of unknown count are taken as never seen here; the join puts that right.
            value = np.where(at < 0, nothing, log_counts[at])
            own = log_chances(size, w, odds, *context(code, starts), code) / np.log(10)
            hashed = np.flatnonzero(code > HEAD)
            own[hashed] += value[hashed] - log_mass[(code[hashed] - HEAD - 1) >> (HASH - size.bits)]
            lengths = np.diff([*starts, len(tokens)])
            known = np.add.reduceat((at >= 0).astype(np.int64), starts) - (not ends)
            base, lm = np.add.reduceat(value, starts) - lengths * whole, np.add.reduceat(own, starts)
            seen = Counter(zip(np.repeat(np.arange(row, row + len(ids)), lengths)[rest].tolist(), others, strict=True))
            none = [None] * len(seen)
            yield batch_of([[r for r, _ in seen], [t for _, t in seen], list(seen.values()), none, none, none, none, none])
            # A key of its own keeps the row from meeting a count, and spreads rows evenly.
            rows_here = range(row, row + len(ids))
            yield batch_of([list(rows_here), [b"\n%d" % r for r in rows_here], [0] * len(ids), ids, lengths, known, base, lm])
            row += len(ids)

    def batch_of(columns: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        own = pa.StructArray.from_arrays(arrays[3:], ["doc_id", "n_tokens", "n_known", "base", "score"], mask=pa.array(np.array(columns[2]) > 0))
        return pa.RecordBatch.from_arrays([*arrays[:3], own], ["row", "token", "times", "own"])

    met = rows.mapInArrow(score, schema).join(counts.filter(F.col("c") < least), "token", "left")
    more = F.when(F.col("c") > 0, F.col("times") * (F.log10(F.col("c") + 0.5) - nothing))
    total = met.groupBy("row").agg(F.max("own").alias("own"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0)).alias("known"), F.coalesce(F.sum(more), F.lit(0.0)).alias("more"))
    return total.select(
        F.col("own.doc_id").alias("doc_id"), held_out(F.col("own.doc_id")).alias("held_out"), F.col("own.n_tokens").alias("n_tokens"), (F.col("own.n_known") + F.col("known")).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"), (F.col("own.base") + F.col("more")).alias("base_score"), (F.col("own.score") + F.col("more")).alias("score"),
    )
