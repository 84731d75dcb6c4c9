"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``MAX_TRAIN``, chosen by a hash of the
   id, equal texts once) is written to the shared folder.
2. Terms are mined from it: words and word stems (prefixes) whose document
   frequency among toxic rows is so high that chance can't explain it at any
   of the terms seen.  Each term, lexicons of the terms, a fixed seed lexicon
   and patterns over them are voters: toxic, clean or no vote.
3. A generative label model, fitted by expectation maximisation, estimates the
   voters' accuracies and their correlations given the class; voters that
   repeat one another share their weight.
4. A linear (logistic) classifier over the terms' presence and the hits'
   number is trained on the model's posterior labels and scores every whole
   text.

Only steps 2 to 4's small tables come to the driver: ``MAX_TERMS`` terms, and
the indices of the terms in each of at most about ``MAX_TRAIN`` rows.

Defined results: a null or empty text has no terms and gets the classifier's
base score; labels that are null, held out, or of ids without a document teach
nothing; an id labelled twice is toxic if any label says so; without toxic
labels only the seed lexicon votes, and without labels every score is 0;
repeated rows score alike; a null id is held out; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspan.shared import materialize

MAX_TRAIN, MAX_TERMS = 20_000, 400
FOLDS = 5
STEMS = (4, 5, 6)
#: Fixed value: a small general lexicon of insults, in lower case.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "dumb", "pathetic", "worthless", "disgusting", "imbecile", "filth")
SPACED = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> set[bytes]:
    """Distinct words of a text, and their stems marked by ``*``."""
    own = set((text or "").lower().encode("utf-8", "replace").translate(SPACED).split())
    for n in STEMS:
        own |= {w[:n] + b"*" for w in list(own) if len(w) > n and w[-1:] != b"*"}
    return own


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text``: at most about ``MAX_TRAIN`` labelled rows, equal texts once."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 11).cast("double") / F.lit(float(2**53))
    some = known.filter(share < min(1.0, MAX_TRAIN / max(1, n)))
    # The sample of labels has about MAX_TRAIN rows of 12 bytes, so it can be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("id", "toxic", "text")).alias("x"))
    return materialize(once.select("x.toxic", "x.text"), "labelled")


def mine(sample: DataFrame, n_toxic: int, n_all: int) -> list[bytes]:
    """Terms that mark toxic rows, those of most rows first."""
    base = n_toxic / max(1, n_all)
    if not 0 < base < 1:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                seen[toxic.as_py() > 0].update(terms(text.as_py()))
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *[pa.array([seen[k][w] for w in part], pa.int64()) for k in (1, 0)]], ["term", "toxic", "clean"])

    counts = sample.mapInArrow(count, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts.filter("toxic + clean >= 4"), "terms")
    rows = F.col("toxic") + F.col("clean")
    p = F.least(F.col("toxic") / rows, F.lit(1 - 1e-9))
    # Chernoff's bound on the chance that a term of so many rows is in so many toxic ones.
    odd = rows * (p * F.log(p / base) + (1 - p) * F.log((1 - p) / (1 - base)))
    marked = counts.filter((p > 0.9) & (odd > F.lit(float(np.log(max(1, counts.count()) / 0.01)))))
    return [bytes(r["term"]) for r in marked.orderBy(F.desc("toxic"), "term").limit(MAX_TERMS).collect()]


def found_terms(names: list[bytes]):
    """A function from a text to the indices of the terms in it."""
    place = {t: i for i, t in enumerate(names)}
    whole = {t for t in names if t[-1:] != b"*"}
    stems = {n: {t for t in names if t[-1:] == b"*" and len(t) == n + 1} for n in STEMS}

    def find(text: str | None) -> list[int]:
        own = set((text or "").lower().encode("utf-8", "replace").translate(SPACED).split())
        hits = own & whole
        for n, known in stems.items():
            if known:
                hits |= {w[:n] + b"*" for w in own if len(w) > n} & known
        return sorted(place[t] for t in hits)

    return find


def voters(rows: list[list[int]], names: list[bytes], mined: int) -> np.ndarray:
    """Votes by row and voter: 1 toxic, -1 clean, 0 none.

    ``names`` has the mined terms, then the seed lexicon's words.
    """
    x = np.zeros((len(rows), len(names)), dtype=bool)
    for i, hits in enumerate(rows):
        x[i, hits] = True
    stem = np.array([t[-1:] == b"*" for t in names])
    own, seed = x[:, :mined], x[:, mined:]
    single = [own[:, j] for j in range(min(48, mined))]
    lexicons = [own[:, k::8].any(axis=1) for k in range(8) if own[:, k::8].shape[1]]
    patterns = [own[:, stem[:mined]].any(axis=1), own[:, ~stem[:mined]].any(axis=1), own.sum(axis=1) >= 2, own.sum(axis=1) >= 4, seed.any(axis=1), seed.sum(axis=1) >= 2]
    toxic = np.array([*single, *lexicons, *patterns]).T.astype(np.int8)
    clean = -np.array([~x.any(axis=1), ~own[:, ~stem[:mined]].any(axis=1), ~own[:, stem[:mined]].any(axis=1)]).T.astype(np.int8)
    return np.hstack([toxic, clean])


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """The posterior chance that each row is toxic.

    For every voter and class, the chances of its votes are estimated; the
    voters' correlations given the class weaken the weight of those that say
    the same.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    n = len(votes)
    post = np.where((votes > 0).any(axis=1), 0.9, prior / 4)
    share = np.ones(votes.shape[1])
    says = [(votes == v).astype(np.float64) for v in (1, -1)]
    for _ in range(rounds):
        odds = np.full(n, np.log(prior / (1 - prior)))
        total = np.array([(1 - post).sum(), post.sum()])
        for said in says:
            chance = np.clip((np.array([(1 - post) @ said, post @ said]) + np.array([[0.1], [0.1]])) / (total[:, None] + 10), 1e-6, 1 - 1e-6)
            odds += said @ (share * np.log(chance[1] / chance[0]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        v = votes.astype(np.float64)
        mean = np.array([((1 - post) @ v) / max(total[0], 1e-9), (post @ v) / max(total[1], 1e-9)])
        rest = v - (np.outer(1 - post, mean[0]) + np.outer(post, mean[1]))
        spread = rest.std(axis=0)
        alike = np.abs(rest.T @ rest / max(n, 1)) / np.maximum(np.outer(spread, spread), 1e-9)
        alike[:, spread < 1e-9] = alike[spread < 1e-9] = 0
        np.fill_diagonal(alike, 0)
        share = 1 / np.sqrt(1 + np.where(alike > 0.3, alike, 0).sum(axis=0))
    return post


def features(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width + 1), dtype=np.float32)
    for i, hits in enumerate(rows):
        x[i, hits] = 1
        x[i, width] = np.log1p(len(hits))
    return x


def train_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    step = 4 / (1 + float((x * x).sum(axis=1).max()))
    w0, b0 = w, b
    for i in range(rounds):
        mw, mb = w + (i / (i + 3)) * (w - w0), b + (i / (i + 3)) * (b - b0)
        miss = 1 / (1 + np.exp(-np.clip(x @ mw + mb, -30, 30))) - y
        w0, b0 = w, b
        w, b = mw - step * (x.T @ miss / len(y) + ridge * mw) * 4, mb - step * miss.mean() * 4
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, float]:
    """The terms, their weights (one more for the hits' number) and the base."""
    sample = training_sample(docs, labels)
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_all:
        return [], np.zeros(1), -50.0
    mined = mine(sample, n_toxic, n_all)
    names = [*mined, *[w.encode() for w in SEED_LEXICON if w.encode() not in mined]]
    find = found_terms(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([find(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32()))], ["hits"])

    rows = [list(r["hits"]) for r in sample.select("text").mapInArrow(each, "hits array<int>").collect()]  # about MAX_TRAIN rows
    rows.sort()  # the order of rows must not matter
    post = label_model(voters(rows, names, len(mined)), n_toxic / n_all)
    weights, base = train_linear(features(rows, len(names)), post)
    return names, weights, base


def scorer(docs: DataFrame, labels: DataFrame):
    """A function from a column of texts to their scores, fitted on labelled rows of ``docs``."""
    names, weights, base = fit(docs, labels)
    find = found_terms(names)

    def score(texts: pa.Array) -> np.ndarray:
        odds = np.full(len(texts), base)
        for i, text in enumerate(texts):
            if hits := find(text.as_py()):
                odds[i] += weights[hits].sum() + weights[-1] * np.log1p(len(hits))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""
    score = scorer(docs, labels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic; only texts go to Python, and nothing is shuffled."""
    score = scorer(docs, labels)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts) < 0.5)

    return docs.filter(clean(F.col("text").cast("string")))
