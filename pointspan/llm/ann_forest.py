"""Approximate nearest neighbours by a hash-prefix (LSH) forest.

Rows are dealt into blocks of about ``BLOCK`` vectors.  A block holds ``TREES``
trees; a tree is the sorted array of its vectors' hash strings (``BITS`` bits,
the signs of products with random directions, which are orthogonal in groups).
A query goes down every tree to its longest prefix by binary search.  Then all
trees go up together, a bit at a time (in the last step only as many trees as
needed), until the ranges under their prefixes hold ``LEAST`` candidates and
``SPREAD`` times the block's size, repeats between trees included.  Only these
candidates' vectors are looked at: their inner products are computed in double
precision, and the best ``k`` of each block are merged.

Vectors that are as good as independent, as in the given tables (64 dimensions,
cosines of 0.4 to the 20 nearest), need about 0.3 of a block for a recall of
0.9; nearer neighbours are found among the first candidates, whatever the
number of rows.

Inner products are reduced to angles by one more coordinate,
``sqrt(M**2 - |x|**2)`` with M the block's largest norm.  Equal vectors of a
block are one entry with its smallest ids, so many copies of a vector cost and
lose nothing.  Queries are a stated part of the rows and are cut into parts of
``QUERIES``; each part meets each block once, as one unit of bounded size, so
only vectors are shuffled and never pairs.

Defined results: vectors that are null, empty, zero, or hold null, NaN or
infinite components take no part; vectors are compared with those of their
own length only; equal scores go to the smaller id; a query has fewer than k
rows if there are fewer candidates; repeated ids are one candidate each, told
apart by their vectors; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.shared import materialize

K, EVERY = 20, 20
BLOCK, QUERIES = 16_384, 16_384
TREES, BITS = 192, 32
SPREAD, LEAST = 0.3, 1000
AT_ONCE = 512
SEED = 3


def usable(column: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(~odd, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """The trees over the distinct vectors of a block."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED):
        self.vectors = vectors
        n, dim = vectors.shape
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(norms.max() - norms, 0))
        rng, wide = np.random.default_rng(seed), dim + 1
        groups = [np.linalg.qr(rng.standard_normal((wide, wide)))[0] for _ in range(-(-TREES * BITS // wide))]
        self.planes = np.hstack(groups)[:, : TREES * BITS]
        hashes = self.hash(np.hstack([vectors, extra[:, None]]))
        self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def hash(self, points: np.ndarray) -> np.ndarray:
        """The hash strings of points, by tree, as unsigned integers."""
        out = np.empty((TREES, len(points)), dtype=np.uint32)
        for at in range(0, len(points), 1024):
            bits = np.packbits(points[at : at + 1024] @ self.planes > 0, axis=1)
            out[:, at : at + 1024] = bits.reshape(len(bits), TREES, BITS // 8).view(">u4")[:, :, 0].T
        return out

    def longest(self, own: np.ndarray) -> np.ndarray:
        """For each query, the longest prefix that it shares with a vector in any tree."""
        best = np.zeros(own.shape[1], dtype=np.int64)
        for s, x in zip(self.sorted, own, strict=True):
            at = np.searchsorted(s, x)
            for near in (s[np.maximum(at - 1, 0)], s[np.minimum(at, len(s) - 1)]):
                best = np.maximum(best, BITS - np.frexp((near ^ x).astype(np.float64))[1])
        return best

    def candidates(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's number, in no order, and the entries that share a prefix with it."""
        n = len(self.vectors)
        own = self.hash(np.hstack([queries, np.zeros((len(queries), 1))]))
        want = min(LEAST + SPREAD * n, TREES * n)
        deepest, seen = self.longest(own), np.zeros(n, dtype=bool)
        start = end = np.zeros((TREES, len(queries)), dtype=np.int64)
        waiting = np.arange(len(queries))
        for depth in range(int(deepest.max()), -1, -1):
            # The range of every tree that shares the first depth bits; all trees go up together.
            mask = np.uint32((1 << BITS) - (1 << (BITS - depth)))
            low = own[:, waiting] & mask
            lower, upper = start, end
            start = np.array([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low, strict=True)])
            end = np.array([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, low | ~mask, strict=True)])
            ready = ((end - start).sum(axis=0) >= want) | (depth == 0)
            for i in np.flatnonzero(ready):
                # As many trees as are needed stay at this depth, the others at the one below.
                sizes, before = end[:, i] - start[:, i], upper[:, i] - lower[:, i]
                trees = np.searchsorted(before.sum() + np.cumsum(sizes - before), want) + 1
                first, last = np.where(np.arange(TREES) < trees, start[:, i], lower[:, i]).tolist(), np.where(np.arange(TREES) < trees, end[:, i], upper[:, i]).tolist()
                seen[np.concatenate([self.order[t, a:b] for t, (a, b) in enumerate(zip(first, last, strict=True))])] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                yield int(waiting[i]), found
            waiting, start, end = waiting[~ready], start[:, ~ready], end[:, ~ready]
            if not len(waiting):
                return


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of a block for each query, the query's own row left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
    entry = entry.reshape(-1)
    by_entry = np.argsort(entry, kind="stable")  # by entry, then by id
    first = np.searchsorted(entry[by_entry], np.arange(len(distinct) + 1))
    forest, out = Forest(distinct), []
    for at in range(0, len(queries), AT_ONCE):
        part, part_ids = queries[at : at + AT_ONCE], query_ids[at : at + AT_ONCE]
        for i, entries in forest.candidates(part):
            query, scores = int(part_ids[i]), distinct[entries] @ part[i]
            n = min(k + 1, len(entries))  # one more, as the query's own row may be among them
            if not n:
                continue
            least = np.partition(scores, len(entries) - n)[len(entries) - n]
            near = entries[scores >= least - 1e-9 * (1 + abs(least))]
            exact = [float(np.sum(part[i] * distinct[j])) for j in near]
            rows = [(-s, int(c), s) for s, j in zip(exact, near, strict=True) for c in ids[by_entry[first[j] : min(first[j] + k + 1, first[j + 1])]] if c != query]
            rows.sort()
            out += [(query, c, s) for _, c, s in rows[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def ann_forest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable("v")).filter("vec_id IS NOT NULL")
    own = materialize(own.withColumn("dim", F.size("v")), "vectors")
    asked = own.filter(F.col("vec_id") % every == 0)
    n, q = own.count(), asked.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-q // QUERIES))
    deal = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = own.withColumn("block", deal(1, blocks)).withColumn("part", all_of(parts))
    right = asked.withColumn("part", deal(2, parts)).withColumn("block", all_of(blocks))

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search_block(index["vec_id"].to_numpy(), np.stack(index["v"].to_numpy()), queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), k)

    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
