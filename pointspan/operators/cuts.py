"""Cuts of space into blocks of about as many points each, and exact work within blocks.

A tree of cuts is fitted in the driver on a bounded sample of points (at most
about ``SAMPLE``; its rows are chosen by a hash of their id) and has at most
about ``BLOCKS`` leaves.  It parts all of space, so every point and every
query has one block, whether it was in the sample or not: the sample only says
how even blocks are, never what is found.  Workers get the tree with their
code.  All else here is NumPy on one block, or two, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES
from pointspan.sources.points import ID

SAMPLE, BLOCKS, BLOCK = 1 << 18, 4096, 16_384
#: Points of the small leaves within a block, and numbers in a table that is made at once.
SMALL, AT_ONCE = 256, 1 << 20


class Cuts:
    """A binary tree: at ``axis, value`` smaller coordinates go to ``low``, others to ``high``; negative children are leaves."""

    def __init__(self, points: np.ndarray, most: int, least: int = 1):
        """Cut ``points`` down to ``most`` in a leaf, with at least ``least`` on either side of a cut."""
        self.axis, self.value, self.children, self.leaves = [], [], [], 0
        #: Points of the fullest leaf that no cut could halve.
        self.crowded = 0
        self.root = self._cut(points, most, least)
        self.axes, self.values, self.next = np.array(self.axis, np.int64), np.array(self.value), np.array(self.children, np.int64).reshape(-1, 2)

    def _cut(self, points: np.ndarray, most: int, least: int) -> int:
        found = cut_of(points, least) if len(points) > most else None
        if found is None:
            if len(points) > most:
                self.crowded = max(self.crowded, len(points))
            self.leaves += 1
            return -self.leaves
        axis, value = found
        own = len(self.axis)
        self.axis.append(axis)
        self.value.append(value)
        self.children.append(None)
        low = points[:, axis] < value
        self.children[own] = (self._cut(points[low], most, least), self._cut(points[~low], most, least))
        return own

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, from 0."""
        node = np.full(len(points), self.root)
        at = np.flatnonzero(node >= 0)
        while len(at):
            own = node[at]
            node[at] = self.next[own, (points[at, self.axes[own]] >= self.values[own]).astype(np.int64)]
            at = at[node[at] >= 0]
        return -node - 1

    def reached(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of points and the leaves that may hold something within ``radius`` of them, sorted by both."""
        # A little wider, so rounding (also of squares of tiny numbers) loses nothing.
        far = radius * (1 + 1e-9) + 1e-150
        at, leaf = [], []
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, own = open_.pop()
            if not len(own):
                continue
            if node < 0:
                at.append(own)
                leaf.append(np.full(len(own), -node - 1))
                continue
            v, cut = points[own, self.axis[node]], self.value[node]
            open_ += [(self.children[node][0], own[v - far[own] < cut]), (self.children[node][1], own[v + far[own] >= cut])]
        at, leaf = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, leaf))
        order = np.lexsort((leaf, at))
        return at[order], leaf[order]


def cut_of(points: np.ndarray, least: int) -> tuple[int, float] | None:
    """The axis and value that cut points best: near the middle of the widest axis where equal values allow it."""
    spread = points.max(axis=0) - points.min(axis=0)
    best, found = 0, None
    for axis in np.argsort(-spread, kind="stable"):
        if spread[axis] <= 0:
            continue
        v = np.sort(points[:, axis])
        middle = v[len(v) // 2]
        for value in (middle, v[min(np.searchsorted(v, middle, "right"), len(v) - 1)]):
            n = np.searchsorted(v, value, "left")
            side = min(n, len(v) - n)
            if side >= least and side > best:
                best, found = side, (int(axis), float(value))
        if best * 4 >= len(v):
            break
    return found


def sampled(df: DataFrame, n: int) -> DataFrame:
    """About ``SAMPLE`` of n rows (all, if there are fewer), the same ones on every run."""
    if n <= SAMPLE:
        return df
    return df.filter(F.pmod(F.xxhash64(ID, *AXES), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))


def columns(batch) -> np.ndarray:
    """x, y, z of an Arrow table as rows."""
    return np.stack([np.asarray(batch[a], np.float64) for a in AXES], axis=1)


def distances(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray, p: float) -> np.ndarray:
    """As ``knn.metric``, in the same order of operations."""
    if p == 1:
        return np.abs(dx) + np.abs(dy) + np.abs(dz)
    if p == 2:
        return np.sqrt(dx * dx + dy * dy + dz * dz)
    return np.maximum(np.maximum(np.abs(dx), np.abs(dy)), np.abs(dz))


class Block:
    """The points of one block, in small leaves of their own."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, p: float):
        self.k, self.p = k, p
        most = max(SMALL, 4 * k)
        self.cuts = Cuts(points, most, k)
        leaf = self.cuts.place(points)
        order = np.lexsort((ids, leaf))
        self.points, self.ids = points[order], ids[order]
        self.start = np.searchsorted(leaf[order], np.arange(self.cuts.leaves + 1))

    def nearest(self, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``asked``, ids and distances of the k nearest no farther than ``bound``, sorted by place, distance and id."""
        home = self.cuts.place(asked)
        first = self._looked(asked, np.arange(len(asked)), home, bound)
        reach = np.minimum(bound, kth(first, len(asked), self.k))
        at, leaf = self.cuts.reached(asked, reach)
        other = leaf != home[at]
        more = self._looked(asked, at[other], leaf[other], reach)
        return top(*(np.concatenate(v) for v in zip(first, more, strict=True)), self.k)

    def _looked(self, asked: np.ndarray, at: np.ndarray, leaf: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        order = np.argsort(leaf, kind="stable")
        at, leaf = at[order], leaf[order]
        ends = np.flatnonzero(np.diff(leaf)) + 1
        for own in np.split(np.arange(len(leaf)), ends) if len(leaf) else []:
            points, ids = (v[self.start[leaf[own[0]]] : self.start[leaf[own[0]] + 1]] for v in (self.points, self.ids))
            if not len(points):
                continue
            # A leaf is longer than AT_ONCE only if no cut parts it; then it is looked at piece by piece.
            for piece in range(0, len(points), AT_ONCE):
                near, named = points[piece : piece + AT_ONCE], ids[piece : piece + AT_ONCE]
                step = max(1, AT_ONCE // len(near))
                for i in range(0, len(own), step):
                    q = at[own[i : i + step]]
                    dist = distances(*[asked[q, a][:, None] - near[None, :, a] for a in range(3)], self.p)
                    limit = bound[q]
                    if len(near) > self.k:
                        limit = np.minimum(limit, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
                    row, col = np.nonzero(dist <= limit[:, None])
                    out.append(top(q[row], named[col], dist[row, col], self.k))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def top(at: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each place; ties go to the smaller id."""
    order = np.lexsort((ids, dist, at))
    at, ids, dist = at[order], ids[order], dist[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
    return at[keep], ids[keep], dist[keep]


def kth(found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    """The k-th distance of each of n places, infinite where fewer are found."""
    at, ids, dist = top(*found, k)
    out = np.full(n, np.inf)
    last = np.arange(len(at)) - np.searchsorted(at, at, "left") == k - 1
    out[at[last]] = dist[last]
    return out


def placed(cuts: dict[int, tuple[Cuts, int]], batches: Iterator, keep: tuple[str, ...]) -> Iterator:
    """Arrow batches with ``_g`` and ``x, y, z``, with the block of each row: its leaf in the tree of its group ``_g``."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        g, points = np.asarray(batch["_g"]), columns(batch)
        block = np.zeros(len(g), np.int32)
        for own in np.unique(g):
            tree, first = cuts[int(own)]
            block[g == own] = first + tree.place(points[g == own])
        yield pa.RecordBatch.from_arrays([pa.array(block), *[batch[c] for c in keep]], names=["_block", *keep])


# Counting pairs

#: Points of the small leaves of counted blocks.
COUNTED = 16


def settled(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each two boxes the bins of the nearest and the farthest two points that they can hold.

    Bin i holds squared distances up to ``squares[i]``, the last one all beyond.  Differences, squares and sums
    are rounded as those of points are, and rounding keeps order, so no point's bin lies outside of these two.
    """
    least, most = 0.0, 0.0
    for a in range(3):
        ahead, behind = low_a[:, None, a] - high_b[None, :, a], low_b[None, :, a] - high_a[:, None, a]
        near, far = np.maximum(np.maximum(ahead, behind), 0.0), np.maximum(-ahead, -behind)
        least, most = least + near * near, most + far * far
    return np.searchsorted(squares, least), np.searchsorted(squares, most)


def halved(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights in leaves of at most ``COUNTED``, halved along the widest axis of each level; gaps are NaN with weight 0."""
    depth = max(0, int(np.ceil(np.log2(max(len(points), 1) / COUNTED))))
    gaps = -len(points) % (1 << depth)
    points, weights = np.vstack([points, np.full((gaps, 3), np.nan)]), np.concatenate([weights, np.zeros(gaps)])
    order = np.arange(len(points))
    for level in range(depth):
        parts = order.reshape(1 << level, -1)
        own = points[parts]
        axis = int(np.argmax(np.nanmean(np.fmax.reduce(own, axis=1) - np.fmin.reduce(own, axis=1), axis=0)))
        order = np.take_along_axis(parts, np.argsort(own[:, :, axis], axis=1), axis=1).ravel()
    return points[order].reshape(1 << depth, -1, 3), weights[order].reshape(1 << depth, -1)


def pair_sums(a: np.ndarray, weight_a: np.ndarray, b: np.ndarray, weight_b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Sums of weights' products by bin, over all pairs of points of two blocks; only leaves that a bin's border parts are opened."""
    (a, wa), (b, wb) = halved(a, weight_a), halved(b, weight_b)
    low_a, high_a, low_b, high_b = (f.reduce(v, axis=1) for v in (a, b) for f in (np.fmin, np.fmax))
    sum_a, sum_b = wa.sum(axis=1), wb.sum(axis=1)
    out = np.zeros(len(squares))
    step, room = max(1, AT_ONCE // len(b)), max(1, AT_ONCE // 4 // (a.shape[1] * b.shape[1]))
    for i in range(0, len(a), step):
        first, last = settled(low_a[i : i + step], high_a[i : i + step], low_b, high_b, squares)
        product = sum_a[i : i + step, None] * sum_b[None, :]
        plain = (first == last) & np.isfinite(product)
        for bin_ in range(len(squares)):
            out[bin_] += product[plain & (first == bin_)].sum()
        row, col = np.nonzero(~plain & (first < len(squares)))
        for j in range(0, len(row), room):
            p, q = row[j : j + room] + i, col[j : j + room]
            dx, dy, dz = (a[p, :, None, c] - b[q, None, :, c] for c in range(3))
            d2 = dx * dx + dy * dy + dz * dz
            near = d2 <= squares[-1]
            bins, own = np.searchsorted(squares, d2[near]), (wa[p][:, :, None] * wb[q][:, None, :])[near]
            out += np.bincount(bins, own, len(squares))
    return out
