"""Learning helpers shared by the classifiers: labelled samples, folds, histogram trees, isotonic maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(labels: DataFrame, target: str, most: int, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """At most ``most`` labelled training rows of each class, and the weight that restores the classes' shares.

    Rows are taken in order of a hash of their id, the same at any partitioning;
    only those below a cut of the hash that leaves a little more than ``most`` are
    sorted.  Held-out rows, null ids and null labels are never taken.  The sample's
    size is bounded by ``2 * most`` ids, so it may be broadcast.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    mixed = F.xxhash64(F.lit(target), "doc_id")
    parts = []
    for y in (0, 1):
        share = min(1.0, (most + 10 * most**0.5) / max(1, counts.get(y, 0)))
        below = F.lit(True) if share == 1.0 else mixed < int((share - 0.5) * 2**64)
        parts.append(rows.where((F.col("y") == y) & below).orderBy(mixed, "doc_id").limit(most))
    sample = parts[0].union(parts[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(6)).cast("int"))
    return sample, {y: max(1.0, n / most) for y, n in counts.items()}


def labelled_texts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, y, fold, text`` of the sample, one row for each of its rows: of texts under one id the least (null last)."""
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    return met.groupBy("doc_id", "y", "fold").agg(F.min("text").alias("text"))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of about equally filled bins of a feature (at most ``bins`` bins)."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Tree:
    """A regression tree over binned features, kept as arrays: feature, bin, children, value."""

    def __init__(self, feature, cut, left, right, value):
        self.feature, self.cut, self.left, self.right, self.value = feature, cut, left, right, value

    def score(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(len(self.feature)):
            inner = self.feature[node] >= 0
            if not inner.any():
                break
            go = binned[rows, np.maximum(self.feature[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
        return self.value[node]


def grow(binned: np.ndarray, n_bins: list[int], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0, least: float = 5.0) -> Tree:
    """One depth-limited tree on gradients and hessians by best gain over bin histograms."""
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, down: int) -> int:
        me = len(feature)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for column, start in ((feature, -1), (cut, 0), (left, 0), (right, 0), (value, float(-rate * total_g / (total_h + ridge)))):
            column.append(start)
        best = (1e-9, -1, 0)
        if down:
            for f, n in enumerate(n_bins):
                cg = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
                ch = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
                gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                gain[(ch < least * 0.01) | (total_h - ch < least * 0.01)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] >= 0:
            low = binned[rows, best[1]] <= best[2]
            feature[me], cut[me] = best[1], best[2]
            left[me] = node(rows[low], down - 1)
            right[me] = node(rows[~low], down - 1)
        return me

    node(np.arange(len(g)), depth)
    return Tree(*(np.array(c) for c in (feature, cut, left, right, value)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots ``(score, probability)`` of the best rising map, shrunk off 0 and 1."""
    order = np.argsort(score, kind="stable")
    stack: list[list[float]] = []  # mean, weight, lowest and highest score of a pool
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        stack.append([t, w, s, s])
        while len(stack) > 1 and (stack[-2][0] >= stack[-1][0] or stack[-2][3] == stack[-1][2]):
            m, n, _, top = stack.pop()
            last = stack[-1]
            last[0] = (last[0] * last[1] + m * n) / (last[1] + n)
            last[1] += n
            last[3] = top
    x, p = [], []
    for m, n, lo, hi in stack:
        m = (m * n + 0.5 * 0.1) / (n + 0.1)
        x += [lo, hi] if hi > lo else [lo]
        p += [m, m] if hi > lo else [m]
    return np.array(x), np.maximum.accumulate(np.array(p)) if p else np.array(p)
