"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting: in
every round the features take turns, each fitting a shallow tree of its own bins
to the current gradient, added to its table with a small rate.  Then the pairs
of features whose coarse grid explains most of what is left are boosted in the
same way into two-dimensional tables.  A score is the logistic of a sum of table
entries, so scoring a batch is one bin search and one table gather for each term.

Learning takes at most ``most`` labelled documents of each class (a bound on the
driver's work, not on what is scored); only their feature rows reach the driver.

Defined cases: null and empty texts have all-zero features and get a score;
every row is scored by its text alone, so repeated ids keep their rows; null or
other labels than 0 and 1 are ignored; if no class or only one is labelled, the
score is that class's smoothed share.  Texts of any length are read whole; equal
texts have equal scores, and a score equal to the threshold is accepted.  An empty
table gives an empty result.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.bpe import batches_of
from acervo.llm.common import bounded_batches, numbered_columns
from acervo.llm.features import QUALITY, quality_features
from acervo.llm.learn import cut_points, grow, held_out, labelled_sample, labelled_texts, sigmoid

SAMPLE = 8_000  # labelled documents of each class that a model may learn from
THRESHOLD = 0.3
BLOCK_BYTES = 3 << 20  # of text whose features are computed at a time


class AdditiveModel:
    """Intercept, a table for each feature and a grid for each chosen pair."""

    def __init__(self, intercept: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.intercept, self.edges, self.tables, self.coarse, self.pairs = intercept, edges, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f])]
        for a, b, grid in self.pairs:
            z += grid[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, grid: int = 8, pairs: int = 6, pair_rounds: int = 60) -> AdditiveModel:
    """Learn from rows ``x`` with labels 0/1; empty or one-class input gives a constant."""
    n = x.shape[1]
    positive = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
    intercept = float(np.log(positive / (1 - positive)))
    edges = [cut_points(x[:, f], bins) if len(x) else np.zeros(0) for f in range(n)]
    coarse = [cut_points(x[:, f], grid) if len(x) else np.zeros(0) for f in range(n)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(intercept, edges, tables, coarse, [])
    if not len(x) or y.min() == y.max():
        return model
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(n)], axis=1)
    z = np.full(len(x), intercept)
    for _ in range(rounds):
        for f in range(n):
            if len(tables[f]) == 1:
                continue
            p = sigmoid(z)
            tree = grow(binned[:, f : f + 1], [len(tables[f])], weight * (p - y), weight * p * (1 - p), 2, rate)
            step = tree.score(np.arange(len(tables[f]))[:, None])
            tables[f] += step
            z += step[binned[:, f]]
    cells = np.stack([np.searchsorted(coarse[f], x[:, f]) for f in range(n)], axis=1)
    p = sigmoid(z)
    g, h = weight * (p - y), weight * p * (1 - p)
    gains = []
    for a in range(n):
        for b in range(a):
            size = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            at = cells[:, a] * size[1] + cells[:, b]
            cg, ch = np.bincount(at, g, size[0] * size[1]), np.bincount(at, h, size[0] * size[1])
            gains.append((float((cg**2 / (ch + 1)).sum()), a, b))
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            p = sigmoid(z)
            both = cells[:, [a, b]]
            tree = grow(both, list(table.shape), weight * (p - y), weight * p * (1 - p), 2, rate)
            every = np.stack(np.meshgrid(np.arange(table.shape[0]), np.arange(table.shape[1]), indexing="ij"), axis=-1).reshape(-1, 2)
            table += tree.score(every).reshape(table.shape)
            z += tree.score(both)
    model.pairs = chosen
    return model


def features_of(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and a ``features`` array for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                x = quality_features(batch.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], flat], [*keep, "features"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(rows, f"{fields}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality", most: int = SAMPLE) -> AdditiveModel:
    bounded_batches(docs.sparkSession)
    sample, weight = labelled_sample(labels, target, most, "doc_id")
    known = labelled_texts(docs, sample, doc_id, text)
    found = features_of(known, "text", ["doc_id", "y"]).orderBy("doc_id", "y").collect()
    y = np.array([r.y for r in found], np.float64)
    x = np.array([r.features for r in found], np.float64).reshape(len(found), len(QUALITY))
    return fit(x, y, np.array([weight[int(v)] for v in y], np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                score = model.score(quality_features(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that the model does not reject."""
    plain, column = numbered_columns(docs, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, column, BLOCK_BYTES):
                yield batch.filter(pa.array(model.score(quality_features(batch.column(column))) >= threshold))

    return plain.mapInArrow(rows, plain.schema).toDF(*docs.columns)
