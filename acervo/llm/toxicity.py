"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words and word stems whose share of toxic documents
is far above their share of others, counted on the labelled sample.  Documents
then become a dozen numbers - lexicon densities, hits near a second-person word,
capitals, punctuation, obfuscated words - on which histogram-based boosted trees
are fitted; for the fitting, a document's lexicon is counted without its own part
of the sample, so no document speaks for itself.  One fold of the sample is kept
from the trees and maps their sum to a probability by isotonic regression.  Look-alike digits and
symbols inside a word are read as the letters they stand for.

Learning takes at most ``most`` labelled documents of each class; the lexicon
has at most ``LEXICON`` entries.  Every document is scored over its whole text.

Defined cases as for the quality classifier: null and empty texts are scored,
rows are scored by text alone, whole texts of any length, null labels are ignored,
and without labels of both classes the score is the smoothed share of toxic labels.
Equal texts have equal scores, and a score equal to the threshold is toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.bpe import batches_of
from acervo.llm.common import bounded_batches, cut, strongest
from acervo.llm.features import TOXICITY, Words, terms, toxicity_features
from acervo.llm.learn import cut_points, grow, held_out, isotonic, labelled_sample, labelled_texts, sigmoid

SAMPLE = 8_000  # labelled documents of each class that a model may learn from
LEXICON = 4_000
PARTS, FOLDS = 3, 6  # of the sample, for out-of-part lexicons and for the calibration fold
NUMBERS = [f"p{k}_{y}" for k in range(PARTS) for y in (0, 1)]
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS = 3, 0.002, 3.0
THRESHOLD = 0.5


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], edges: list[np.ndarray], base: float, trees: list, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.edges, self.base, self.trees, self.knots = lexicon, edges, base, trees, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += tree.score(binned)
        return z

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.raw(toxicity_features(texts, self.lexicon))
        return np.interp(z, *self.knots) if len(self.knots[0]) else sigmoid(z)


def count_terms(known: DataFrame, most: int) -> list[tuple[str, list[int], list[int]]]:
    """Terms of documents ``(text, y, fold)`` with their documents by part and class; the strongest ``most`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                seen = [(Counter(), Counter()) for _ in range(PARTS)]
                w = Words(batch.column("text"))
                own = [terms(x) for x in w.distinct.to_pylist()]
                for i, (y, fold) in enumerate(zip(batch.column("y").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
                    seen[fold % PARTS][y].update({t for k in np.unique(w.index[w.bounds[i] : w.bounds[i + 1]]).tolist() for t in own[k]})
                every = sorted({t for pair in seen for c in pair for t in c})
                columns = [pa.array([c[t] for t in every], pa.int64()) for pair in seen for c in pair]
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *columns], ["term", *NUMBERS])

    counted = known.select("text", "y", "fold").mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in NUMBERS))
    totals = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in NUMBERS])
    n0, n1 = (sum((F.col(c) for c in NUMBERS[y::2]), F.lit(0)) for y in (0, 1))
    often = cut(totals.where(n1 >= LEAST_DOCS).where(n1 > 2 * n0).withColumn("gap", n1 - 2 * n0), "terms")
    top = sorted(strongest(often, "gap", "term", most).collect(), key=lambda r: (-r.gap, r.term))
    return [(r.term, [r[c] for c in NUMBERS[0::2]], [r[c] for c in NUMBERS[1::2]]) for r in top]


def lexicon_of(found: list[tuple[str, list[int], list[int]]], size: tuple[list[int], list[int]], without: int | None = None) -> dict[str, float]:
    """Terms with smoothed log-odds of at least ``LEAST_LOG_ODDS``, counted on all parts but one."""
    parts = [k for k in range(PARTS) if k != without]
    total = [sum(size[y][k] for k in parts) for y in (0, 1)]
    out = {}
    for term, by0, by1 in found:
        c0, c1 = sum(by0[k] for k in parts), sum(by1[k] for k in parts)
        odds = float(np.log((c1 + 0.5) / (total[1] + 1)) - np.log((c0 + 0.5) / (total[0] + 1)))
        if c1 >= max(LEAST_DOCS, int(LEAST_SHARE * total[1])) and odds >= LEAST_LOG_ODDS:
            out[term] = odds
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32) -> tuple[list[np.ndarray], float, list]:
    positive = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
    base = float(np.log(positive / (1 - positive)))
    edges = [cut_points(x[:, f], bins) if len(x) else np.zeros(0) for f in range(len(TOXICITY))]
    grown: list = []
    if len(x) and y.min() < y.max():
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        z = np.full(len(x), base)
        for _ in range(trees):
            p = sigmoid(z)
            grown.append(grow(binned, [len(e) + 1 for e in edges], weight * (p - y), weight * p * (1 - p), depth, rate))
            z += grown[-1].score(binned)
    return edges, base, grown


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    bounded_batches(docs.sparkSession)
    sample, weight = labelled_sample(labels, target, most, "doc_id")
    known = cut(labelled_texts(docs, sample, doc_id, text), "labelled")
    size = ([0] * PARTS, [0] * PARTS)
    for r in known.groupBy("y", (F.col("fold") % PARTS).alias("part")).agg(F.count("*").alias("n")).collect():
        size[r.y][r.part] = r.n
    counted = count_terms(known, LEXICON)
    others = [lexicon_of(counted, size, k) for k in range(PARTS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                part = np.array(batch.column("fold").to_pylist(), np.int64) % PARTS
                x = np.zeros((batch.num_rows, len(TOXICITY)))
                for k in np.unique(part).tolist():
                    own = np.flatnonzero(part == k)
                    x[own] = toxicity_features(batch.column("text").take(pa.array(own)), others[k])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), flat], ["doc_id", "y", "fold", "features"])

    kind = known.schema["doc_id"].dataType.simpleString()
    found = known.mapInArrow(rows, f"doc_id {kind}, y int, fold int, features array<double>").orderBy("doc_id", "y").collect()
    y = np.array([r.y for r in found], np.float64)
    x = np.array([r.features for r in found], np.float64).reshape(len(found), len(TOXICITY))
    w = np.array([weight[int(v)] for v in y], np.float64)
    last = np.array([r.fold == FOLDS - 1 for r in found], bool)
    edges, base, trees = fit_trees(x[~last], y[~last], w[~last])
    model = ToxicityModel(lexicon_of(counted, size), edges, base, trees, (np.zeros(0), np.zeros(0)))
    if trees and last.any() and y[last].min() < y[last].max():
        model.knots = isotonic(model.raw(x[last]), y[last], w[last])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                score = model.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double, predicted int")
