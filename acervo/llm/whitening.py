"""Embedding whitening by a tall-skinny QR, without a covariance of the vectors.

1. Entries become integers ``floor(64 * c) + 1000000``.  Tasks add them up as
   integers; the partial sums of all tasks are added as decimals, so count and
   sums ``S`` are exact at any number of rows.
2. Rows are centred, ``x - S/n`` (``x - floor(S/n)`` is exact), and each partition
   reduces its rows to one triangular factor: block after block is stacked below
   the factor so far and factorised again.
3. Factors are merged in a tree, ``FAN`` to a task, until one is left.
4. Its singular value decomposition (one matrix as wide as a vector is long, on the
   driver) gives the components, its right vectors, and the eigenvalues ``s * s / n``.
5. Tasks project centred rows on the components; a second pass measures the
   covariance of the whitened rows, from each partition's centred products.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
entry are left out; vectors of each length are whitened among themselves (one model
for each length); entries beyond 2**50 count as 2**50, so that ``x`` fits a long; a
direction without variance has explained 0 and a null ``whitened``, and
``identity_error`` (null if there is none) leaves it out; vectors shorter than
``COMPONENTS`` have as many components as entries; null and repeated ids are rows
like others; an empty table gives an empty result.  Signs are set so that a
component's largest entry is positive.  Only id and vector are read, so other
columns cannot clash.  A task holds a block of vectors and two factors; a factor has
the square of a vector's length in entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import bounded_batches, cut, finite_vectors

SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**50
COMPONENTS = 32
FAN = 8
BLOCK = 4096
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitener:
    """What was fitted to the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues, falling
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > top * (8 * len(self.sums) * EPS) ** 2

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """``S = n * whole + rest``, by dimension."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(vectors, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def blocks(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, vectors)`` of a batch, in blocks of equally long vectors."""
    vec = batch.column(column)
    flat, sizes = vec.flatten().to_numpy(zero_copy_only=False), vec.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        for lo in range(0, len(own), BLOCK):
            part = own[lo : lo + BLOCK]
            yield dim, part, flat[starts[part][:, None] + np.arange(dim)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(dim, n, sums)`` of a task for each length; blocks are added before they could overflow."""
    total: dict[int, list] = {}
    for batch in batches:
        for dim, part, vectors in blocks(batch):
            x = integers(vectors)
            low = (x & 0xFFFFFFFF).sum(0).astype(object) + ((x >> 32).sum(0).astype(object) << 32)
            at = total.setdefault(dim, [0, np.zeros(dim, object)])
            at[0] += len(part)
            at[1] = at[1] + low
    rows = [(dim, n, [int(v) for v in sums]) for dim, (n, sums) in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.decimal128(38, 0)))], ["dim", "n", "sums"])


def exact_sums(vectors: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """For each length of vectors their number and the sums by dimension."""
    parts = cut(vectors.select("vec").mapInArrow(_sums, "dim int, n long, sums array<decimal(38,0)>"), "sums")
    counts = {r.dim: r.n for r in parts.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    long = parts.select("dim", F.posexplode("sums").alias("pos", "s")).groupBy("dim", "pos").agg(F.sum("s").alias("s"))
    sums = {dim: [0] * dim for dim in counts}
    for r in long.collect():  # a number for each dimension
        sums[r.dim][r.pos] = int(r.s)
    return {dim: (n, tuple(sums[dim])) for dim, n in counts.items()}


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest / n


def reduced(stack: np.ndarray) -> np.ndarray:
    """The triangular factor of a matrix, never with more rows than columns."""
    return np.linalg.qr(stack, mode="r")


def _batch(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    flat = [f.ravel() for _, _, f in parts]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int64()), pa.array(flat, pa.list_(pa.float64()))], ["dim", "part", "r"])


def _factors(fits: dict[int, Whitener]):
    """``(dim, part, r)``: a partition's factor for each length, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            for dim, _, vectors in blocks(batch):
                fit = fits[dim]
                y = centred(integers(vectors), *fit.split(), fit.n)
                found[dim] = reduced(np.vstack([found[dim], y]) if dim in found else y)
        yield _batch([(dim, part, r) for dim, r in found.items()])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One factor of the ``FAN`` factors of a group, in order of their parts."""
    dim, parts = table.column("dim")[0].as_py(), table.column("part").to_numpy()
    order = np.argsort(parts, kind="stable")
    factors = [np.asarray(table.column("r")[int(i)].values).reshape(-1, dim) for i in order]
    return pa.Table.from_batches([_batch([(dim, int(parts[order[0]]) // FAN, reduced(np.vstack(factors)))])])


def final_factors(vectors: DataFrame, fits: dict[int, Whitener]) -> dict[int, np.ndarray]:
    """The factor of all centred rows of each length."""
    schema = "dim int, part long, r array<double>"
    factors = cut(vectors.select("vec").mapInArrow(_factors(fits), schema), "factors")
    last = factors.agg(F.max("part")).first()[0] or 0
    while last > 0:
        factors = cut(factors.groupBy("dim", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_merged, schema), "factors")
        last //= FAN
    return {r.dim: np.array(r.r).reshape(-1, r.dim) for r in factors.collect()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """Models by length of the vectors; ``vectors`` has ``vec`` alone or beside other columns."""
    empty = {dim: Whitener(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0) for dim, (n, sums) in exact_sums(vectors).items()}
    out = {}
    for dim, r in final_factors(vectors, empty).items():
        _, s, right = np.linalg.svd(r, full_matrices=True)
        k = min(components, dim)
        values = np.zeros(dim)
        values[: len(s)] = s * s / empty[dim].n
        v = right[:k].T
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        out[dim] = Whitener(empty[dim].n, empty[dim].sums, v, values[:k], float((r * r).sum() / empty[dim].n))
    return out


def project(x: np.ndarray, model: Whitener) -> np.ndarray:
    """Whitened rows of integer vectors: NaN in directions without variance."""
    scale = np.full(len(model.values), np.nan)
    scale[model.usable] = 1 / np.sqrt(model.values[model.usable])
    return centred(x, *model.split(), model.n) @ model.vectors * scale


def deviations(x: np.ndarray, model: Whitener) -> list[int]:
    """Exact sums over dimensions of ``(n * x - S) ** 2``."""
    whole, rest = model.split()
    u, n = x - whole, model.n
    most = int(np.abs(u).max(initial=0))
    if most * most * u.shape[1] < 2**62 and most * n * u.shape[1] < 2**62:
        squares, cross = (u * u).sum(1), u @ rest
    else:
        u = u.astype(object)
        squares, cross = (u * u).sum(1), u @ rest.astype(object)
    constant = sum(int(r) * int(r) for r in rest)
    return [n * n * a - 2 * n * b + constant for a, b in zip(squares.tolist(), cross.tolist(), strict=True)]


def _products(models: dict[int, Whitener]):
    """``(dim, n, i, j, mi, mj, m)``: by pair of components a partition's count, means and centred products of whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for dim, _, vectors in blocks(batch):
                w = project(integers(vectors), models[dim])[:, models[dim].usable]
                n, mean = len(w), w.mean(0)
                m = (w - mean).T @ (w - mean)
                if dim in found:
                    n0, mean0, m0 = found[dim]
                    gap, n1 = mean - mean0, n0 + n
                    m, mean, n = m0 + m + np.outer(gap, gap) * (n0 * n / n1), mean0 + gap * (n / n1), n1
                found[dim] = n, mean, m
        for dim, (n, mean, m) in found.items():
            i, j = np.triu_indices(len(mean))
            columns = [np.full(len(i), dim, np.int32), np.full(len(i), n, np.int64), i.astype(np.int32), j.astype(np.int32), mean[i], mean[j], m[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "n", "i", "j", "mi", "mj", "m"])

    return run


def identity_errors(vectors: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """By length the largest absolute entry of the whitened rows' covariance minus the identity."""
    parts = vectors.select("vec").mapInArrow(_products(models), "dim int, n long, i int, j int, mi double, mj double, m double")
    n, each = F.sum("n"), F.col("n")
    covariance = (F.sum("m") + F.sum(each * F.col("mi") * F.col("mj"))) / n - F.sum(each * F.col("mi")) / n * (F.sum(each * F.col("mj")) / n)
    entry = parts.groupBy("dim", "i", "j").agg(covariance.alias("c"))
    error = F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return {r.dim: r.error for r in entry.groupBy("dim").agg(F.max(error).alias("error")).collect()}


def _rows(models: dict[int, Whitener], errors: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, vectors in blocks(batch):
                model, n = models[dim], len(part)
                x = integers(vectors)
                explained = model.values / model.trace if model.trace else np.zeros(len(model.values))
                white = pa.array(project(x, model).ravel(), from_pandas=True)  # NaN becomes null
                edges = pa.array(np.arange(n + 1, dtype=np.int32) * len(model.values))
                columns = [batch.column("vec_id").take(pa.array(part)), pa.array(np.full(n, model.n)), pa.array(deviations(x, model), pa.decimal128(38, 0)), pa.ListArray.from_arrays(edges, white), pa.ListArray.from_arrays(edges, pa.array(np.tile(explained, n))), pa.array([errors.get(dim)] * n, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error`` for every row with a finite vector.

    ``whitened`` and ``explained`` hold a number for each component, ``deviation`` is
    an exact whole number (``decimal(38,0)``).
    """
    bounded_batches(table.sparkSession)
    rows = finite_vectors(table, embedding, F.col(vec_id).alias("vec_id"))
    models = fit(rows.select("vec"), components)
    errors = identity_errors(rows.select("vec"), models)
    kind = table.schema[vec_id].dataType.simpleString()
    return rows.mapInArrow(_rows(models, errors), f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
