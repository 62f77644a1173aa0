"""Vector code compression: a product quantiser fitted by weighted Lloyd rounds on distinct parts.

1. Components become integers ``floor(1024 * x)``; a vector is cut into ``PARTS``
   consecutive parts.  Equal parts of one position are counted into one weighted
   row (combined before the shuffle), so copies cost nothing further.
2. A position's codebook starts as that part of the ``ENTRIES`` smallest ids.  Each
   of ``ROUNDS`` rounds assigns the distinct parts to their nearest entry (exact
   integer distances, ties to the lower index) and replaces an entry by the floor of
   its parts' weighted mean; unused entries stay.  Tasks add up their parts by entry,
   the sums of all tasks are added as decimals, and only codebooks reach the driver.
3. The distinct parts are assigned once more; their codes and errors are joined back
   to the vectors.  Parts, and labels, that more than a ``HOT`` th of the rows share
   meet them by a broadcast (there are few of them), the others by a hash join.

Parts are told apart by 128 bits of hash and their position.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
component are left out; vectors of each length have codebooks of their own; of a
length that ``PARTS`` does not divide, the first parts are one component longer (a
vector with fewer components than ``PARTS`` has empty parts); components beyond 2**14
count as 2**14, so that squared distances are exact in a long; ids order with null
last and rows of equal id by their components; fewer than ``ENTRIES`` rows give as many
entries; rows that repeat an id are coded each on its own; labels may be of any type
that can be grouped, nulls are one label; an empty table gives an empty result.  Only
id, vector and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import bounded_batches, counted_join, cut, finite_vectors

SCALE, LARGEST = 1024.0, 2.0**14
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 4096

#: Codebooks by (length of vectors, position of the part): an entry to a row.
Codebooks = dict[tuple[int, int], np.ndarray]


def bounds(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where a vector of ``dim`` components is cut."""
    size, longer = divmod(dim, parts)
    starts = [p * size + min(p, longer) for p in range(parts + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def whole_numbers(vec: Column) -> Column:
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))
    return F.transform(vec, lambda c: F.floor(held(c) * F.lit(SCALE)).cast("long"))


def parts_of(vec: Column, parts: int = PARTS) -> Column:
    """Array of ``struct(position, value)``: the parts of an array column."""
    size, longer = F.floor(F.size(vec) / parts).cast("int"), F.size(vec) % parts
    return F.array(*[F.struct(F.lit(p).alias("position"), F.slice(vec, size * p + F.least(F.lit(p), longer) + 1, size + (longer > p).cast("int")).alias("value")) for p in range(parts)])


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lowest on ties) and its squared distance, exactly."""
    most = int(np.abs(values).max(initial=0)) + int(np.abs(book).max(initial=0))
    exact = np.float64 if most * most * max(1, values.shape[1]) < 2**52 else np.int64
    v, b = values.astype(exact), book.astype(exact)
    apart = (b * b).sum(1) - 2 * (v @ b.T)
    at = apart.argmin(1)
    return at, (apart[np.arange(len(v)), at] + (v * v).sum(1)).astype(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """``((dim, position), rows, values)`` of a batch of distinct parts, in blocks."""
    dims, positions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "position"))
    value = batch.column("value")
    flat, sizes = value.flatten().to_numpy(zero_copy_only=False), value.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for key in sorted(set(zip(dims.tolist(), positions.tolist(), strict=True))):
        own = np.flatnonzero((dims == key[0]) & (positions == key[1]))
        width = int(sizes[own[0]])
        for at in range(0, len(own), BLOCK):
            part = own[at : at + BLOCK]
            yield key, part, flat[starts[part][:, None] + np.arange(width)]


def _assigned_sums(books: Codebooks):
    """``(dim, position, entry, n, sums)``: a task's weight and weighted sums by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for key, part, values in _pieces(batch):
                at, _ = nearest(values, books[key])
                own = weight[part]
                small = int(own.sum()) * (int(np.abs(values).max(initial=0)) + 1) < 2**62
                kind = np.int64 if small else object
                sums = np.zeros((len(books[key]), values.shape[1]), kind)
                np.add.at(sums, at, values.astype(kind) * own[:, None].astype(kind))
                n = np.bincount(at, minlength=len(sums)) * 0
                np.add.at(n, at, own)
                for entry in np.unique(at).tolist():
                    n0, s0 = found.get((*key, entry), (0, 0))
                    found[*key, entry] = n0 + int(n[entry]), s0 + sums[entry].astype(object)
        keys, rest = list(found), list(found.values())
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rest], pa.int64()), pa.array([[int(v) for v in r[1]] for r in rest], pa.list_(pa.decimal128(38, 0)))], ["dim", "position", "entry", "n", "sums"])

    return run


def _coded(books: Codebooks):
    """``(dim, position, h1, h2, weight, entry, distance)`` of distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for key, part, values in _pieces(batch):
                entry[part], distance[part] = nearest(values, books[key])
            names = ["dim", "position", "h1", "h2", "weight"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(entry), pa.array(distance)], [*names, "entry", "distance"])

    return run


def first_books(vectors: DataFrame, dims: list[int], parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of the smallest ids of each length."""
    books: Codebooks = {}
    for dim in dims:
        rows = vectors.where(F.size("x") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
        table = np.array([r.x for r in rows], np.int64).reshape(len(rows), dim)
        books |= {(dim, p): table[:, lo:hi] for p, (lo, hi) in enumerate(bounds(dim, parts))}
    return books


def fit(distinct: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Weighted Lloyd rounds over the distinct parts."""
    for _ in range(rounds):
        sums = distinct.mapInArrow(_assigned_sums(books), "dim int, position int, entry int, n long, sums array<decimal(38,0)>")
        place = ["dim", "position", "entry"]
        counted = sums.select(*place, "n", F.posexplode_outer("sums").alias("at", "s")).groupBy(*place, "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = {key: book.copy() for key, book in books.items()}
        for r in counted.where("at IS NOT NULL").collect():  # a number for each component of an entry
            books[r.dim, r.position][r.entry, r.at] = int(r.s) // int(r.n)
    return books


def digest(books: Codebooks, dim: int, parts: int = PARTS) -> str:
    """SHA-256 of all entries' components as decimal text, by part, entry and place in the part."""
    text = ",".join(str(v) for p in range(parts) for v in books[dim, p].ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, codes, code, error, label_error, codebooks_sha256`` for every row with a finite vector."""
    spark = bounded_batches(table.sparkSession)
    rows = finite_vectors(table, embedding, F.col(vec_id).alias("vec_id"), F.col(label).alias("label")).select("vec_id", "label", whole_numbers(F.col("vec")).alias("x"))
    dims = sorted(r.dim for r in rows.groupBy(F.size("x").alias("dim")).count().collect())
    piece = F.explode(parts_of(F.col("x"), parts)).alias("p")
    hashes = [F.xxhash64("p.position", "p.value").alias("h1"), F.xxhash64(F.lit("part"), "p.position", "p.value").alias("h2")]
    pieces = rows.select(F.size("x").alias("dim"), piece).select("dim", "p.position", "p.value", *hashes)
    distinct = pieces.groupBy("dim", "position", "h1", "h2").agg(F.first("value").alias("value"), F.count("*").alias("weight"))
    distinct = cut(distinct, "parts")
    books = fit(distinct, first_books(rows, dims, parts, entries), rounds)
    coded = cut(distinct.mapInArrow(_coded(books), "dim int, position int, h1 long, h2 long, weight long, entry int, distance long"), "codes")

    keyed = rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform(parts_of(F.col("x"), parts), lambda p: F.struct(p["position"].alias("position"), F.xxhash64(p["position"], p["value"]).alias("h1"), F.xxhash64(F.lit("part"), p["position"], p["value"]).alias("h2"))).alias("p"))
    keyed = cut(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")
    total = keyed.count()
    met = counted_join(keyed.select("row", "dim", F.inline("p")), coded, ["dim", "position", "h1", "h2"], "weight", total)
    per_row = met.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda e: e["entry"]).alias("codes"), F.sum("distance").alias("error"))
    found = cut(keyed.select("row", "vec_id", "label", "dim").join(per_row, "row").drop("row"), "found")
    by_label = cut(found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("n")), "labels")
    out = counted_join(found, by_label, ["label"], "n", total)
    books_of = spark.createDataFrame([(dim, digest(books, dim, parts)) for dim in dims], "dim int, codebooks_sha256 string")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), max(2, len(f"{entries - 1:x}")), "0"))), "")
    return out.join(F.broadcast(books_of), "dim").select("vec_id", "label", "codes", code.alias("code"), "error", "label_error", "codebooks_sha256")
