"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Vectors are compared only when their labels are equal and not null; a link is a
cosine of at least ``LEAST`` in double precision.

1. Equal vectors of one label (128 bits of hash) form one class; classes, not
   copies, are hashed.
2. A table's code joins ``depth`` cross-polytopes: for each, three rounds of
   random signs and the fast Hadamard transform of the unit vector (zero-padded
   to a power of two) and the largest coordinate with its sign.  ``depth`` grows
   with the logarithm of the largest label's classes, so that a class shares a
   bucket with fewer than about one class by chance at any size of the input.
3. Multiprobe: of the codes made from the ``NEAR`` largest coordinates of each
   polytope, the ``PROBES`` with the smallest score gap are visited.  A pair is a
   candidate when any of their probes agree in any table.  The number of tables
   comes from the rate at which vectors at cosine ``LEAST`` agree (measured on
   drawn pairs of that dimension), for an expected miss of at most ``MISS`` at
   the threshold itself, less above it.
4. The smallest class of a bucket is its hub; members meet at their distinct
   hubs, so vectors that agree in many tables still travel about once.  A large
   hub is split in pairs of blocks of ``BLOCK`` members, which go to different
   tasks; a block pair's cosines are one matrix product, which verifies every
   candidate.  A pair that meets at several hubs counts at the smallest of them
   (members carry their hubs), so no pair is emitted or collected to count it.
5. Tasks return a count of links by class and a spanning forest, never pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and rows without a label, link with nothing; vectors of different
lengths never link; labels are compared as they stand, of any type; ids are
integers (others fail in the cast); a null id links with nothing and is returned
with null component, not kept; rows that repeat an id are one node of the graph,
each row with the links of its own vector (rows equal in id and vector are two
vectors of one node); an empty table gives an empty result.  Vectors may have any
length: a task holds two blocks of them.  Only id, vector and label are read, so
other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import bounded_batches, connected_components, cut, partitions
from acervo.llm.textkit import mix

PROBES, NEAR = 3, 3
SPREAD = 64  # buckets of a table for each class of the largest label
DEPTH = 6
TABLES = 32
MISS = 0.002
BLOCK = 1024
LEAST = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows (length a power of two), orthonormal."""
    n, d = x.shape
    step = 1
    x = x.copy()
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
        x = x.reshape(n, d)
    return x / np.sqrt(d)


def padded_size(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def signs(d: int, table: int, polytope: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([d, table, polytope])).integers(0, 2, (3, d)) * 2.0 - 1.0


def table_codes(padded: np.ndarray, table: int, depth: int) -> np.ndarray:
    """``n x probes`` codes of unit rows in one table, the nearest first."""
    n, d = padded.shape
    near = min(NEAR, d)
    choices = np.array(sorted(product(range(near), repeat=depth), key=lambda c: (sum(c), c))[: 1 + 4 * depth * near], np.int64)
    gap = np.zeros((n, len(choices)))
    vertex = []
    for k in range(depth):
        y = padded
        for s in signs(d, table, k):
            y = hadamard(y * s)
        top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
        value = np.take_along_axis(y, top, axis=1)
        size = np.abs(value)
        gap += ((size[:, :1] - size) ** 2)[:, choices[:, k]]
        vertex.append((2 * top + (value < 0)).astype(np.uint64))
    chosen = choices[np.argsort(gap, axis=1, kind="stable")[:, :PROBES]]
    code = np.full(chosen.shape[:2], np.uint64(table + 1))
    for k in range(depth):
        code = mix(code) + np.take_along_axis(vertex[k], chosen[:, :, k], axis=1)
    return mix(code)


@lru_cache(maxsize=256)
def tables_needed(dim: int, depth: int, least: float) -> int:
    """Tables for an expected miss of ``MISS`` at cosine ``least``, from the rate of drawn pairs in one table."""
    if dim < 2 or least >= 1:
        return 1
    rng = np.random.Generator(np.random.PCG64([dim, depth]))
    a, g = rng.standard_normal((2, 600, dim))
    a /= np.sqrt((a * a).sum(1))[:, None]
    g -= (g * a).sum(1)[:, None] * a
    g /= np.sqrt((g * g).sum(1))[:, None]
    pad = ((0, 0), (0, padded_size(dim) - dim))
    ca, cb = (table_codes(np.pad(x, pad), 0, depth) for x in (a, least * a + math.sqrt(1 - least * least) * g))
    rate = min(0.99, max(0.05, float((ca[:, :, None] == cb[:, None, :]).any((1, 2)).mean())))
    return min(TABLES, math.ceil(math.log(MISS) / math.log(1 - rate)))


def depth_for(dim: int, classes: int) -> int:
    """Polytopes to a table so that it has ``SPREAD`` buckets for each of ``classes``."""
    vertices = 2 * padded_size(dim)
    return next((k for k in range(1, DEPTH) if vertices**k >= SPREAD * classes), DEPTH)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit vectors of finite rows that are not zero, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _key_rows(largest: dict[int, int], least: float):
    """``(cid, key)`` of classes ``(cid, place, vec)``; ``place`` tells labels apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                raw = _vectors(batch.column("vec"))
                cid = batch.column("cid").to_numpy(zero_copy_only=False)
                place = batch.column("place").to_numpy(zero_copy_only=False).view(np.uint64)
                for dim in sorted({len(r) for r in raw}):
                    own = np.array([i for i, r in enumerate(raw) if len(r) == dim])
                    depth = depth_for(dim, largest[dim])
                    padded = np.pad(unit_rows(np.stack([raw[i] for i in own])), ((0, 0), (0, padded_size(dim) - dim)))
                    salt = mix(place[own] + np.uint64(dim))[:, None]
                    keys = np.concatenate([mix(table_codes(padded, t, depth) ^ salt) for t in range(tables_needed(dim, depth, least))], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[own], keys.shape[1])), pa.array(keys.ravel().view(np.int64))], ["cid", "key"])

    return run


def _counted_elsewhere(left: list, right: list, hub: int) -> np.ndarray:
    """For pairs of two lists of hub sets: whether they share a hub smaller than ``hub``."""
    sets = [[set(h[h < hub].tolist()) for h in side] for side in (left, right)]
    every = sorted(set().union(*sets[0]) & set().union(*sets[1])) if left and right else []
    place = {h: i for i, h in enumerate(every)}
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(every), 512):
        marks = []
        for side in sets:
            has = np.zeros((len(side), min(512, len(every) - lo)), np.float32)
            for i, hubs in enumerate(side):
                for h in hubs:
                    if lo <= place.get(h, -1) < lo + 512:
                        has[i, place[h] - lo] = 1
            marks.append(has)
        out |= marks[0] @ marks[1].T > 0
    return out


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (hub, b1, b2): counts ``(cid, links, null, null)`` and edges ``(null, 0, a, b)`` of members."""
        now, sides = None, ([], [])

        def flush() -> pa.RecordBatch:
            left, right = sides
            alone = now[1] == now[2]
            right = left if alone else right
            cids, links, a, b = [], [], [], []
            if left and right:
                x = unit_rows(np.stack([r[3] for r in left]))
                y = x if alone else unit_rows(np.stack([r[3] for r in right]))
                linked = x @ y.T >= least
                if alone:
                    np.fill_diagonal(linked, False)
                if linked.any():
                    linked &= ~_counted_elsewhere([r[4] for r in left], [r[4] for r in right], now[0])
                for side, total in ((left, linked @ np.array([r[2] for r in right], np.int64)), *(() if alone else ((right, linked.T @ np.array([r[2] for r in left], np.int64)),))):
                    some = np.flatnonzero(total)
                    cids += [side[i][0] for i in some.tolist()]
                    links += total[some].tolist()
                a, b = [None] * len(cids), [None] * len(cids)
                parent: dict[int, int] = {}

                def root(v: int) -> int:
                    while parent.setdefault(v, v) != v:
                        parent[v] = parent[parent[v]]
                        v = parent[v]
                    return v

                for i, j in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
                    p, q = root(left[i][1]), root(right[j][1])
                    if p != q:
                        parent[p] = q
                        cids.append(None)
                        links.append(0)
                        a.append(left[i][1])
                        b.append(right[j][1])
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (cids, links, a, b)], ["cid", "links", "a", "b"])

        for batch in batches:
            vectors, hubs = _vectors(batch.column("vec")), _vectors(batch.column("hubs"))
            names = ("hub", "b1", "b2", "side", "cid", "member", "copies")
            for i, (hub, b1, b2, side, cid, member, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if (hub, b1, b2) != now:
                    if now is not None:
                        yield flush()
                    now, sides = (hub, b1, b2), ([], [])
                sides[side].append((cid, member, copies, vectors[i], hubs[i]))
        if now is not None:
            yield flush()

    return run


def vector_classes(table: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vec_id, label, h1, h2)``, with null hashes where a row links with nothing, and the classes of the others."""
    kind = "array<float>" if table.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vec"), F.col(label).alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0)
    hashed = rows.withColumns({"h1": F.when(fits, F.xxhash64("vec")), "h2": F.when(fits, F.xxhash64(F.lit("class"), "vec"))})
    classes = hashed.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("member"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    return hashed.drop("vec"), cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def candidates(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """``(hub, cid)``: classes that share a bucket meet at its smallest class."""
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n"))
    largest = {r.dim: r.n for r in sizes.collect()}  # one number for each length of vectors
    keys = classes.select("cid", F.xxhash64("label").alias("place"), "vec").mapInArrow(_key_rows(largest, least), "cid long, key long")
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub < top").select("key", "hub")
    return keys.join(hubs, "key").select("hub", "cid").distinct()


def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table``."""
    n = partitions(bounded_batches(table.sparkSession))
    rows, classes = vector_classes(table, vec_id, embedding, label)
    members = cut(candidates(classes, least), "members")
    size = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).where("n_blocks > 1")
    hubs = members.groupBy("cid").agg(F.array_sort(F.collect_list("hub")).alias("hubs"))  # at most a hub for each probe
    placed = classes.select("cid", "member", "copies", "vec").join(hubs, "cid").withColumn("hub", F.explode("hubs")).join(size, "hub", "left")
    placed = placed.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int"))
    # block pairs (b1 <= b2) that a member is in: on the left of (own, b), on the right of (b, own)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.struct(F.least("own", b).alias("b1"), F.greatest("own", b).alias("b2"), (b < F.col("own")).cast("int").alias("side"))))
    tasks = placed.withColumn("p", pair).select("hub", "p.b1", "p.b2", "p.side", "cid", "member", "copies", "vec", "hubs")
    where = ["hub", "b1", "b2"]
    found = cut(tasks.repartition(n, *where).sortWithinPartitions(*where).mapInArrow(_links(least), "cid long, links long, a long, b long"), "links")
    counts = found.where("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))

    named = classes.select("label", "h1", "h2", "cid", "member", "copies").join(counts, "cid", "left").withColumn("own_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    named = named.select("label", "h1", "h2", "member", "own_links")
    met = rows.join(named, ["label", "h1", "h2"], "left")
    twice = rows.where("h1 IS NOT NULL").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    same = met.join(twice, "vec_id").select(F.col("vec_id").alias("a"), F.col("member").alias("b"))  # one node, several vectors
    parts = connected_components(found.where("a IS NOT NULL").select("a", "b").unionByName(same)).withColumnRenamed("node", "member")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "member", "vec_id"))
    return met.join(parts, "member", "left").select("vec_id", F.coalesce("own_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
