"""Session helpers shared by the operators: batches, bounded choices, components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.session import counted_join, cut, fresh_path, partitions, shared_dir, unused

__all__ = ["bounded_batches", "connected_components", "counted_join", "cut", "finite_vectors", "fresh_path", "numbered_columns", "partitions", "shared_dir", "sized_broadcast", "strongest", "unused"]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> SparkSession:
    """Let Spark hand texts to Python in batches of at most ``most`` bytes.

    A batch is held by the JVM and by the worker, two of which share an executor's
    memory; the operators read texts in blocks of a few megabytes anyway.  A
    smaller setting of the session stays.
    """
    size = re.fullmatch(r"(-?[0-9]+)b", spark.conf.get(BATCH, "67108864b"))
    if size and not 0 < int(size[1]) <= most:
        spark.conf.set(BATCH, f"{most}b")
    return spark


def numbered_columns(docs: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``docs`` with columns ``c0, c1, ...`` and the new name of ``column``: for Python stages, which take no dots in names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index(column)}"


def sized_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only when the counted ``rows`` do not exceed ``most``."""
    return F.broadcast(df) if rows <= most else df


def finite_vectors(table: DataFrame, embedding: str, *others: Column) -> DataFrame:
    """``others`` and ``vec`` (doubles) of the rows whose vector holds finite numbers only, and at least one."""
    vec = F.col(embedding).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(*others, vec.alias("vec")).where((F.size("vec") > 0) & ~bad)


def strongest(rows: DataFrame, weight: str, name: str, most: int) -> DataFrame:
    """The rows with the largest positive ``weight``, ``most`` of them at most, without a sort that meets in one task.

    A histogram of the weights (32 steps to a doubling, a few hundred counts)
    gives the cut; of the step that does not fit whole, rows are taken by a hash of
    ``name``, again from a histogram.  Both are exact at any number of rows.
    """
    step, part = F.floor(F.log2(F.col(weight)) * 32).cast("int"), F.pmod(F.xxhash64(F.col(name)), F.lit(4096)).cast("int")
    room, cut_at = most, None
    for r in rows.where(F.col(weight) > 0).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if r["count"] > room:
            cut_at = r.step
            break
        room -= r["count"]
    if cut_at is None:
        return rows.where(F.col(weight) > 0)
    parts = rows.where((F.col(weight) > 0) & (step == cut_at)).groupBy(part.alias("part")).count().orderBy("part").collect()
    below = 0
    for r in parts:
        if r["count"] > room:
            break
        room -= r["count"]
        below = r.part + 1
    return rows.where((F.col(weight) > 0) & ((step > cut_at) | (step == cut_at) & (part < below)))


EDGES_A_FILE = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star contraction; every step is a keyed
    minimum (combined before the shuffle) and an equi-join, so a hub with any
    number of neighbours needs no group in memory.  Only the edge count and a
    checksum reach the driver.  The count also sets the number of files that an
    iteration writes, ``EDGES_A_FILE`` edges to each: few edges are few tasks.
    Nulls and self loops are ignored; nodes without an edge are not returned.
    """
    e = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small.coalesce(-(-now[0] // EDGES_A_FILE)), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
