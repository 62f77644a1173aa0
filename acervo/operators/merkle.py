"""Two versions of a table compared by a tree of digests: only the buckets that differ are read row by row.

Rows are dealt to buckets by the CRC-32 of their key.  A leaf is the digest of a
bucket's rows in any order (their number and the sums of two halves of their
SHA-256), a node the digest of ``FAN`` nodes below it, up to one root.  The tree is
stored beside a version; comparing two walks down from the roots through nodes that
differ, and rows are read of the leaves that are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.session import cut

FAN = 16


def bucket(key: Column, leaves: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(leaves)).cast("int")


def _halves(df: DataFrame) -> list[Column]:
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)").alias(name) for at, name in ((1, "d1"), (16, "d2"))]


def _summed() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("d1").alias("s1"), F.sum("d2").alias("s2")]


def _digest() -> Column:
    return F.sha2(F.concat_ws("-", "n", "s1", "s2"), 256)


def levels(leaves: int) -> int:
    """Steps from the leaves to the root."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FAN), n + 1
    return n


def tree(df: DataFrame, key: str, leaves: int) -> DataFrame:
    """``level, node, digest``: leaves that hold rows are level 0; a node's digest is of its children's, in order.

    One pass over the rows, combined before its shuffle; a level is a ``FAN`` th of the one below.
    """
    rows = df.select(bucket(F.col(key), leaves).alias("node"), *_halves(df))
    level = cut(rows.groupBy("node").agg(*_summed()).select(F.lit(0).alias("level"), "node", _digest().alias("digest")), "leaves")
    out = level
    for up in range(1, levels(leaves) + 1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"], c["digest"])), ",")
        level = level.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sha2(children, 256).alias("digest")).select(F.lit(up).alias("level"), "node", "digest")
        out = out.unionByName(level)
    return out


def differing(a: DataFrame, b: DataFrame, leaves: int) -> DataFrame:
    """``node`` of the leaves that differ between two trees: from the root, the children of nodes that differ."""
    met = cut(a.alias("a").join(b.alias("b"), (F.col("a.level") == F.col("b.level")) & (F.col("a.node") == F.col("b.node")), "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(F.coalesce("a.level", "b.level").alias("level"), F.coalesce("a.node", "b.node").alias("node")), "nodes")
    at = met.where(F.col("level") == levels(leaves)).select("node")
    for level in reversed(range(levels(leaves))):
        below = met.where(F.col("level") == level).select("node", F.floor(F.col("node") / FAN).cast("int").alias("up"))
        at = below.join(at.withColumnRenamed("node", "up"), "up", "left_semi").select("node")
    return at


def changed_rows(a: DataFrame, b: DataFrame, key: str, tree_a: DataFrame, tree_b: DataFrame, leaves: int) -> DataFrame:
    """``key, change``: keys whose rows were ``added``, ``removed`` or ``changed`` from ``a`` to ``b``.

    Keys may repeat: a key's rows are compared as a whole, in any order.  A null key
    is a key like others.
    """
    touched = F.broadcast(differing(tree_a, tree_b, leaves))  # at most as many as leaves, an int each
    sides = []
    for df, name in ((a, "old"), (b, "new")):
        rows = df.select(F.col(key).alias("key"), bucket(F.col(key), leaves).alias("node"), *_halves(df)).join(touched, "node", "left_semi")
        sides.append(rows.groupBy("key").agg(*_summed()).select("key", _digest().alias(name)))
    met = sides[0].alias("o").join(sides[1].alias("n"), F.col("o.key").eqNullSafe(F.col("n.key")), "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce("o.key", "n.key").alias(key), kind.alias("change"))
