"""Content hashes of files, text CSV in and out."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators.numbering import dense_ids


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, sha256, length`` of each file: the key that makes a repeated load harmless."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"), "length")


def new_files(found: DataFrame, loads: DataFrame) -> DataFrame:
    """Files whose content has not been loaded."""
    return found.join(loads.select("sha256"), "sha256", "left_anti")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, empty cells as empty strings."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns]).fillna("")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports that a person opens.

    The header's first name begins with a byte order mark, by which spreadsheets know UTF-8.
    """
    first, *others = df.columns
    df.select(F.col(f"`{first}`").alias("\ufeff" + first), *[F.col(f"`{c}`") for c in others]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def ordered_fingerprint(df: DataFrame, *order: str) -> str:
    """SHA-256 over the digests of all rows in ``order``: equal only for equal rows in equal order.

    Digests are combined by ranges of the order, then range by range, so no task
    sees more than its range; ranges depend on the rows, not on the cluster's size.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    numbered = dense_ids(df.select(*order, row.alias("digest")), order, "place")
    blocks = numbered.groupBy(F.expr("place div 10000").alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    total = hashlib.sha256()
    for r in blocks.orderBy("block").toLocalIterator():
        total.update(r.digest.encode())
    return total.hexdigest()


def fingerprint(df: DataFrame, *order: str) -> DataFrame:
    """One row ``n, digest``: an order-insensitive digest of all rows and their number."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    high, low = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", F.sum(high).cast("string"), F.sum(low).cast("string")).alias("digest"))
