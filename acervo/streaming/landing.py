"""A landing folder as a stream: the files of each micro-batch are staged once, by their content."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from acervo.plans.pipeline import Engine
from acervo.sources import files, xlsx

MOST_FILES, MOST_BOOKS = 1000, 50  # of a micro-batch


def watch(spark: SparkSession, folder: str, schema: StructType, engine: Engine, source: str, checkpoint: str) -> StreamingQuery:
    """Stage every new CSV file of ``folder``.

    A load's key is the digest of its files' contents, and each file's SHA-256 is
    stored with the load: a replayed batch, a fresh checkpoint, another folder or a
    renamed copy brings no row twice, and no file is taken for another one.
    """
    stream = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", MOST_FILES).csv(folder).select("*", F.col("_metadata.file_path").alias("_file"))

    def stage(batch: DataFrame, batch_id: int) -> None:
        paths = [r[0] for r in batch.select("_file").distinct().collect()]
        if not paths:
            return
        found = files.file_hashes(batch.sparkSession, *paths).select(F.col("path").alias("_file"), "sha256")
        one = found.groupBy("sha256").agg(F.min("_file").alias("_file"))
        loaded = engine.table("files").where(F.col("source") == source)
        fresh = files.new_files(one, loaded).orderBy("sha256").collect()
        if not fresh:
            return
        own = spark.createDataFrame([(r["_file"], r.sha256) for r in fresh], "_file string, sha256 string")
        rows = batch.where(F.regexp_replace("_file", "^file:/+", "/").isin([_plain(r["_file"]) for r in fresh])).drop("_file")
        engine.stage(rows.fillna(""), source, key=hashlib.sha256("".join(r.sha256 for r in fresh).encode()).hexdigest(), files=own)

    return stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_books(spark: SparkSession, folder: str, engine: Engine, source: str, checkpoint: str, sheet: str | None = None, most: int = MOST_BOOKS) -> StreamingQuery:
    """Stage every new XLSX file of ``folder``, on any file system that Spark reads, each as a load of its own.

    Spark's file source remembers which files a checkpoint has seen; a load's key is
    the file's SHA-256, so a replayed batch, a fresh checkpoint or a renamed copy
    stages nothing twice.
    """
    stream = spark.readStream.format("binaryFile").schema(xlsx.BINARY).option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", most).load(folder)

    def stage(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.select("path", F.sha2("content", 256).alias("sha256"))
        loaded = engine.table("files").where(F.col("source") == source)
        one = hashed.groupBy("sha256").agg(F.min("path").alias("path"))
        for r in files.new_files(one, loaded).orderBy("path").collect():
            own = xlsx.found_books(batch.sparkSession, r.path)
            rows = xlsx.books(own, xlsx.header(own, sheet), sheet).drop("path")
            engine.stage(rows, source, r.sha256, batch.sparkSession.createDataFrame([(r.sha256,)], "sha256 string"))

    return stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _plain(path: str) -> str:
    """A path as both file listings write it: local ones without their scheme."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
