"""Links between products as a forest: who stands for whom, after chains, undone links and repeats.

A link says that product ``source`` goes on under product ``target``.  A product has
at most one open link to another, which may itself be linked on, so open links are a
directed forest and a product stands under the root of its tree.  Undoing a link
cuts that edge alone: the source and all below it are a tree of their own again,
in whatever order links are undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.session import counted_join, cut, partitions, unused


class Cycle(ValueError):
    """Open links lead back to where they started."""


def open_links(log: DataFrame, key: str = "link_id", undone: str = "undone") -> DataFrame:
    """The links of a log that were never undone: a link may stand there several times, undone in any of them."""
    closed = log.where(undone).select(key).distinct()
    return log.where(~F.col(undone)).join(closed, key, "left_anti").dropDuplicates([key])


def roots(links: DataFrame, source: str = "source_id", target: str = "target_id", label: str = "roots") -> DataFrame:
    """``node, root, steps`` of every product with an open link, by pointer jumping.

    ``links`` are open links, one for each source.  In every round a node takes over
    the pointer of the node it points to, so a chain of n links takes log2(n)
    rounds; pointers that have reached a root are done and leave the rounds.
    Targets are looked up once each, and those that many nodes point to meet them by
    a broadcast, so a tree with most nodes under one root is no hot key.  Each round
    is written; only counts reach the driver.  Links in a circle have no root and
    raise :class:`Cycle`.
    """
    open_ = cut(links.select(F.col(source).alias("node"), F.col(target).alias("root"), F.lit(1).cast("long").alias("steps")), label)
    first = waiting = open_.count()
    done, rounds = open_.limit(0), 0
    while waiting:
        if 2**rounds > 2 * first:
            raise Cycle(f"{waiting} links lead in a circle")
        every = done.unionByName(open_).select(F.col("node").alias("root"), F.col("root").alias("further"), F.col("steps").alias("more"))
        targets = open_.groupBy("root").agg(F.count("*").alias("n")).join(every, "root", "left")
        met = cut(counted_join(open_, targets, ["root"], "n", waiting), label)
        done = done.unionByName(met.where("further IS NULL").select("node", "root", "steps"))
        open_ = met.where("further IS NOT NULL").select("node", F.col("further").alias("root"), (F.col("steps") + F.col("more")).alias("steps"))
        waiting, rounds = open_.count(), rounds + 1
    return done


def under_roots(table: DataFrame, forest: DataFrame, key: str) -> DataFrame:
    """``table`` with ``key`` replaced by its root, and ``linked`` where that is another."""
    (node, root) = unused(table.columns, "node", "root")
    met = table.join(forest.select(F.col("node").alias(node), F.col("root").alias(root)), F.col(key) == F.col(node), "left")
    return met.withColumn("linked", F.col(root).isNotNull()).withColumn(key, F.coalesce(root, key)).drop(node, root)


def retired(links: DataFrame, forest: DataFrame, code: str = "retired_code") -> DataFrame:
    """``root, retired_codes``: the codes given up by links anywhere below a root, in order."""
    met = links.where(F.col(code).isNotNull()).join(forest.select(F.col("node").alias("source_id"), "root"), "source_id")
    return met.groupBy("root").agg(F.array_sort(F.collect_list(code)).alias("retired_codes"))


#: Characters of text that one group of a join hands out at most (a row at least), and a task on average.
BLOCK = 2**32
#: How Parquet writes rows of megabytes: a text once in a file, pages looked at every few rows (by itself: dictionaries to 1 MB, every 100 rows).
WIDE = {"parquet.dictionary.page.size": str(2**26), "parquet.page.size.row.check.min": "10"}


def wide_rows(spark: SparkSession, text: str) -> None:
    """Let Parquet files of a long repeated ``text`` be written in bounded memory, also by the caller; what the session or Hadoop's settings say stays.

    Parquet compares every text with the least and the greatest so far, and drops both
    where they are long, so it keeps none for this column.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in {**WIDE, f"parquet.column.statistics.enabled#{text}": "false"}.items():
        if spark.conf.get(key, None) is None and hadoop.get(key) is None:
            spark.conf.set(key, value)


def with_text(forest: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``forest`` with the ``text`` of its root, from ``root, text`` with a row for each root.

    A root's text grows with its tree and goes to every node of it, so the nodes of a
    large tree are dealt in blocks, each of which gets one copy of the text.  Blocks are
    numbered before they meet the text: a merge join makes one copy at a time, where
    ``explode`` beside the text would hold all copies of a row at once.
    """
    wide_rows(forest.sparkSession, text)
    per = forest.groupBy("root").agg(F.count("*").alias("nodes"))
    sized = texts.select("root", text).join(per, "root").withColumn("chars", F.col("nodes") * F.length(text))
    sized = cut(sized.withColumn("blocks", F.least("nodes", F.ceil(F.col("chars") / BLOCK) + 1)), "texts")
    total, chars = sized.agg(F.coalesce(F.sum("nodes"), F.lit(0)), F.coalesce(F.sum(F.col("chars").cast("double")), F.lit(0.0))).first()
    tasks = max(partitions(forest.sparkSession), int(chars // BLOCK) + 1)
    dealt = counted_join(forest, sized.select("root", "nodes", "blocks"), ["root"], "nodes", total).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    numbered = sized.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    copies = numbered.join(sized.select("root", text).hint("merge"), "root")
    dealt, copies = (side.repartition(tasks, "root", "block") for side in (dealt, copies))
    return dealt.join(copies.hint("merge"), ["root", "block"]).select(*forest.columns, text)
