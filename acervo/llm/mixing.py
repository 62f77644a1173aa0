"""Mixing sources to target weights by weighted fair queueing, in DataFrame code only.

1. A document's size is its number of words.  Sources, in code point order (null
   last), take ``WEIGHTS`` in turn; they share ``SHARE`` of all sizes by weight, a
   target stops at ``PASSES`` times its source's size and the excess is shared
   again by weight until no target is above.
2. Each source has one queue: its documents shuffled by a digest of the id, once
   for each pass.  A copy's virtual finish time is the running size of its source
   up to and with it, divided by the source's target, so every source reaches its
   target at time 1.  The copy that stands across its source's target is two
   pieces, the first of which ends there.
3. The pieces of all sources are sorted by finish time in ranges and taken until
   their running size reaches the budget (all targets together, in whole words);
   the piece at the budget is cut there.

Running sizes, in the queues and in the whole, are sums inside ranges plus the
totals of the ranges before, so a source with most documents is many tasks and no
task sees all rows.  Sources that hold more than a ``HOT`` th of the documents meet
them by a broadcast (there are fewer than ``HOT`` of them), others by a hash join.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a null
source is a source of its own, apart from an empty one; null and repeated ids are
rows like others, rows equal in id, source and size may stand for each other; a
corpus without words has targets 0; texts of any length are counted whole; an empty
table gives an empty result.  Ids may have any type that casts to text.  Only id,
source and text are read, so other columns cannot clash.  Reruns agree: the order
follows from ids, sources and sizes alone, not from the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import counted_join, cut, partitions
from acervo.operators.numbering import dense_ids

#: Fixed values of the contract: weights dealt in turn, the share of all sizes, how often a document may be taken.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2


def words(text: Column) -> Column:
    """Runs of other characters than space and the five controls from tab to carriage return; null has none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def running(rows: DataFrame, order: Sequence[str], amount: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` plus ``name``: the sum of ``amount`` before each row in ``order``, for each value of ``within`` anew.

    Rows are dealt by ranges of the whole order and written; a range continues
    after the totals before it, of which there is one for each range and value in it.
    """
    keys = list(within)
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(partitions(spark), *keys, *order).withColumn("part", F.spark_partition_id()), "running")
    total = dealt.groupBy("part", *keys).agg(F.sum(amount).alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = total.withColumn("ahead", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    inside = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("inside", F.sum(amount).over(inside) - F.col(amount))
    return summed.join(ahead, ["part", *keys]).withColumn(name, (F.col("ahead") + F.col("inside")).cast("long")).drop("part", "ahead", "inside")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``sources`` (``source, source_size``) plus ``place`` in code point order and ``target``.

    Each round shares what the full sources leave by the weights of the others and
    ends when no more of them are full; only sums reach the driver.
    """
    named = sources.withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(passes) * F.col("source_size")).cast("long")
    ranked = cut(dense_ids(named, ["last", "source"], "place").drop("last").withColumn("weight", weight).withColumn("cap", cap), "sources")
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        at = ranked.agg(
            F.sum("source_size").alias("all"), F.count_if(is_full).alias("full"), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0)).alias("taken"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weights"),
        ).first()
        if at["weights"] is None or at["full"] == full:  # all are full, or none more than before
            break
        full, level = at["full"], (share * at["all"] - at["taken"]) / at["weights"]
    even = F.col("weight") * F.lit(float(level or 0.0))
    return ranked.withColumn("target", F.least(even, F.col("cap").cast("double")))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "totals")
    aimed = cut(targets(sources, weights, share, passes), "targets")
    whole = aimed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.count("*").alias("sources")).first()
    budget = int(min(share, passes) * whole["words"])

    placed = cut(counted_join(sized, aimed.select("source", "n_docs", "place", "source_size", "target"), ["source"], "n_docs", whole["docs"]), "placed")
    queued = placed.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
    # a turn that begins further behind the target than all words lost to rounding is never reached
    queued = queued.where(F.col("turn") * F.col("source_size") <= F.col("target") + whole["sources"])
    drawn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("turn").cast("string")))
    queued = queued.select("row", "place", "target", "size", "turn", drawn.alias("drawn"))
    shuffled = ["turn", "drawn", "size", "row"]
    served = running(queued, shuffled, "size", "start", within=["place"])

    stop, end = F.floor("target"), F.col("start") + F.col("size")
    first = F.greatest(F.lit(0), F.least(end, stop) - F.col("start")).cast("long")
    piece = lambda n, upto: F.struct(n.cast("long").alias("n"), (upto / F.col("target")).alias("finish"))
    across = (first > 0) & (first < F.col("size"))
    pieces = F.when(across, F.array(piece(first, stop), piece(F.col("size") - first, end))).otherwise(F.array(piece(F.col("size"), end)))
    cutting = served.withColumn("p", F.explode(pieces)).select("row", "place", "turn", "drawn", "size", "p.n", "p.finish")
    sorted_ = running(cutting, ["finish", "place", *shuffled], "n", "before")
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(budget) - F.col("before")))
    taken = sorted_.groupBy("row").agg(F.sum(kept).cast("long").alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
