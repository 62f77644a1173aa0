"""Dense numbers in a global order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.session import cut, partitions, unused


def ranged(rows: DataFrame, order: Sequence[str], part: str) -> DataFrame:
    """``rows`` dealt by ranges of the whole ``order``, with their range in ``part``, written to the shared folder.

    Writing fixes the ranges: later passes see the same ones, also after a lost executor.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    return cut(dealt.withColumn(part, F.spark_partition_id()), "ranged")


def dense_ids(rows: DataFrame, order: Sequence[str], name: str, start: Column | int = 0, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` plus ``name`` = ``start`` + 1, 2, ... in ``order``, for each value of ``within`` anew.

    Rows are dealt by ranges of all ordering columns (after ``within``) and
    numbered within their range; a range continues after the counts before it.
    So one task holds one range, however few values ``within`` has; the counts
    are one row for each range and value in it.  Rows equal in ``order`` are
    numbered one after another.
    """
    part, at, n, before = unused(rows.columns, "part", "at", "n", "before")
    keys = list(within)
    dealt = ranged(rows, [*keys, *order], part)
    size = dealt.groupBy(part, *keys).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counted = size.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    place = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    start = F.lit(start) if isinstance(start, int) else start
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (part, *keys)]
    met = dealt.withColumn(at, place).alias("l").join(counted.alias("r"), same, "inner")
    numbered = (start + F.col(f"r.{before}") + F.col(f"l.{at}")).cast("long").alias(name)
    return met.select(*[F.col(f"l.`{c}`") for c in rows.columns], numbered)
