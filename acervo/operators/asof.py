"""As-of lookup: for each asked time the last row of the same key that was known by then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.numbering import ranged
from acervo.session import unused


def latest(asked: DataFrame, rows: DataFrame, at: str, since: str, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``asked`` plus ``keep`` of the last of ``rows`` with equal ``keys`` and ``since`` <= ``at`` (of equal times the last by ``order``).

    Both sides are dealt together by ranges of (keys, time), so a source with most
    rows is many tasks and no task compares all pairs.  Inside a range the last
    row seen is carried along; across ranges the last row of the ranges before is,
    of which there is one for each range and key in it.  Where nothing is known
    yet, or a key or a time is null, ``keep`` is null.
    """
    t, side, a, r, part, carried, seen = unused([*keys, *order, *keep], "t", "side", "a", "r", "part", "carried", "seen")
    places = [f"o{i}" for i in range(len(order))]
    names = unused([t, side, a, r, part, carried, seen, *keys], *places)
    known = rows.where(F.col(since).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(asked.columns)])
    kept = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    left = asked.select(*keys, F.col(at).alias(t), F.lit(1).alias(side), *[F.lit(None).cast(rows.schema[c].dataType).alias(n) for c, n in zip(order, names, strict=True)], whole.alias(a))
    right = known.select(*keys, F.col(since).alias(t), F.lit(0).alias(side), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], kept.alias(r))
    place = [t, side, *names]
    dealt = ranged(left.unionByName(right, allowMissingColumns=True), [*keys, *place], part)
    inside = Window.partitionBy(part, *keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn(seen, F.last(r, ignorenulls=True).over(inside)).where(F.col(a).isNotNull())
    last = dealt.groupBy(part, *keys).agg(F.max_by(r, F.when(F.col(r).isNotNull(), F.struct(*place))).alias(r))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(part, *keys, F.last(r, ignorenulls=True).over(earlier).alias(carried))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (part, *keys)]
    met = local.alias("l").join(before.alias("r"), same, "left").select(f"l.{a}", F.coalesce(f"l.{seen}", f"r.{carried}").alias(r))
    return met.select(*[F.col(a)[f"c{i}"].alias(c) for i, c in enumerate(asked.columns)], *[F.col(r)[f"k{i}"].alias(c) for i, c in enumerate(keep)])
