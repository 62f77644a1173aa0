"""Line dedup by site-relative frequency.

For every host, the share of its pages that contain a line is the number of
pages with the line divided by the host's pages.  Lines whose share exceeds
``ratio`` and that stand on at least ``min_pages`` pages of the host are
boilerplate of that host and are removed from its pages.

Lines are compared exactly as they stand between ``\\n``, as 128-bit digests.
Counting is one grouped aggregate with map-side combine, so a host with a third
of all pages only adds rows, not a group in memory.  A host keeps at most
(mean lines a page / ratio) boilerplate lines.  That table is broadcast only
when its counted rows are at most ``broadcast_lines``; otherwise pages and
lines meet on (host, salt) with the lines repeated for each of ``salts`` salts,
so a hot host is dealt to many tasks.

Defined cases: blank lines are never removed; a null text stays null and has no
lines; an empty text is one blank line; a null host is a host of its own; every
row is a page, repeated ids and rows included; a text of any length is one array
of lines; an empty table gives an empty result.  All other columns pass through
(work columns take names that ``docs`` does not have), and ``n_lines`` and
``n_dropped`` (long), or the names asked for, replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import cut, unused


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("site-lines"), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) == ""


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """Rows ``(_host, _digest, _pages, _share)`` of the lines to remove."""
    pages = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    lines = pages.select("_host", F.explode(F.array_distinct(F.split("_text", "\n", -1))).alias("_line")).where(~_blank(F.col("_line")))
    counted = lines.groupBy("_host", _digest(F.col("_line")).alias("_digest")).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    totals = pages.groupBy("_host").agg(F.count("*").alias("_total"))
    return (
        counted.alias("c")
        .join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host")))
        .select("c._host", "_digest", "_pages", (F.col("_pages") / F.col("_total")).alias("_share"))
        .where(F.col("_share") > ratio)
    )


def line_dedup(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.1,
    min_pages: int = 5,
    broadcast_lines: int = 50_000,
    salts: int = 64,
    n_lines_col: str = "n_lines",
    n_dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus ``n_lines`` and ``n_dropped``."""
    marked = cut(boilerplate(docs, host, text, ratio, min_pages), "lines")
    site, drop, work, salt, row_salt = unused([*docs.columns, n_lines_col, n_dropped_col], "site", "drop", "work", "salt", "row_salt")
    by_host = marked.groupBy(F.col("_host").alias(site)).agg(F.collect_list("_digest").alias(drop))
    same = F.col(host).eqNullSafe(F.col(site))
    if marked.count() <= broadcast_lines:
        met = docs.join(F.broadcast(by_host), same, "left")
    else:
        spread = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = docs.withColumn(row_salt, F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")).join(spread, same & (F.col(row_salt) == F.col(salt)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(drop), _digest(x)))
    counted = F.struct(F.size(lines).alias("all"), F.when(F.col(drop).isNull(), lines).otherwise(kept).alias("kept"))
    columns = [c for c in docs.columns if c not in (n_lines_col, n_dropped_col)]
    n_lines, n_kept = F.col(work)["all"], F.size(F.col(work)["kept"])
    return met.withColumn(work, counted).select(
        *[F.array_join(F.col(work)["kept"], "\n").alias(text) if c == text else F.col(f"`{c}`") for c in columns],
        F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long").alias(n_lines_col),
        F.when(F.col(text).isNull(), 0).otherwise(n_lines - n_kept).cast("long").alias(n_dropped_col),
    )
