"""Stock by country and duplicate groups kept up by signed changes instead of being computed again.

A cell ``(code, country, quantity, n_stock, n_rows)`` holds what a code has in a
country: available stock, how many rows it comes from, and how many rows are seen
there at all.  Cells are sums, so a change of some sites is the cells of their
rows as they were, taken off, and as they are, put on; a link moves a code's cells
to another code.  Only rows of changed sites and cells of moved codes are read, and
a cell without rows is gone.  Quantities are decimals, so nothing drifts.

Duplicate groups rest on counts of members by key and country in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.operators.duplicates import OTHER, SAME
from acervo.operators.inventory import AMOUNT, NO_COUNTRY

SUMS = ("quantity", "n_stock", "n_rows")


def cells(rows: DataFrame, sites: DataFrame, types: Sequence[str], code: str = "code", sign: int = 1) -> DataFrame:
    """Cells of ``rows (code, site, stock)`` at ``sites (site, country, site_type)``; with ``sign`` -1 what to take off."""
    met = rows.select(code, "site", "stock").join(sites.select("site", "country", "site_type"), "site", "left")
    counts = F.coalesce(F.col("site_type").isin(*types), F.lit(False)) & (F.col("stock") > 0)
    amount = F.when(counts, F.col("stock")).otherwise(0.0).cast(AMOUNT)
    one = met.groupBy(code, F.coalesce("country", F.lit(NO_COUNTRY)).alias("country")).agg(F.sum(amount).alias("quantity"), F.count_if(counts).alias("n_stock"), F.count("*").alias("n_rows"))
    return one.select(code, "country", *[(F.lit(sign) * F.col(c)).cast(AMOUNT if c == "quantity" else "long").alias(c) for c in SUMS])


def site_change(rows: DataFrame, before: DataFrame, after: DataFrame, types: Sequence[str], code: str = "code") -> DataFrame:
    """The signed cells that changed sites bring: ``before`` and ``after`` hold the changed sites alone, and only their rows are read."""
    own = rows.join(after.select("site").distinct(), "site", "left_semi")
    return cells(own, before, types, code, -1).unionByName(cells(own, after, types, code))


def link_change(stored: DataFrame, moves: DataFrame, code: str = "code") -> DataFrame:
    """The signed cells that links bring: the cells of ``moves (code, target)`` taken off and put on their targets."""
    own = stored.join(moves.select(F.col(code), "target"), code)
    off = own.select(code, "country", *[(-F.col(c)).cast(stored.schema[c].dataType).alias(c) for c in SUMS])
    return off.unionByName(own.select(F.col("target").alias(code), "country", *SUMS))


def merged(stored: DataFrame, *changes: DataFrame, code: str = "code") -> DataFrame:
    """Stored cells with signed ones added; cells without rows are gone."""
    every = stored
    for change in changes:
        every = every.unionByName(change)
    summed = every.groupBy(code, "country").agg(*[F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in SUMS])
    return summed.where("n_rows <> 0")


def products(stored: DataFrame, code: str = "code") -> DataFrame:
    """``code, stock_by_country, countries``: what the cells say of each code, as :mod:`inventory` computes it from rows."""
    stock = F.array_sort(F.collect_list(F.when(F.col("n_stock") > 0, F.struct("country", F.col("quantity").cast("double").alias("quantity")))))
    seen = F.array_sort(F.collect_list(F.when(F.col("country") != NO_COUNTRY, F.col("country"))))
    return stored.groupBy(code).agg(F.map_from_entries(stock).alias("stock_by_country"), seen.alias("countries"))


# ---------------------------------------------------------------- duplicate groups
EVERY, NOWHERE = "*", ""


def members(rows: DataFrame, key: str, countries: str = "countries", sign: int = 1) -> DataFrame:
    """``key, country, n``: members of each key in each country, beside all of them (``*``) and those seen nowhere."""
    places = F.concat(F.array(F.lit(EVERY)), F.when(F.size(countries) == 0, F.array(F.lit(NOWHERE))).otherwise(F.col(countries)))
    return rows.where(F.col(key).isNotNull()).select(key, F.explode(places).alias("country")).groupBy(key, "country").agg((F.lit(sign) * F.count("*")).cast("long").alias("n"))


def merged_members(stored: DataFrame, *changes: DataFrame, key: str) -> DataFrame:
    every = stored
    for change in changes:
        every = every.unionByName(change)
    return every.groupBy(key, "country").agg(F.sum("n").alias("n")).where("n <> 0")


def kinds(counts: DataFrame, key: str) -> DataFrame:
    """``key, members, kind`` of keys with two members or more, as :func:`duplicates.kinds` finds them from all products."""
    at = lambda place: F.max(F.when(F.col("country") == place, F.col("n")))
    shared: Column = F.max(F.when(~F.col("country").isin(EVERY, NOWHERE), F.col("n")))
    one = counts.groupBy(key).agg(at(EVERY).alias("members"), at(NOWHERE).alias("unknown"), shared.alias("shared")).where("members > 1")
    same = F.col("unknown").isNotNull() | (F.coalesce("shared", F.lit(0)) > 1)
    return one.select(key, "members", F.when(same, SAME).otherwise(OTHER).alias("kind"))
