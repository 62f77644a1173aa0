"""Stock and presence per product and country; countries are never added together.

Input: observations with ``code``, ``site``, ``country`` (null if unknown),
``site_type`` and ``stock``.  Each function is one grouped aggregate (combined
before its shuffle) unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import general_number

#: Fixed value: the bucket of stock whose site has no country.
NO_COUNTRY = "Sin país"
#: Fixed value: the kind of a site that has none.
NO_KIND = "Sin tipo"


#: Type in which amounts are added: exact to ten decimals.
AMOUNT = "decimal(38,10)"


def total(amount: Column) -> Column:
    """The sum of doubles, the same in any order: added as decimals with ten places.

    Amounts too large for that (from 1e28 on) make the whole sum one of doubles.
    """
    exact = amount.try_cast(AMOUNT)
    return F.when(F.count(exact) == F.count(amount), F.coalesce(F.try_sum(exact).cast("double"), F.sum(amount))).otherwise(F.sum(amount))


def available(obs: DataFrame, types: Sequence[str]) -> DataFrame:
    return obs.where(F.col("site_type").isin(*types) & (F.col("stock") > 0))


def stock_by_country(obs: DataFrame, types: Sequence[str], code: str = "code") -> DataFrame:
    """``code, country, quantity``: positive stock at available kinds of sites."""
    country = F.coalesce("country", F.lit(NO_COUNTRY))
    return available(obs, types).groupBy(code, country.alias("country")).agg(total(F.col("stock")).alias("quantity"))


def stock_map(obs: DataFrame, types: Sequence[str], code: str = "code") -> DataFrame:
    """``code, stock_by_country`` (sorted map) and its text ``A: 13 · B: 2.5``."""
    per = stock_by_country(obs, types, code).groupBy(code).agg(F.array_sort(F.collect_list(F.struct("country", "quantity"))).alias("pairs"))
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p["country"], F.lit(": "), general_number(p["quantity"]))), " · ")
    return per.select(code, F.map_from_entries("pairs").alias("stock_by_country"), text.alias("stock_text"))


def presence(obs: DataFrame, code: str = "code") -> DataFrame:
    """``code, countries``: sorted countries with any row; unknown countries do not count."""
    return obs.groupBy(code).agg(F.array_sort(F.collect_set("country")).alias("countries"))


def stocked_sites(obs: DataFrame, types: Sequence[str], code: str = "code") -> DataFrame:
    has = F.col("site_type").isin(*types) & (F.col("stock") > 0)
    return obs.groupBy(code).agg(F.count_distinct(F.when(has, F.col("site"))).alias("sites_with_stock"))


def country_counts(obs: DataFrame, types: Sequence[str], code: str = "code") -> DataFrame:
    """Products per stocked country, the unknown country last (``place`` orders them)."""
    per = stock_by_country(obs, types, code).groupBy("country").agg(F.count("*").alias("products"))
    return per.withColumn("last", (F.col("country") == NO_COUNTRY).cast("int"))


def stock_summary(obs: DataFrame, types: Sequence[str], keys: Sequence[str] = ("country",)) -> DataFrame:
    """Available stock, and stock that is there but not available, by country."""
    positive = F.when(F.col("stock") > 0, F.col("stock"))
    free = F.col("site_type").isin(*types)
    none = F.lit(0.0)
    return obs.withColumn("country", F.coalesce("country", F.lit(NO_COUNTRY))).groupBy(*keys).agg(
        F.coalesce(total(F.when(free, positive)), none).alias("available"),
        F.coalesce(total(F.when(~free, positive)), none).alias("unavailable"),
    )


def stock_by_kind(obs: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    return obs.groupBy(code, name, F.coalesce("country", F.lit(NO_COUNTRY)).alias("country"), "site_type").agg(total(F.col("stock")).alias("stock"))


def unavailable_share(obs: DataFrame, types: Sequence[str]) -> DataFrame:
    all_, off = F.greatest("stock", F.lit(0.0)), ~F.col("site_type").isin(*types)
    return obs.agg(total(F.when(off, all_)).alias("unavailable"), total(all_).alias("total")).withColumn("share", F.round(F.col("unavailable") / F.col("total"), 6))


def unavailable_map(obs: DataFrame, types: Sequence[str]) -> DataFrame:
    """``country, unavailable``: positive stock at other than available kinds of sites, as a sorted map by kind."""
    off = obs.where(~F.col("site_type").isin(*types) & (F.col("stock") > 0))
    per = off.groupBy(F.coalesce("country", F.lit(NO_COUNTRY)).alias("country"), "site_type").agg(total(F.col("stock")).alias("stock"))
    return per.groupBy("country").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("site_type", "stock")))).alias("unavailable"))


def own_rows(products: DataFrame, rows: DataFrame, sites: DataFrame, types: Sequence[str]) -> DataFrame:
    """What is seen of each product: the rows of its own load under its own codes, with country and kind of the site.

    ``products`` has ``master_id, load_id, legacy_codes``, ``rows`` ``load_id, code,
    site, stock`` (and more), ``sites`` ``site, country, site_type``.  A row of
    another load, older or newer, is not the product's.
    """
    codes = products.select("master_id", "load_id", F.explode("legacy_codes").alias("code"))
    met = rows.join(codes, ["load_id", "code"]).join(sites.select("site", "country", "site_type"), "site", "left")
    return met.withColumn("available", F.coalesce(F.col("site_type").isin(*types), F.lit(False)))


def in_detail_order(rows: DataFrame) -> DataFrame:
    """Available stock first, then by stock."""
    return rows.orderBy(F.desc("available"), F.desc("stock"), "site", "code")


def stock_of_products(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, country, available, unavailable``: positive stock by country, what is not available as a map by kind of site."""
    kind = F.when(~F.col("available"), F.coalesce("site_type", F.lit(NO_KIND)))
    per = rows.where("stock > 0").groupBy(*keys, F.coalesce("country", F.lit(NO_COUNTRY)).alias("country"), kind.alias("kind")).agg(total(F.col("stock")).alias("n"))
    off = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))))
    return per.groupBy(*keys, "country").agg(F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0.0)).alias("available"), off.alias("unavailable"))
