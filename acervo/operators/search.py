"""Search, named filters and order of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import ACTIVE

MOST_TOKENS, MOST_ROWS = 8, 200


def matches(text: Column, query_key: str) -> Column:
    """Every token of an already spaced key starts a word of the text; at most eight tokens count."""
    found = F.lit(True)
    for token in query_key.split()[:MOST_TOKENS]:
        found = found & F.concat(F.lit(" "), text).contains(" " + token)
    return found


def filters() -> dict[str, Column]:
    """Named predicates on the catalogue; complements are spelled out for nulls."""
    stock = F.col("stock")
    return {
        "classified": F.col("family").isNotNull(),
        "review": F.col("method").startswith("Revisar") | (F.col("status") != ACTIVE),
        "duplicates": F.col("duplicate_kind").isNotNull(),
        "dup_same": F.col("duplicate_kind") == "Mismo país",
        "dup_cross": F.col("duplicate_kind") == "Otro país",
        "linked": F.size(F.col("legacy_codes")) > 1,
        "with_stock": stock > 0,
        "without_stock": stock.isNull() | (stock <= 0),
        "manual": F.col("origin") == "manual",
    }


#: What a search returns: the internal total is for ordering only, stock is never added across countries.
SHOWN = "master_id code standard_code name brand model category family product_type package method status duplicate_group duplicate_kind countries stock_by_country sites_with_stock legacy_codes retired_codes origin".split()


def in_list(text: Column, value: str) -> Column:
    """Whether comma-separated text holds a whole value."""
    return F.concat(F.lit(", "), text, F.lit(",")).contains(f", {value},")


def matching(catalogue: DataFrame, query_key: str = "", country: str | None = None, named: str | None = None, family: str | None = None, category: str | None = None) -> DataFrame:
    """Products that fit; unknown filter names are ignored.

    A country finds the products that have stock there; to be seen there is not enough.
    """
    rows = catalogue.where(matches(F.col("search_text"), query_key)) if query_key else catalogue
    if country:
        rows = rows.where(F.map_contains_key("stock_by_country", country))
    if category:
        rows = rows.where(F.col("category") == category)
    if family:
        rows = rows.where(F.col("family") == family)
    return rows.where(filters()[named]) if named in filters() else rows


def search(catalogue: DataFrame, query_key: str = "", country: str | None = None, named: str | None = None, limit: int = 50, offset: int = 0, family: str | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(page, total)`` of :func:`matching`: coded products first, then stock, name and id."""
    rows = matching(catalogue, query_key, country, named, family, category)
    order = [F.col("standard_code").isNull(), F.desc_nulls_last("stock"), F.asc_nulls_first("name"), F.col("master_id")]
    shown = [c for c in SHOWN if c in catalogue.columns]
    return rows.orderBy(*order).limit(offset + min(limit, MOST_ROWS)).offset(offset).select(*shown), rows.agg(F.count("*").alias("total"))
