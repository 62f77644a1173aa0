"""Duplicate groups of products with one key, within a country and across countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import compact_key, group_id
from acervo.operators.numbering import dense_ids

#: Kinds of groups.
SAME, OTHER = "Mismo país", "Otro país"


def key_of(base: Column, brand_key: Column, model: Column) -> Column:
    """What equal products share: the compact base name, the brand's key and the compact model; null without a name."""
    return F.when(base.isNotNull(), F.concat_ws("|", compact_key(base), F.coalesce(brand_key, F.lit("")), compact_key(model)))


def groups(products: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Members of keys that hold at least two products, with group id and size.

    Sizes come from a combined aggregate and are joined back, so a key with very
    many members is not held in one place.
    """
    size = products.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    return products.join(size, key).select(code, key, group_id(F.col(key)).alias("group_id"), "members")


def kinds(products: DataFrame, key: str, countries: str = "countries") -> DataFrame:
    """``key, members, kind``: same country if a member has none, or two members share one."""
    members = products.where(F.col(key).isNotNull())
    size = members.groupBy(key).agg(F.count("*").alias("members"), F.bool_or(F.size(countries) == 0).alias("unknown")).where("members > 1")
    shared = members.select(key, F.explode(countries).alias("_c")).groupBy(key, "_c").agg(F.count("*").alias("_n")).groupBy(key).agg((F.max("_n") > 1).alias("shared"))
    same = F.col("unknown") | F.coalesce("shared", F.lit(False))
    return size.join(shared, key, "left").select(key, "members", F.when(same, SAME).otherwise(OTHER).alias("kind"))


def dense_numbers(products: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Groups numbered in order of their keys (``DUP-0001``): numbers are given to keys, not to rows."""
    size = products.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    numbered = dense_ids(size, [key], "number")
    return products.join(numbered, key).select(code, key, "members", F.format_string("DUP-%04d", "number").alias("group_number"))
