"""Stable category codes: an existing code stays, new ones follow the highest ever used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import padded_code
from acervo.operators.numbering import dense_ids
from acervo.session import cut, unused


def high_water(codes: DataFrame, code: str = "code") -> DataFrame:
    """``prefix, highest`` over live and retired codes ``PREFIX-number``."""
    number = F.regexp_extract(code, r"-([0-9]+)$", 1).try_cast("long")
    return codes.select(F.regexp_extract(code, r"^(.*)-[0-9]+$", 1).alias("prefix"), number.alias("n")).where("n IS NOT NULL").groupBy("prefix").agg(F.max("n").alias("highest"))


def assign(items: DataFrame, used: DataFrame, item: str = "item", prefix: str = "prefix", existing: str = "existing_code") -> DataFrame:
    """``items`` plus ``code``: existing, else ``prefix-NNNNN`` in item order after the highest used number.

    Retired codes belong to ``used`` too, so no number is ever given twice.  Items
    are written once; only those without a code are numbered, in ranges of
    (prefix, item), so a family with most of them is many tasks.
    """
    (new,) = unused(items.columns, "number")
    planned = cut(items, "items")
    open_ = planned.where(F.col(existing).isNull() & F.col(prefix).isNotNull())
    numbered = dense_ids(open_, [item], new, within=[prefix]).alias("o")
    high = used.select(F.col("prefix").alias("p"), "highest").alias("h")  # a row for each family
    made = numbered.join(high, F.col(f"o.{prefix}") == F.col("h.p"), "left").select("o.*", F.coalesce("h.highest", F.lit(0)).alias("top"))
    made = made.select(*items.columns, padded_code(F.col(prefix), F.col("top") + F.col(new)).alias("code"))
    kept = planned.where(F.col(existing).isNotNull() | F.col(prefix).isNull()).withColumn("code", F.col(existing))
    return kept.unionByName(made)


def carry_over(old: DataFrame, new: DataFrame, key: str, sticky: list[str], fresh: list[str]) -> DataFrame:
    """Old and new versions of a table by full outer join: ``sticky`` columns keep the old value, ``fresh`` ones take the new."""
    o, n = old.alias("o"), new.alias("n")
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    columns += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in sticky]
    columns += [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fresh]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def add_missing(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``known`` and those rows of ``found`` whose key it does not have, one for each key (the least by its other columns)."""
    others = [c for c in known.columns if c != key]
    fresh = found.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")) if others else fresh.select(key).distinct()
    return known.unionByName(one.select(key, *[F.col("_r")[c].alias(c) for c in others]))
