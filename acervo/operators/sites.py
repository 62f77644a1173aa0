"""Country and kind of a site from its texts and from the prefixes of its codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import first_match, spaced_key

#: Where a site's country comes from.
BY_KEYWORD, BY_PREFIX, NO_EVIDENCE = "palabra clave", "prefijo de códigos", "sin evidencia"
LEAST_SHARE, LEAST_DOMINANCE = 0.30, 0.70


def prefix_evidence(rows: DataFrame, site: str, prefix: str) -> DataFrame:
    """``site, n_rows, prefixed_share, top_prefix, dominance`` from two nested aggregates."""
    counts = rows.groupBy(site, prefix).agg(F.count("*").alias("n"))
    own = F.when(F.col(prefix).isNotNull(), F.col("n"))
    return counts.groupBy(site).agg(
        F.sum("n").alias("n_rows"),
        (F.coalesce(F.sum(own), F.lit(0)) / F.sum("n")).alias("prefixed_share"),
        F.max_by(prefix, F.when(F.col(prefix).isNotNull(), F.struct(F.col("n"), F.translate(F.col(prefix), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA")))).alias("top_prefix"),
        (F.max(own) / F.sum(own)).alias("dominance"),
    )


def country(text: Column, rules: Sequence[tuple[str, str]], share: Column, prefix: Column, dominance: Column, least_share: float = LEAST_SHARE, least_dominance: float = LEAST_DOMINANCE) -> Column:
    """``struct(country, source)``: a keyword first, then a dominant prefix, else none."""
    by_word = F.coalesce(first_match(spaced_key(text), rules), first_match(F.upper(text), rules))
    strong = prefix.isNotNull() & (share >= least_share) & (dominance >= least_dominance)
    value = F.coalesce(by_word, F.when(strong, prefix))
    source = F.when(by_word.isNotNull(), BY_KEYWORD).when(strong, BY_PREFIX).otherwise(NO_EVIDENCE)
    return F.struct(value.alias("country"), source.alias("source"))


def kind(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    return first_match(spaced_key(text), rules, default)


def protect_manual(old: Column, old_source: Column, new: Column) -> Column:
    """A value that a person set is never overwritten by a rule."""
    return F.when(old_source == "manual", old).otherwise(new)


def site_names(rows: DataFrame, site: str, name: str, order: Sequence[str]) -> DataFrame:
    return rows.groupBy(site).agg(F.count("*").alias("n_rows"), F.min_by(name, F.struct(*order)).alias("first_name"))


MANUAL, BY_RULE = "manual", "regla"


def merged(old: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sites under newly derived ones: names follow the load; country and kind each stay where a person set them.

    Both have ``keys, site_name, country, country_source, site_type, type_source``;
    sites that the load does not have stay as they are.
    """
    o, n = old.alias("o"), fresh.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    is_old, is_new = F.col("o.country_source").isNotNull(), F.col("n.country_source").isNotNull()
    pick = lambda value, source: F.when(is_new & ~(is_old & (F.col(f"o.{source}") == MANUAL)), F.col(f"n.{value}")).otherwise(F.col(f"o.{value}")).alias(value)
    name = F.coalesce("n.site_name", "o.site_name").alias("site_name")
    return o.join(n, same, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], name, pick("country", "country_source"), pick("country_source", "country_source"), pick("site_type", "type_source"), pick("type_source", "type_source"))


def set_by_hand(table: DataFrame, me: Column, country: Column | None, kind: Column | None) -> DataFrame:
    """``table`` with what is given of ``country`` and ``kind`` set, and marked as set by a person, where ``me`` holds."""
    changes = {}
    for value, source, given in (("country", "country_source", country), ("site_type", "type_source", kind)):
        if given is not None:
            changes[value] = F.when(me, given).otherwise(F.col(value))
            changes[source] = F.when(me, MANUAL).otherwise(F.col(source))
    return table.withColumns(changes) if changes else table
