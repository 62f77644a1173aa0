"""Which load is current, what a publication would change, and the catalogue views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_inventory(facts: DataFrame, source: str, load: str, mapping: DataFrame) -> DataFrame:
    """Facts of each source's newest load with their master, if mapped."""
    active = facts.groupBy(source).agg(F.max(load).alias(load))
    return facts.join(active, [source, load]).join(mapping, "code", "left")


def current_catalog(masters: DataFrame, current: DataFrame, master: str = "master") -> DataFrame:
    """Masters that are manual or have a current fact: a semi-join and a filter, no duplicates."""
    stocked = masters.where("origin <> 'manual'").join(current.select(master), master, "left_semi")
    return masters.where("origin = 'manual'").unionByName(stocked)


#: Codes that may be left out of a publication by an explicit decision.
TECHNICAL = ("DEFAULTITEM", "DEFAULTLABOR", "DEFAULTMISC", "SYSTEMDEFAULT")


def technical_rows(rows: DataFrame, decisions: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Quarantined rows with ``eligible`` (one of the technical codes) and their ``decision`` (``pending`` where none)."""
    waiting = rows.where("status = 'quarantined'")
    known = decisions.select(*keys, "decision")
    return waiting.join(known, list(keys), "left").withColumns({"eligible": F.coalesce(F.col(code).isin(*TECHNICAL), F.lit(False)), "decision": F.coalesce("decision", F.lit("pending"))})


def flag_number(c: Column, known: Mapping[str, int]) -> Column:
    """A flag's number: null for null, and for a value that is not known."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for value, number in known.items():
        out = out.when(c == value, F.lit(number))
    return out


def unknown_flags(rows: DataFrame, flags: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``field, value, n`` of flags outside their known values: any of them stops a publication."""
    long = rows.select(*[F.col(f) for f in flags]).unpivot([], list(flags), "field", "value").where("value IS NOT NULL")
    wrong = F.lit(False)
    for field, known in flags.items():
        wrong = wrong | ((F.col("field") == field) & ~F.col("value").isin(*known))
    return long.where(wrong).groupBy("field", "value").agg(F.count("*").alias("n"))


def snapshots(rows: DataFrame, masters: DataFrame, numbers: Sequence[str], flags: Mapping[str, Mapping[str, int]], keep: Sequence[str], code: str = "code") -> DataFrame:
    """One inventory fact for each accepted row: ``keep``, the master of its code, numbers as doubles and flags as 0/1."""
    facts = rows.where("status = 'accepted'").join(masters.select(code, "master_id"), code)
    return facts.select(*keep, code, "master_id", *[F.col(c).try_cast("double").alias(c) for c in numbers], *[flag_number(F.col(f), known).alias(f) for f, known in flags.items()])


def code_changes(incoming: DataFrame, published: DataFrame, code: str = "code") -> DataFrame:
    """How many codes of the published load are absent from the incoming one, and how many it brings, as one row."""
    now, old = incoming.select(code).distinct(), published.select(code).distinct()
    absent, new = old.join(now, code, "left_anti").agg(F.count("*").alias("absent_codes")), now.join(old, code, "left_anti").agg(F.count("*").alias("new_codes"))
    return absent.withColumn("_one", F.lit(1)).join(new.withColumn("_one", F.lit(1)), "_one").drop("_one")


def preview(incoming: DataFrame, published: DataFrame, technical: DataFrame, masters: DataFrame, global_errors: int = 0, pending: DataFrame | None = None, code: str = "code") -> DataFrame:
    """The seven counters that decide whether a load may be published, as one row.

    ``incoming`` has ``accepted`` by row, ``technical`` is :func:`technical_rows` of
    the same load; codes are compared as sets, masters by code.
    """
    now = incoming.where("accepted").select(code).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    excluded = technical.agg(F.count_if(F.col("eligible") & (F.col("decision") == "exclude")).alias("excluded"), F.count("*").alias("held"))
    parts = [
        incoming.agg(F.count_if("accepted").alias("accepted")),
        excluded.select("excluded", (F.col("held") - F.col("excluded")).alias("unresolved")),
        count(incoming.where("accepted").join(masters.select(code).distinct(), code, "left_anti"), "missing_masters"),
        count(published.select(code).distinct().join(now, code, "left_anti"), "absent_codes"),
        count(pending, "pending_families") if pending is not None else None,
    ]
    one = None
    for part in parts:
        if part is not None:
            part = part.withColumn("_one", F.lit(1))
            one = part if one is None else one.join(part, "_one")
    return one.drop("_one").withColumn("global_errors", F.lit(global_errors).cast("long"))


def load_states(loads: DataFrame, publications: DataFrame, source: str = "source", load: str = "load_id") -> DataFrame:
    """``loads`` with what was published of their source: ``active``, ``stale``, ``already_published``.

    A load is stale when the source's newest *published* load is newer, whatever has
    been staged since; ``active`` is null where nothing is published.
    """
    newest = publications.groupBy(source).agg(F.max(load).alias("active"))
    known, active = F.col("active").isNotNull(), F.col("active")
    return loads.join(newest, source, "left").withColumns({"stale": known & (F.col(load) < active), "already_published": known & (F.col(load) == active)})


def manual_overlaps(entries: DataFrame, current: DataFrame, product: str = "master_id", site: str = "site") -> DataFrame:
    """Stocks that people entered by hand for a product at a site that the current inventory has too: both amounts side by side."""
    seen = current.select(product, site, F.col("stock"))
    return entries.join(seen, [product, site])


def load_inventory(rows: DataFrame, masters: DataFrame, sites: DataFrame, columns: Sequence[str], code: str = "code", site: str = "site") -> DataFrame:
    """A load's accepted rows whose code has a product and whose site is known: ``master_id``, code, site and ``columns``."""
    kept = rows.where("status = 'accepted'").join(masters.select(code, "master_id"), code)
    return kept.join(sites.select(site).distinct(), site, "left_semi").select("master_id", code, site, *columns)


def catalogue_view(products: DataFrame, links: DataFrame) -> DataFrame:
    """Every product with the sorted source codes that map to it: a null list and ``n`` 0 where none does."""
    own = links.groupBy("master").agg(F.array_join(F.array_sort(F.collect_list("source_code")), ", ").alias("source_codes"), F.count("*").alias("n"))
    return products.join(own, products["code"] == own["master"], "left").drop("master").withColumn("n", F.coalesce("n", F.lit(0)))


def publishable(snapshot_at: Column, last: Column) -> Column:
    """A cut-off needs a time zone and must lie after the last one."""
    zoned = snapshot_at.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    when = F.try_to_timestamp(snapshot_at)
    return F.coalesce(zoned & when.isNotNull() & (last.isNull() | (when > F.try_to_timestamp(last))), F.lit(False))
