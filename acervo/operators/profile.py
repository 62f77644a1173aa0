"""Exploratory profiles: column summaries, crosstabs, histograms, fragmentation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from acervo.operators.numbering import ranged


def columns(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a column: filled, null share, distinct values, mode (smallest on ties), its number and share of all rows.

    The table is read once: values are unpivoted as text and counted by
    (column, value) with a combined aggregate.
    """
    long = table.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], list(names), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    filled = F.when(F.col("value").isNotNull(), F.col("n"))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(filled), F.lit(0)).alias("filled"),
        F.round(100 * (F.sum("n") - F.coalesce(F.sum(filled), F.lit(0))) / F.sum("n"), 4).alias("null_percent"),
        F.count("value").alias("distinct_values"),
        best.alias("_m"),
        F.sum("n").alias("_all"),
    ).select("column_name", "filled", "null_percent", "distinct_values", F.col("_m.value").alias("mode_value"), (-F.col("_m.n")).alias("mode_count"), F.round(-100 * F.col("_m.n") / F.col("_all"), 4).alias("mode_percent"))


def percentiles(table: DataFrame, c: str, points: Sequence[float]) -> DataFrame:
    """One row of exact percentiles ``p0, p1, ...``, linear between neighbours.

    Values are counted, dealt by ranges and given their ranks by the counts of
    the ranges before; only the values at the wanted ranks are kept, so no task
    holds all distinct values.
    """
    value, n, part, hi = "value", "n", "part", "hi"
    counts = ranged(table.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias(value)).agg(F.count("*").alias(n)), [value], part)
    size = counts.groupBy(part).agg(F.sum(n).alias("size"))
    before = size.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inner = F.sum(n).over(Window.partitionBy(part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn(hi, inner).join(F.broadcast(before), part).select(value, (F.col(hi) + F.col("before") - F.col(n)).alias("lo"), (F.col(hi) + F.col("before")).alias(hi))
    total = counts.agg(F.sum(n)).first()[0] or 0
    at = [p * max(total - 1, 0) for p in points]
    held = lambda r: F.max(F.when((F.col("lo") <= r) & (F.col(hi) > r), F.col(value)))
    found = placed.agg(*[held(math.floor(x)).alias(f"a{i}") for i, x in enumerate(at)], *[held(math.ceil(x)).alias(f"b{i}") for i, x in enumerate(at)])
    return found.select(*[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (x - math.floor(x))).alias(f"p{i}") for i, x in enumerate(at)])


def describe(table: DataFrame, c: str, points: Sequence[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes and exact linear percentiles."""
    out = table.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("lowest"), F.max(c).alias("highest"))
    both = out.withColumn("_one", F.lit(1)).join(percentiles(table, c, points).withColumn("_one", F.lit(1)), "_one")
    return both.select("n", "mean", "std", "lowest", "highest", *[F.round(f"p{i}", 6).alias(f"p{int(p * 100)}") for i, p in enumerate(points)])


def signs(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Zero, negative, positive and null counts of numeric columns, in one pass."""
    tests = {"zeros": lambda c: F.col(c) == 0, "negatives": lambda c: F.col(c) < 0, "positives": lambda c: F.col(c) > 0, "nulls": lambda c: F.col(c).isNull()}
    wide = table.agg(*[F.count_if(t(c)).alias(f"{c}|{k}") for c in names for k, t in tests.items()])
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}|{k}").alias(k) for k in tests]) for c in names]))
    return wide.select(row.alias("r")).select("r.*")


def crosstab(table: DataFrame, a: str, b: str, value: Column | None = None) -> DataFrame:
    """Counts (or sums) by two columns with margins; a margin's label is ``All``."""
    total = F.count("*") if value is None else F.sum(value)
    cube = table.cube(a, b).agg(total.alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return cube.select(F.when(F.col("_ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def log_histogram(table: DataFrame, c: str, bins: int = 5) -> DataFrame:
    """Positive values in bins of a ``bins``-th of a power of ten."""
    slot = F.floor(F.round(F.log10(c), 9) * bins).cast("long")
    return table.where(F.col(c) > 0).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def coverage(table: DataFrame, method: Column) -> DataFrame:
    """Counts and shares of a method."""
    counts = table.groupBy(method.alias("method")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def fragmentation(table: DataFrame, key: str, label: str, top: int = 5) -> DataFrame:
    """Distinct labels of a key and its most frequent ones as text."""
    counts = table.groupBy(key, label).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label)))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))), lambda x: x["t"]), ", ")
    return ranked.groupBy(key).agg(F.count("*").alias("n_labels"), shown.alias("top_labels"))


def fragmentation_of(table: DataFrame, key: str, labels: Sequence[str], top: int = 5) -> DataFrame:
    """:func:`fragmentation` of several label fields at once: a row for each key and ``field``; nulls are no label."""
    long = table.select(key, *labels).unpivot([key], list(labels), "field", "_label").where("_label IS NOT NULL")
    pair = long.select(F.struct(key, "field").alias("_pair"), "_label")
    return fragmentation(pair, "_pair", "_label", top).select(f"_pair.{key}", "_pair.field", "n_labels", "top_labels")


def code_scheme(c: Column, countries: Sequence[str]) -> Column:
    """Kind of a code: the first pattern that holds."""
    one = "|".join(countries)
    return (
        F.when(c.rlike(r"^[0-9]{5}$"), "five digits")
        .when(c.rlike(r"^0[0-9]+$"), "leading zero")
        .when(c.rlike(r"^[0-9]{6,}$"), "long number")
        .when(c.rlike(r"^[0-9]+\.[0-9]+$"), "number with suffix")
        .when(c.rlike(rf"^({one})[\s_\-]"), "country prefix")
        .when(c.rlike(rf"[_0-9]({one})$"), "country suffix")
        .when(c.rlike(r"^[A-Z]+$"), "letters")
        .otherwise("free")
    )


def stratified_sample(rows: DataFrame, stratum: str, item: str, most: int = 5) -> DataFrame:
    """At most ``most`` items of each stratum, in order of the SHA-256 of the quoted item."""
    digest = F.sha2(F.concat(F.lit('"'), F.col(item).cast("string"), F.lit('"')), 256)
    return rows.withColumn("_h", digest).withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", item))).where(F.col("place") <= most).drop("_h")


def grouping_fields(table: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """For each field: distinct values, share of nulls, and keys that hold more than one of its values.

    ``fields`` names the columns; the field called like ``key`` is not compared with it.
    """
    total = table.agg(F.count("*")).first()[0]
    long = table.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())]).unpivot(["_key"], [f"f{i}" for i in range(len(fields))], "slot", "value").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f"f{i}", f)])
    counted = long.groupBy("slot", "_key", "value").agg(F.count("*").alias("n"))
    values = counted.groupBy("slot", "value").agg(F.sum("n").alias("n")).groupBy("slot").agg(F.count("*").alias("n_values"), F.round(100 * (1 - F.sum("n") / total), 4).alias("null_percent"))
    varying = counted.groupBy("slot", "_key").agg(F.count("*").alias("k")).groupBy("slot").agg(F.count_if(F.col("k") > 1).alias("varying"))
    field = F.element_at(names, F.col("slot"))
    return values.join(varying, "slot").select(field.alias("field"), "n_values", "null_percent", F.when(field == key, F.lit(0)).otherwise(F.col("varying")).cast("long").alias("varying"))


def findings(table: DataFrame, tests: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """A numbered table of findings ``(place, area, finding, n)``, all counted in one pass."""
    wide = table.agg(*[F.count_if(t).alias(f"n{i}") for i, (_, _, t) in enumerate(tests)])
    row = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(a).alias("area"), F.lit(b).alias("finding"), F.col(f"n{i}").alias("n")) for i, (a, b, _) in enumerate(tests)]))
    return wide.select(row.alias("r")).select("r.*")


def seeded_sample(table: DataFrame, item: str, seed: int, rows: int) -> DataFrame:
    """``rows`` rows in order of a hash of seed and item: the same at any partitioning."""
    return table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256), item).limit(rows)
