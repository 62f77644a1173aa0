"""Row validators, set-level checks, quarantine and the import report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from acervo.functions import text as T

ISSUE = "struct<severity:string,field:string,code:string>"


def _issue(when: Column, severity: str, field: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(code).alias("code")))


def issues_of(columns: Sequence[str], *, required: Sequence[str] = (), identity: Sequence[str] = (), placeholders: Sequence[str] = (), enums: Mapping[str, Sequence[str]] | None = None, flags: Mapping[str, Sequence[str]] | None = None, numbers: Sequence[str] = (), zero_code: str | None = None) -> Column:
    """All issues of a raw (all-text) row, in rule order, as one array column."""
    found = [_issue(T.clean(F.col(c)) == "", "error", c, "required_value") for c in required]
    if zero_code:
        found.append(_issue(T.clean(F.col(zero_code)) == "0", "warning", zero_code, "zero_code"))
    for c in identity:
        found.append(_issue(T.clean(F.col(c)) == "", "warning", c, "missing_identity"))
        found.append(_issue((T.clean(F.col(c)) != "") & T.search_key(F.col(c)).isin(*placeholders), "warning", c, "possible_placeholder"))
    for code, rules in (("invalid_enum", enums), ("invalid_flag", flags)):
        for c, allowed in (rules or {}).items():
            found.append(_issue(~F.upper(T.clean(F.col(c))).isin(*allowed), "error", c, code))
    for c in numbers:
        if c in columns:
            number = T.decimal_text(F.col(c))
            found.append(_issue(number["error"].isNotNull(), "error", c, "invalid_number"))
            found.append(_issue(number["value"].startswith("-") & (number["value"].try_cast("double") < 0), "warning", c, "negative_value"))
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ISSUE}>")


def key_repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once, with its number; null equals null.

    Only the repeated keys are joined back, so the shuffle of the rows is one
    equi-join that can be split when a key is hot.
    """
    count = rows.groupBy(*keys).agg(F.count("*").alias("repeats")).where("repeats > 1")
    other = count.select(*[F.col(k).alias(f"_{k}") for k in keys], "repeats")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return rows.join(other, same).drop(*[f"_{k}" for k in keys])


def conflicts(rows: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct non-null value of an attribute: ``key, attribute, n_values``.

    Values are made distinct by (key, attribute, value) first, as text, so a key
    with most of the rows is combined before the shuffle.
    """
    long = rows.select(key, *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot([key], list(attributes), "attribute", "value").where("value IS NOT NULL")
    counted = long.distinct().groupBy(key, "attribute").agg(F.count("*").alias("n_values"))
    return counted.where("n_values > 1")


def quarantined(issues: str = "issues", missing_columns: bool = False) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "error") | F.lit(missing_columns)


def report(rows: DataFrame, issues: str = "issues") -> DataFrame:
    """Issue counts by severity, field and code, the most frequent of a severity first."""
    counts = rows.select(F.explode(issues).alias("i")).groupBy("i.severity", "i.field", "i.code").agg(F.count("*").alias("n"))
    return counts.orderBy("severity", F.desc("n"), "field", "code")


def missing_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in columns]


def first_row(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Kept columns of each key's first row in the full order (a combined minimum, no sort)."""
    head = F.min_by(F.struct(*keep), F.struct(*order))
    return rows.groupBy(key).agg(head.alias("_h")).select(key, *[f"_h.{c}" for c in keep])


def first_filled(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per field the first value in order that is not null, an empty text, false or a number that is zero (a text "0" is filled)."""

    def full(c: str) -> Column:
        kind = rows.schema[c].dataType
        empty = F.col(c) == "" if isinstance(kind, StringType) else ~F.col(c) if isinstance(kind, BooleanType) else F.col(c) == 0 if isinstance(kind, NumericType) else F.lit(False)
        return F.when(~empty, F.col(c))

    return rows.groupBy(key).agg(*[F.min_by(full(c), F.when(full(c).isNotNull(), F.struct(*order))).alias(c) for c in fields])


def best_spelling(rows: DataFrame, key: str, spelling: str, order: Sequence[str]) -> DataFrame:
    """Most frequent spelling of a key, the earliest on ties."""
    counted = rows.groupBy(key, spelling).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_first")))
    return ranked.where("_r = 1").select(key, spelling, "n")


def spellings_by_code(rows: DataFrame, code: str, spelling: str, order: Sequence[str]) -> DataFrame:
    """``code, spelling, place``: the spelling in each code's first row and where that row stands; a code counts once, however many rows it has."""
    head = rows.groupBy(code).agg(F.min(F.struct(*order)).alias("place"), F.min_by(spelling, F.struct(*order)).alias("spelling"))
    return head.where(F.coalesce("spelling", F.lit("")) != "")


def brand_names(spelled: DataFrame, key: Column) -> DataFrame:
    """``brand_key, spelling, n``: the spelling that most codes have, the one seen first on ties."""
    return best_spelling(spelled.withColumn("brand_key", key).where("brand_key IS NOT NULL"), "brand_key", "spelling", ["place"])


def file_issues(columns: Sequence[str], required: Sequence[str], rows: int) -> list[tuple[str, str, str]]:
    """Issues of a file as a whole ``(severity, field, code)``: a required column that is not there, no rows."""
    found = [("error", c, "missing_column") for c in missing_columns(columns, required)]
    return found + ([("error", "file", "empty_file")] if not rows else [])


def product_rows(rows: DataFrame, code: str, order: Sequence[str], fields: Sequence[str], ordinal: str, status: str = "status") -> DataFrame:
    """Per code: the first filled value of each field, its first row and number of rows, and whether any is quarantined.

    The rows themselves stay where they are, a code's number of them has no bound
    (:func:`row_list` lists those of a few codes).
    """
    filled = first_filled(rows, code, order, fields)
    counted = rows.groupBy(code).agg(F.min(ordinal).alias("first_row"), F.count("*").alias("n_rows"), F.bool_or(F.col(status) == "quarantined").alias("quarantined"))
    return filled.join(counted, code)


def row_list(rows: DataFrame, code: str, ordinal: str) -> DataFrame:
    """``code, rows``: the ordinals of each code's rows, ascending; for chosen codes, as a code's rows are collected."""
    return rows.groupBy(code).agg(F.array_sort(F.collect_list(ordinal)).alias("rows"))


def newest(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Kept columns of each key's last row in the full order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_h")).select(key, *[f"_h.{c}" for c in keep])


def last_rows(rows: DataFrame, key: str, order: Sequence[str], most: int) -> DataFrame:
    """The last ``most`` rows of each key, newest first, numbered in ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("place") <= most)
