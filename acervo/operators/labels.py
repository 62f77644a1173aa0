"""Dictionary encoding of label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.numbering import dense_ids


def unpivot_labels(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys, field, value`` of every filled label."""
    return rows.unpivot(list(keys), list(fields), "field", "value").where("value IS NOT NULL AND value <> ''")


def encode(long: DataFrame, known: DataFrame | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(dictionary, links)``: ids of known (field, value) pairs stay, new pairs continue after ``top`` (the highest known) in order."""
    pairs = long.select("field", "value").distinct()
    if known is None:
        dictionary = dense_ids(pairs, ["field", "value"], "value_id")
    else:
        top = known.agg(F.coalesce(F.max("value_id"), F.lit(0))).first()[0] if top is None else top
        new = pairs.join(known.select("field", "value"), ["field", "value"], "left_anti")
        numbered = dense_ids(new, ["field", "value"], "value_id", top)
        dictionary = known.select("field", "value", "value_id").unionByName(numbered)
    return dictionary, long.join(dictionary, ["field", "value"])
