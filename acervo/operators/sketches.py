"""Distinct counts and quantiles of columns by load, kept as sketches that merge when they are read.

A load's sketches are made once, of its own rows; figures over any choice of loads
merge theirs, so a question over all loads reads a few kilobytes a load and no
row.  Distinct counts are HyperLogLog (``LOG_K`` 12: standard error 1.6 %),
quantiles KLL (``KLL_K`` 200: a rank is within 1.65 % with 99 % confidence).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K, KLL_K = 12, 200
#: Five standard errors of a distinct count, and the rank error of a quantile, that results are held to.
DISTINCT_ERROR, RANK_ERROR = 5 * 1.04 / 2 ** (LOG_K / 2), 0.0265


def by_load(rows: DataFrame, load: str, distinct: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``load, rows`` and for each column ``<column>_hll`` of its values as text, or ``<column>_kll`` of its numbers."""
    made = [F.count("*").alias("rows")]
    made += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_K)).alias(f"{c}_hll") for c in distinct]
    made += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"{c}_kll") for c in numbers]
    return rows.groupBy(load).agg(*made)


def distinct_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_values`` over all loads in ``sketches``: merged, then estimated."""
    one = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_hll")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_values")


def quantiles(sketches: DataFrame, columns: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """``column, rank, value`` over all loads in ``sketches``."""
    one = sketches.agg(*[F.kll_merge_agg_double(f"{c}_kll").alias(c) for c in columns])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(r))).alias("value")) for c in columns for r in ranks]))
    return one.select(long.alias("q")).select("q.*")
