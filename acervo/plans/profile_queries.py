"""Exploratory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import profile
from acervo.plans.frames import OBS_SQL, observations, read

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _column_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS filled, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_percent, count(DISTINCT {c}) AS distinct_values,
        (SELECT CAST({c} AS VARCHAR) FROM p WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS mode_value,
        (SELECT count(*) FROM p WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS mode_count,
        round(100.0 * (SELECT count(*) FROM p WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count(*), 4) AS mode_percent FROM p"""


@query("WITH p AS (SELECT p_name, p_brand, p_type, p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS p_some FROM part) " + " UNION ALL ".join(map(_column_sql, ["p_name", "p_brand", "p_type", "p_size", "p_some"])))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("p_some", F.when(F.col("p_size") % 5 != 0, F.col("p_type")))
    return profile.columns(part, ["p_name", "p_brand", "p_type", "p_size", "p_some"])


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75, 0.95, 0.99]) AS v, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem)
    SELECT n, mean, std, lowest, highest, round(v[1], 6) AS p25, round(v[2], 6) AS p50, round(v[3], 6) AS p75, round(v[4], 6) AS p95, round(v[5], 6) AS p99 FROM q""")
def numeric_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(read(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} > 0) AS positives, count(*) FILTER ({c} IS NULL) AS nulls FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.signs(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"""WITH {OBS_SQL} SELECT CASE WHEN grouping(site_type) = 1 THEN 'All' ELSE site_type END AS site_type, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, CAST(sum(CAST(stock AS DECIMAL(18,2))) AS DOUBLE) AS n FROM obs GROUP BY CUBE (site_type, l_linestatus)""")
def pivot_sum_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.crosstab(observations(spark, sf_dir), "site_type", "l_linestatus", F.col("stock").cast("decimal(18,2)"))
    return rows.withColumn("n", F.col("n").cast("double"))


@query("""SELECT count(*) AS n, count(*) FILTER (abs(l_extendedprice - l_quantity * p_retailprice) <= 1 OR abs(l_extendedprice - l_quantity * p_retailprice) <= 0.001 * abs(l_quantity * p_retailprice)) AS close_enough FROM lineitem JOIN part ON l_partkey = p_partkey""")
def cost_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.agg(F.count("*").alias("n"), F.count_if(T.close(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))).alias("close_enough"))


@query("""SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer WHERE c_acctbal < 0 GROUP BY 1 ORDER BY n DESC, total, c_nationkey LIMIT 15""")
def negatives_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    return rows.orderBy(F.desc("n"), "total", "c_nationkey").limit(15)


@query(f"""WITH {OBS_SQL} SELECT site, string_agg(DISTINCT country, ', ' ORDER BY country) AS countries, count(*) AS n_rows, count(DISTINCT code) AS n_codes, CAST(sum(CAST(stock AS DECIMAL(18,2))) AS DOUBLE) AS stock, count(*) FILTER (stock > 25) AS high, round(100.0 * count(*) FILTER (stock > 25) / count(*), 4) AS high_percent FROM obs GROUP BY site""")
def site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy("site").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("country")), ", "), F.lit("")).alias("countries"), F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.sum(F.col("stock").cast("decimal(18,2)")).cast("double").alias("stock"), F.count_if(F.col("stock") > 25).alias("high"))
    return rows.withColumn("high_percent", F.round(100 * F.col("high") / F.col("n_rows"), 4))


@query("""WITH c AS (SELECT l_partkey, least(count(DISTINCT l_suppkey), 20) AS n_sites FROM lineitem GROUP BY 1) SELECT n_sites, count(*) AS n_codes FROM c GROUP BY 1""")
def sites_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.least(F.count_distinct("l_suppkey"), F.lit(20)).alias("n_sites"))
    return per.groupBy("n_sites").agg(F.count("*").alias("n_codes"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c)
    SELECT p_brand, count(*) AS n_labels, string_agg(p_type || ' (' || n || ')', ', ' ORDER BY r) FILTER (r <= 5) AS top_labels FROM r GROUP BY p_brand""")
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fragmentation(read(spark, sf_dir, "part"), "p_brand", "p_type")


@query("SELECT CAST(floor(round(log10(l_extendedprice), 9) * 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.log_histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("""SELECT count(DISTINCT l_partkey) AS codes, count(DISTINCT l_suppkey) AS sites, count(*) FILTER (l_partkey IS NULL) AS null_codes,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)) AS repeated_rows FROM lineitem""")
def key_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return pairs.agg(F.count_distinct("l_partkey").alias("codes"), F.count_distinct("l_suppkey").alias("sites"), F.coalesce(F.sum(F.when(F.col("l_partkey").isNull(), F.col("n"))), F.lit(0)).alias("null_codes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))


@query("""SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), '(vacío)') AS value, count(*) AS n FROM customer GROUP BY 1""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("(vacío)"))
    return read(spark, sf_dir, "customer").groupBy(value.alias("value")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_name, count(DISTINCT p_brand) AS n_schemes, count(*) AS n_codes, array_to_string(list_slice(list_sort(list(CAST(p_partkey AS VARCHAR))), 1, 4), ', ') AS samples FROM part GROUP BY p_name) SELECT * FROM g WHERE n_codes > 1""")
def multi_code_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.array_join(F.slice(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))), 1, 4), ", ")
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n_schemes"), F.count("*").alias("n_codes"), samples.alias("samples")).where("n_codes > 1")


@query("""WITH t AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 3) SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM t) GROUP BY 1, 2""")
def crosstab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    top = rows.groupBy("c_mktsegment").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "c_mktsegment").limit(3).select("c_mktsegment")
    return rows.join(F.broadcast(top), "c_mktsegment", "left_semi").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT p_brand) AS raw_values, count(DISTINCT regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g')) AS keys, count(DISTINCT p_name) AS names FROM part""")
def distinct_after_normalising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.count_distinct("p_brand").alias("raw_values"), F.count_distinct(T.compact_key(F.col("p_brand"))).alias("keys"), F.count_distinct("p_name").alias("names"))
