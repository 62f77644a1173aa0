"""Queries on stock, presence, duplicates and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators import checks, duplicates, inventory
from acervo.plans.frames import AVAILABLE, AVAILABLE_SQL, OBS_SQL, ORDER, ORDER_SQL, PRODUCTS_SQL, SITES_SQL, observations, products, read, site_table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


FREE = f"site_type IN ({AVAILABLE_SQL}) AND stock > 0"
MONEY = "sum(stock)"
BY_COUNTRY = f"by_country AS (SELECT code, coalesce(country, 'Sin país') AS country, {MONEY} AS quantity FROM obs WHERE {FREE} GROUP BY 1, 2)"


@query(f"WITH {OBS_SQL}, {BY_COUNTRY} SELECT code, country, quantity FROM by_country")
def stock_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stock_by_country(observations(spark, sf_dir), AVAILABLE)


@query(f"""WITH {OBS_SQL}, {BY_COUNTRY} SELECT code, string_agg(country || ': ' || format('{{:g}}', quantity), ' · ' ORDER BY country) AS stock_text FROM by_country GROUP BY code""")
def stock_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stock_map(observations(spark, sf_dir), AVAILABLE).select("code", "stock_text")


_PARTS = "CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2))"


@query(f"""WITH {SITES_SQL}, seen AS (SELECT l_partkey AS code, l_suppkey AS site, {_PARTS} AS amount FROM lineitem)
    SELECT code, coalesce(country, 'Sin país') AS country, CAST(sum(amount) AS DOUBLE) AS quantity FROM seen JOIN sites USING (site) WHERE site_type IN ({AVAILABLE_SQL}) AND amount > 0 GROUP BY 1, 2""")
def fractional_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks with six decimals keep all of them; the SQL multiplies and adds decimals, not doubles."""
    amount = F.col("l_quantity") * F.col("l_discount") * F.col("l_tax")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("site"), amount.alias("stock"))
    return inventory.stock_by_country(rows.join(site_table(spark, sf_dir), "site"), AVAILABLE)


@query(f"""WITH {OBS_SQL} SELECT code, coalesce(string_agg(DISTINCT country, ', ' ORDER BY country), '') AS countries, count(DISTINCT country) AS n_countries FROM obs GROUP BY code""")
def presence_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory.presence(observations(spark, sf_dir))
    return found.select("code", F.array_join("countries", ", ").alias("countries"), F.size("countries").cast("long").alias("n_countries"))


@query(f"WITH {OBS_SQL} SELECT code, count(DISTINCT CASE WHEN {FREE} THEN site END) AS sites_with_stock FROM obs GROUP BY code")
def stocked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stocked_sites(observations(spark, sf_dir), AVAILABLE)


@query(f"WITH {OBS_SQL}, {BY_COUNTRY} SELECT country, count(*) AS products, CASE WHEN country = 'Sin país' THEN 1 ELSE 0 END AS last FROM by_country GROUP BY country")
def country_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.country_counts(observations(spark, sf_dir), AVAILABLE)


@query(f"""WITH {OBS_SQL} SELECT coalesce(country, 'Sin país') AS country,
    coalesce(sum(stock) FILTER ({FREE}), 0) AS available,
    coalesce(sum(stock) FILTER (site_type NOT IN ({AVAILABLE_SQL}) AND stock > 0), 0) AS unavailable FROM obs GROUP BY 1""")
def stock_detail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stock_summary(observations(spark, sf_dir), AVAILABLE)


@query(f"""WITH {OBS_SQL}, {PRODUCTS_SQL} SELECT o.code, name, coalesce(country, 'Sin país') AS country, site_type, {MONEY} AS stock FROM obs o JOIN products p ON o.code = p.code GROUP BY 1, 2, 3, 4""")
def view_stock_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stock_by_kind(observations(spark, sf_dir).join(products(spark, sf_dir).select("code", "name"), "code"))


@query(f"""WITH {OBS_SQL}, t AS (SELECT sum(greatest(stock, 0)) FILTER (site_type NOT IN ({AVAILABLE_SQL})) AS unavailable, sum(greatest(stock, 0)) AS total FROM obs) SELECT unavailable, total, round(unavailable / total, 6) AS share FROM t""")
def unavailable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.unavailable_share(observations(spark, sf_dir), AVAILABLE)


@query(f"""WITH {PRODUCTS_SQL}, g AS (SELECT key, count(*) AS members FROM products GROUP BY key HAVING count(*) > 1)
    SELECT code, key, 'DUP-' || upper(substr(sha1(key), 1, 6)) AS group_id, members FROM products JOIN g USING (key)""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.groups(products(spark, sf_dir), "key")


@query(f"""WITH {OBS_SQL}, {PRODUCTS_SQL}, pairs AS (SELECT DISTINCT p.key, p.code, o.country FROM products p LEFT JOIN obs o ON o.code = p.code),
    size AS (SELECT key, count(*) AS members FROM products GROUP BY key HAVING count(*) > 1),
    none AS (SELECT key, bool_or(n = 0) AS unknown FROM (SELECT key, code, count(country) AS n FROM pairs GROUP BY key, code) GROUP BY key),
    shared AS (SELECT key, max(n) > 1 AS shared FROM (SELECT key, country, count(*) AS n FROM pairs WHERE country IS NOT NULL GROUP BY key, country) GROUP BY key)
    SELECT size.key, members, CASE WHEN unknown OR coalesce(shared, false) THEN 'Mismo país' ELSE 'Otro país' END AS kind
    FROM size JOIN none USING (key) LEFT JOIN shared USING (key)""")
def dup_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inventory.presence(observations(spark, sf_dir))
    with_countries = products(spark, sf_dir).select("code", "key").join(own, "code", "left").withColumn("countries", F.coalesce("countries", F.array().cast("array<string>")))
    return duplicates.kinds(with_countries, "key")


@query(f"""WITH {PRODUCTS_SQL}, g AS (SELECT key, count(*) AS members, 'DUP-' || lpad(CAST(row_number() OVER (ORDER BY key) AS VARCHAR), 4, '0') AS group_number FROM products GROUP BY key HAVING count(*) > 1)
    SELECT code, key, members, group_number FROM products JOIN g USING (key)""")
def dup_dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.dense_numbers(products(spark, sf_dir), "key")


@query(f"WITH {OBS_SQL} SELECT code, site, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY code, site) AS repeats FROM obs QUALIFY repeats > 1")
def key_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.key_repeats(observations(spark, sf_dir).select("code", "site", "l_orderkey", "l_linenumber"), "code", "site")


@query(f"""WITH {OBS_SQL}, c AS (SELECT code, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus, count(DISTINCT country) AS country FROM obs GROUP BY code)
    SELECT code, attribute, n_values FROM (UNPIVOT c ON l_returnflag, l_linestatus, country INTO NAME attribute VALUE n_values) WHERE n_values > 1""")
def identity_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.conflicts(observations(spark, sf_dir), "code", ["l_returnflag", "l_linestatus", "country"])


@query(f"WITH {OBS_SQL} SELECT code, site, stock, cost FROM obs QUALIFY row_number() OVER (PARTITION BY code ORDER BY {ORDER_SQL}) = 1")
def first_row_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.first_row(observations(spark, sf_dir), "code", ORDER, ["site", "stock", "cost"])


@query(f"""WITH {OBS_SQL}, n AS (SELECT *, nullif(country, 'NATION_3') AS own_country, nullif(stock % 5, 0) AS odd_stock FROM obs)
    SELECT code, arg_min(own_country, ROW({ORDER_SQL})) FILTER (own_country IS NOT NULL) AS own_country, arg_min(odd_stock, ROW({ORDER_SQL})) FILTER (odd_stock IS NOT NULL) AS odd_stock FROM n GROUP BY code""")
def first_nonnull_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumns({"own_country": F.nullif(F.col("country"), F.lit("NATION_3")), "odd_stock": F.col("stock") % 5})
    return checks.first_filled(rows, "code", ORDER, ["own_country", "odd_stock"])


SPELLED = """spelled AS (SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS brand_key,
    CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE p_brand END AS spelling FROM part)"""


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acervo.functions.text import compact_key

    third = F.col("p_partkey") % 3
    spelling = F.when(third == 0, F.upper("p_brand")).when(third == 1, F.lower("p_brand")).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", compact_key(F.col("p_brand")).alias("brand_key"), spelling.alias("spelling"))


@query(f"""WITH {SPELLED}, c AS (SELECT brand_key, spelling, count(*) AS n, min(p_partkey) AS f FROM spelled GROUP BY 1, 2)
    SELECT brand_key, spelling, n FROM c QUALIFY row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, f) = 1""")
def best_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.best_spelling(_spelled(spark, sf_dir), "brand_key", "spelling", ["p_partkey"])


@query(f"""WITH {SPELLED} SELECT brand_key, count(DISTINCT spelling) AS n_variants, string_agg(DISTINCT spelling, ', ' ORDER BY spelling) AS variants FROM spelled GROUP BY brand_key HAVING count(DISTINCT spelling) > 1""")
def brand_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir).groupBy("brand_key").agg(F.array_sort(F.collect_set("spelling")).alias("v")).where(F.size("v") > 1).select("brand_key", F.size("v").cast("long").alias("n_variants"), F.array_join("v", ", ").alias("variants"))
