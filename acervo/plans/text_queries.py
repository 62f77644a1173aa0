"""Queries on text, number, code and date rules over awkward values made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators.publication import publishable
from acervo.plans.frames import read
from acervo.rulepack import demo

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def choose(key: str, n: int, *values: Column) -> Column:
    """``values[key % n]``; the last one for the rest."""
    out = F.when(F.col(key) % n == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(F.col(key) % n == i, v)
    return out.otherwise(values[-1])


NUMBERS = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN replace(printf('%.2f', o_totalprice), '.', ',')
    WHEN 2 THEN (CAST(floor(o_totalprice) AS BIGINT) // 1000) || '.' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ',50' WHEN 3 THEN '-' || CAST(o_orderkey AS VARCHAR)
    WHEN 4 THEN 'n/a' WHEN 5 THEN '' WHEN 6 THEN printf('%.1e', o_totalprice) END AS raw FROM orders)"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, whole = F.col("o_totalprice"), F.floor("o_totalprice").cast("long")
    two = T.fixed_number(price, 2)
    grouped = F.concat((whole / 1000).cast("long").cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(",50"))
    raw = choose("o_orderkey", 8, two, F.replace(two, F.lit("."), F.lit(",")), grouped, F.concat(F.lit("-"), F.col("o_orderkey").cast("string")), F.lit("n/a"), F.lit(""), T.exponent_number(price, 1), F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@query(f"""WITH {NUMBERS}, k AS (SELECT id, raw, regexp_full_match(raw, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})*(,[0-9]+)?') OR regexp_full_match(raw, '-?[0-9]+(,[0-9]+)?') AS grouped, regexp_full_match(raw, '-?[0-9]+\\.[0-9]+') AS pointed FROM t)
    SELECT id, CASE WHEN grouped THEN TRY_CAST(replace(replace(raw, '.', ''), ',', '.') AS DOUBLE) WHEN pointed THEN TRY_CAST(raw AS DOUBLE) END AS value, raw IS NOT NULL AND NOT (grouped OR pointed) AS error FROM k""")
def loose_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("id", T.loose_number(F.col("raw")).alias("n")).select("id", "n.value", "n.error")


@query(f"WITH {NUMBERS} SELECT id, TRY_CAST(raw AS DOUBLE) AS or_null, coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS or_zero FROM t")
def number_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("id", T.number_or_null(F.col("raw")).alias("or_null"), T.number_or_zero(F.col("raw")).alias("or_zero"))


_VALUES = ("l_quantity", "l_extendedprice / 7", "l_extendedprice * 1000 / 3", "l_discount / 30000", "l_extendedprice * -0.01", "l_tax * 0")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"printf('%g', {v}) AS g{i}" for i, v in enumerate(_VALUES)) + " FROM lineitem")
def general_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[T.general_number(F.expr(v)).alias(f"g{i}") for i, v in enumerate(_VALUES)])


# ---------------------------------------------------------------- names
NAMES = """n AS (SELECT p_partkey AS code, p_brand AS brand, CASE p_size % 8 WHEN 0 THEN upper(p_name) || ' 12 PCS USB' WHEN 1 THEN lower(p_name) || '  w/ led 5 inches' WHEN 2 THEN p_name || ' cafe' WHEN 3 THEN 'SENAL ' || upper(p_name) || ' HD'
    WHEN 4 THEN '.' WHEN 5 THEN NULL WHEN 6 THEN p_name || ' ' || p_brand ELSE p_name END AS raw, CASE p_size % 3 WHEN 0 THEN 'MX - ' || p_size WHEN 1 THEN ' n/a ' ELSE p_name END AS model FROM part)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    raw = choose("p_size", 8, F.concat(F.upper(name), F.lit(" 12 PCS USB")), F.concat(F.lower(name), F.lit("  w/ led 5 inches")), F.concat(name, F.lit(" cafe")), F.concat(F.lit("SENAL "), F.upper(name), F.lit(" HD")), F.lit("."), F.lit(None).cast("string"), F.concat_ws(" ", name, "p_brand"), name)
    model = choose("p_size", 3, F.concat(F.lit("MX - "), F.col("p_size").cast("string")), F.lit(" n/a "), name)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"), raw.alias("raw"), model.alias("model"))


def _replaced_sql(c: str) -> str:
    for pattern, to in demo.replacements:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'gi')"
    return c


_KEY = "regexp_replace(upper({}), '[^A-Z0-9]+', '', 'g')"
_SPACED = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"
_ACRONYM = "list_contains([" + ", ".join(f"'{a}'" for a in demo.acronyms) + "], " + _SPACED.format("w") + ")"
BASES = f"""{NAMES}, r AS (SELECT *, trim({_replaced_sql("raw")}) AS t FROM n),
    u AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS uppers FROM r),
    s AS (SELECT *, CASE WHEN letters > 0 AND uppers >= 0.7 * letters THEN array_to_string([CASE WHEN {_ACRONYM} OR regexp_matches(w, '[0-9]') THEN w ELSE lower(w) END for w in string_split(t, ' ')], ' ') ELSE t END AS cased FROM u),
    c AS (SELECT *, upper(substr(cased, 1, 1)) || substr(cased, 2) AS up FROM s),
    f AS (SELECT *, trim(array_to_string([CASE WHEN {_ACRONYM} THEN upper(w) WHEN lower(w) = 'cafe' THEN CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'Café' ELSE 'café' END WHEN lower(w) = 'senal' THEN CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'Señal' ELSE 'señal' END ELSE w END for w in string_split(up, ' ')], ' ')) AS fixed FROM c),
    b AS (SELECT code, raw, brand, model, CASE WHEN raw IS NOT NULL AND length({_KEY.format("raw")}) >= 3 THEN nullif(upper(substr(fixed, 1, 1)) || substr(fixed, 2), '') END AS base FROM f)"""


@query(f"WITH {BASES} SELECT code, base FROM b")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("code", T.normal_name(F.col("raw"), demo).alias("base"))


@query(f"""WITH {BASES}, k AS (SELECT *, regexp_replace(strip_accents(upper(base)), '[^A-Z0-9]+', '', 'g') AS nk, {_KEY.format("brand")} AS bk, {_KEY.format("model")} AS mk FROM b),
    a AS (SELECT *, bk <> '' AND position(bk IN nk) = 0 AS add_brand FROM k), m AS (SELECT *, mk <> '' AND position(mk IN (CASE WHEN add_brand THEN nk || bk ELSE nk END)) = 0 AS add_model FROM a)
    SELECT code, base || CASE WHEN add_brand THEN ' ' || brand ELSE '' END || CASE WHEN add_model THEN ' ' || model ELSE '' END AS name FROM m""")
def standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).withColumn("base", T.normal_name(F.col("raw"), demo))
    return rows.select("code", T.standard_name(F.col("base"), F.col("brand"), F.col("model")).alias("name"))


@query(f"""WITH {BASES} SELECT code, CASE WHEN base IS NULL THEN 'Revisar: descripción inválida' WHEN regexp_matches(lower(raw), 'usb$') THEN 'Revisar: marcado no usar / eliminar' ELSE 'Activo' END AS status FROM b""")
def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).withColumn("base", T.normal_name(F.col("raw"), demo))
    return rows.select("code", T.operational_status(F.col("raw"), F.col("base"), "usb$").alias("status"))


_PLACE = ", ".join(f"'{p}'" for p in demo.placeholders)
BRANDS = "b AS (SELECT p_partkey AS code, CASE p_size % 6 WHEN 0 THEN lower(p_brand) WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN ' brand-1 ' ELSE p_brand END AS raw FROM part)"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = choose("p_size", 6, F.lower("p_brand"), F.lit("N/A"), F.lit(""), F.lit(None).cast("string"), F.lit(" brand-1 "), F.col("p_brand"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), raw.alias("raw"))


@query(f"WITH {BRANDS}, k AS (SELECT code, coalesce({_KEY.format('raw')}, '') AS k FROM b) SELECT code, CASE WHEN k = '' OR k IN ({_PLACE}) THEN NULL WHEN k = 'BRAND1' THEN 'BRAND01' WHEN k = 'BRAND2' THEN 'BRAND02' ELSE k END AS key FROM k")
def brand_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir).select("code", T.brand_key(F.col("raw"), demo.placeholders, demo.brand_aliases).alias("key"))


@query(f"""WITH {BRANDS}, k AS (SELECT code, coalesce(trim(regexp_replace(upper(raw), '\\s+', ' ', 'g')), '') AS k FROM b) SELECT code, CASE WHEN k IN ({_PLACE}) THEN '' ELSE k END AS key FROM k""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir).select("code", T.identity(F.col("raw"), demo.placeholders).alias("key"))


@query(f"""WITH {NAMES}, m AS (SELECT code, trim(regexp_replace(regexp_replace(upper(model), '\\s*[-–]\\s*', '-', 'g'), '\\s+', ' ', 'g')) AS m FROM n), k AS (SELECT *, {_KEY.format("m")} AS k FROM m)
    SELECT code, CASE WHEN k <> '' AND k NOT IN ({_PLACE}) THEN m END AS model FROM k""")
def model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("code", T.standard_model(F.col("model"), demo.placeholders).alias("model"))


CODES = """c AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'CO-' || o_custkey WHEN 1 THEN 'PE ' || o_custkey WHEN 2 THEN o_custkey || 'CL' WHEN 3 THEN 'X_' || 'PE' WHEN 4 THEN 'COX' || o_custkey
    WHEN 5 THEN 'CO_' || o_custkey || 'PE' WHEN 6 THEN 'XCL' END AS code FROM orders)"""


@query(f"WITH {CODES} SELECT id, coalesce(nullif(regexp_extract(code, '^(CO|PE|CL)[\\s_\\-]', 1), ''), nullif(regexp_extract(code, '[_0-9](CO|PE|CL)$', 1), '')) AS country FROM c")
def code_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_custkey").cast("string")
    code = choose("o_orderkey", 8, F.concat(F.lit("CO-"), t), F.concat(F.lit("PE "), t), F.concat(t, F.lit("CL")), F.lit("X_PE"), F.concat(F.lit("COX"), t), F.concat(F.lit("CO_"), t, F.lit("PE")), F.lit("XCL"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.code_country(code, ["CO", "PE", "CL"]).alias("country"))


_MARKS = T.re.escape(T.COMMON_MARKS).replace("'", "''")


@query(f"SELECT doc_id, regexp_matches(text, '[^\\p{{L}}\\p{{N}}\\p{{Z}}\\t\\n\\x0b\\f\\r\\x85{_MARKS}]') AS uncommon, regexp_matches(text, '[òàèìù]') AS grave, length(text) AS n FROM documents")
def description_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.uncommon_characters(text).alias("uncommon"), T.grave_accents(text).alias("grave"), F.length(text).cast("long").alias("n"))


@query("SELECT count(*) AS n, count(text) AS filled, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, count(*) FILTER (coalesce(length(trim(text)), 0) = 0) AS empty FROM documents")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return read(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count("text").alias("filled"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("empty")
    )


@query("""WITH l AS (SELECT p_partkey AS code, p_brand || ' ,, ' || p_type || ', ' || p_size || ' ,' AS text FROM part) SELECT code, array_to_string([trim(x) for x in string_split(text, ',') if trim(x) <> ''], '|') AS parts FROM l""")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_brand"), F.lit(" ,, "), F.col("p_type"), F.lit(", "), F.col("p_size").cast("string"), F.lit(" ,"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.array_join(T.split_list(text), "|").alias("parts"))


@query("""SELECT s_suppkey AS id, trim(regexp_replace(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN s_name END, ''), '\\s+', ' ', 'g')) AS actor,
    trim(regexp_replace(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN s_name END, ''), '\\s+', ' ', 'g')) <> '' AS signed FROM supplier""")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    actor = T.clean(choose("s_suppkey", 3, F.lit("  "), F.col("s_name"), F.lit(None).cast("string")))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), actor.alias("actor"), (actor != "").alias("signed"))


# ---------------------------------------------------------------- digests, JSON, dates, shares
@query("""SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ',"o_orderstatus":"' || o_orderstatus || '"}') AS revision FROM orders""")
def row_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return rows.select("o_orderkey", T.row_digest("o_orderstatus", "o_orderkey", "o_orderpriority").alias("revision"))


@query("""SELECT event_id, json_valid(t) AS valid, CASE WHEN json_valid(t) THEN array_to_string(list_sort(json_keys(t)), ',') END AS keys, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.a') END AS a
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"z": 1, "a": "x", "k": 2}' WHEN 2 THEN '{broken' END AS t FROM events)""")
def json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = choose("event_id", 4, F.col("props"), F.lit('{"z": 1, "a": "x", "k": 2}'), F.lit("{broken"), F.lit(None).cast("string"))
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", T.json_valid(F.col("t")).alias("valid"), F.array_join(F.array_sort(F.map_keys(T.json_map(F.col("t")))), ",").alias("keys"), F.get_json_object(F.when(T.json_valid(F.col("t")), F.col("t")), "$.a").alias("a"))


@query("""WITH m AS (SELECT l_partkey AS code, l_shipmode AS k, count(*) AS n FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2)
    SELECT code, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS flags FROM m GROUP BY code""")
def sorted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("code"), F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n"))
    made = counts.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return made.select("code", F.to_json(T.sorted_map(F.col("m"))).alias("flags"))


_LAST = "1998-06-01T02:00:00+02:00"


@query(f"""WITH d AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' WHEN 3 THEN '-05:00' ELSE ' noon' END AS cutoff FROM orders)
    SELECT id, cutoff, CASE WHEN id % 5 IN (2, 4) THEN false WHEN id % 7 = 0 THEN true ELSE TRY_CAST(cutoff AS TIMESTAMPTZ) > CAST('{_LAST}' AS TIMESTAMPTZ) END AS fits FROM d""")
def cutoff_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), choose("o_orderkey", 5, F.lit("Z"), F.lit("+02:00"), F.lit(""), F.lit("-05:00"), F.lit(" noon")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.alias("cutoff"))
    return rows.select("id", "cutoff", publishable(F.col("cutoff"), F.when(F.col("id") % 7 != 0, F.lit(_LAST))).alias("fits"))


@query("SELECT o_custkey, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS share FROM orders GROUP BY 1")
def status_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("*").alias("whole"))
    return counts.select("o_custkey", F.round(100 * F.col("part") / F.col("whole"), 1).alias("share"))
