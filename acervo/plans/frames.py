"""The driver's tables seen as the pipeline's inputs, in Spark and in SQL.

An observation is a line item (code = part, site = supplier, stock = quantity,
cost = extended price, load = year of shipping); a product is a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.rulepack import demo
from acervo.session import cut

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
ORDER_SQL = ", ".join(ORDER)
NO_COUNTRY_NATION = "NATION_7"  # this nation counts as unknown, to exercise null countries


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple, tuple[tuple, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table in the shared folder, written once a session for the tables as they are.

    It is written anew when a file of ``sf_dir`` has come, gone, or has another size or time.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key, stamp = (spark.sparkContext.applicationId, id(spark), sf_dir, name), tuple(sorted(state))
    if key not in _KEPT or _KEPT[key][0] != stamp:
        _KEPT[key] = stamp, cut(build(), name)
    return _KEPT[key][1]


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, country, site_type``; nations are a fixed list of 25, suppliers grow with the data."""
    nation = F.broadcast(read(spark, sf_dir, "nation"))
    kind = F.element_at(F.array(*[F.lit(t) for t in demo.site_types]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    country = F.nullif(F.col("n_name"), F.lit(NO_COUNTRY_NATION))
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("site"), country.alias("country"), kind.alias("site_type"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(*ORDER, F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("stock"), F.col("l_extendedprice").alias("cost"), F.year("l_shipdate").alias("load"), "l_returnflag", "l_linestatus")
    return rows.join(site_table(spark, sf_dir), "site")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("label"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("key"))


_KINDS = ", ".join(f"'{t}'" for t in demo.site_types)
AVAILABLE = demo.available_types
AVAILABLE_SQL = ", ".join(f"'{t}'" for t in AVAILABLE)

SITES_SQL = f"""sites AS (SELECT s_suppkey AS site, nullif(n_name, '{NO_COUNTRY_NATION}') AS country, ([{_KINDS}])[s_suppkey % 7 + 1] AS site_type
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
OBS_SQL = f"""{SITES_SQL}, obs AS (SELECT {ORDER_SQL}, l_partkey AS code, l_suppkey AS site, l_quantity AS stock, l_extendedprice AS cost,
    year(l_shipdate)::INT AS load, l_returnflag, l_linestatus, country, site_type FROM lineitem JOIN sites ON l_suppkey = site)"""
PRODUCTS_SQL = """products AS (SELECT p_partkey AS code, p_name AS name, p_brand AS brand, p_type AS label, p_size AS size,
    p_retailprice AS price, p_name || '|' || p_brand || '|' || p_type AS key FROM part)"""
