"""Queries that run the functions the engine's commands run, on the driver's tables, with their SQL.

A part is a product, a line item an observation of its code at a site (its supplier),
the year of shipping the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import asof, checks, deltas, inventory, links, merkle, publication, rulematch, search, sites, sketches, wordindex
from acervo.plans.catalogue_queries import CATALOGUE, found
from acervo.plans.frames import AVAILABLE, AVAILABLE_SQL, OBS_SQL, ORDER, ORDER_SQL, SITES_SQL, observations, read, site_table
from acervo.rulepack import demo
from acervo.session import cut, fresh_path
from acervo.streaming import pointer

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# ---------------------------------------------------------------- detail and export: the rows of one load
#: Each product was last standardised in the newest load that has it; five in a row share one master.
_OWN = "own AS (SELECT code // 5 AS master_id, max(load) AS load_id FROM obs GROUP BY 1)"


def _products(obs: DataFrame) -> DataFrame:
    master = F.floor(F.col("code") / 5)
    return obs.groupBy(master.alias("master_id")).agg(F.max("load").alias("load_id"), F.collect_set("code").alias("legacy_codes"))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    rows = obs.select("code", "site", "stock", F.col("load").alias("load_id"), "l_orderkey", "l_linenumber")
    return inventory.own_rows(_products(obs), rows, site_table(spark, sf_dir), AVAILABLE)


@query(f"""WITH {OBS_SQL}, {_OWN} SELECT w.master_id, l_orderkey, l_linenumber, code, site, country, site_type, stock, site_type IN ({AVAILABLE_SQL}) AS available
    FROM obs JOIN own w ON w.master_id = code // 5 AND w.load_id = load""")
def engine_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's observations, of its own load only."""
    return _detail(spark, sf_dir).select("master_id", "l_orderkey", "l_linenumber", "code", "site", "country", "site_type", "stock", "available")


@query(f"""WITH {OBS_SQL}, {_OWN}, mine AS (SELECT w.master_id, coalesce(country, 'Sin país') AS country, site_type, stock FROM obs JOIN own w ON w.master_id = code // 5 AND w.load_id = load WHERE stock > 0),
    off AS (SELECT master_id, country, site_type, sum(stock) AS n FROM mine WHERE site_type NOT IN ({AVAILABLE_SQL}) GROUP BY ALL), texts AS (SELECT master_id, country, string_agg(site_type || ': ' || format('{{:g}}', n), ' · ' ORDER BY site_type) AS unavailable FROM off GROUP BY ALL)
    SELECT m.master_id, m.country, coalesce(sum(stock) FILTER (site_type IN ({AVAILABLE_SQL})), 0) AS available, coalesce(any_value(t.unavailable), '') AS unavailable FROM mine m LEFT JOIN texts t ON t.master_id = m.master_id AND t.country = m.country GROUP BY ALL""")
def engine_detail_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inventory.stock_of_products(_detail(spark, sf_dir), "master_id")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("unavailable")), lambda e: F.concat(e["key"], F.lit(": "), T.general_number(e["value"]))), " · ")
    return made.select("master_id", "country", "available", text.alias("unavailable"))


@query(f"""WITH {OBS_SQL}, newest AS (SELECT max(load) AS load FROM obs WHERE load < 2002), known AS (SELECT s_suppkey AS site FROM supplier WHERE s_suppkey % 6 <> 0)
    SELECT code + 7000 AS master_id, code, site, stock, cost, load AS load_id FROM obs JOIN newest USING (load) WHERE l_orderkey % 10 <> 0 AND code % 7 <> 0 AND site IN (SELECT site FROM known)""")
def engine_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart's inventory: accepted rows of the last standardised load, whatever loads came before and after."""
    rows = observations(spark, sf_dir).withColumns({"load_id": F.col("load"), "status": F.when(F.col("l_orderkey") % 10 == 0, "quarantined").otherwise("accepted")})
    standards = rows.where("load_id < 2002").select("load_id")
    newest = standards.agg(F.max("load_id").alias("load_id"))
    masters = read(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") + 7000).alias("master_id"))
    known = read(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("site"))
    return publication.load_inventory(rows.join(F.broadcast(newest), "load_id", "left_semi"), masters, known, ["stock", "cost", "load_id"])


# ---------------------------------------------------------------- search
@query(f"""{CATALOGUE}, holds AS (SELECT DISTINCT code AS master_id FROM obs WHERE load = 2000 AND site_type IN ({AVAILABLE_SQL}) AND stock > 0 AND country = 'NATION_24')
    SELECT master_id FROM cat WHERE ' ' || search_text LIKE '% BRAND%' AND master_id IN (SELECT master_id FROM holds)""")
def engine_search_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with stock in a country; those only seen there are not found."""
    return search.matching(found(spark, sf_dir, "BRAND"), country="NATION_24").select("master_id")


#: Query texts: the first words of products and customers' segments, of one to three tokens, some of which nothing holds.
_ASKED = """asked AS (SELECT p_partkey AS query, trim(regexp_replace(upper(CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN substr(split_part(p_name, ' ', 2), 1, 1 + p_partkey % 7) || ' ' || p_brand ELSE 'none ' || p_type END), '[^A-Z0-9]+', ' ', 'g')) AS q
    FROM part WHERE p_partkey % 20 = 0)"""
_TEXTS = "texts AS (SELECT p_partkey AS id, trim(regexp_replace(upper(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_partkey), '[^A-Z0-9]+', ' ', 'g')) AS t FROM part)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), T.spaced_key(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"))).alias("t"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.split("p_name", " "), F.col("p_partkey")
    text = F.when(k % 3 == 0, name[0]).when(k % 3 == 1, F.concat(F.substring(name[1], F.lit(1), (1 + k % 7).cast("int")), F.lit(" "), F.col("p_brand"))).otherwise(F.concat(F.lit("none "), F.col("p_type")))
    return read(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(k.alias("query"), F.explode(F.split(T.spaced_key(text), " ")).alias("token"))


@query(f"""WITH {_ASKED}, {_TEXTS}, tokens AS (SELECT query, unnest(string_split(q, ' ')) AS token FROM asked) SELECT a.query, x.id FROM asked a, texts x
    WHERE a.q <> '' AND NOT EXISTS (SELECT 1 FROM tokens k WHERE k.query = a.query AND NOT contains(' ' || x.t, ' ' || k.token))""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word for every token of a query, by the index of word prefixes; asked for every product whose id 20 divides."""
    index = wordindex.postings(_texts(spark, sf_dir), "id", "t").withColumns({"live": F.lit(True), "seq": F.lit(1).cast("long")})
    return wordindex.answers(cut(index, "index"), _asked(spark, sf_dir))


@query("""WITH old AS (SELECT p_partkey AS id, p_name AS t FROM part WHERE p_partkey % 5 <> 0), new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' ' || p_name ELSE p_name END AS t FROM part WHERE p_partkey % 7 <> 0),
    words AS (SELECT DISTINCT id, unnest(string_split(trim(regexp_replace(upper(t), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS w FROM new), keys AS (SELECT DISTINCT id, left(w, n) AS key FROM words, (VALUES (1), (2), (3), (4)) v(n) WHERE length(w) >= n) SELECT key, count(*) AS n FROM keys GROUP BY key""")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lengths after texts came, went and changed: the first index with its changes, never built again."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda c: T.spaced_key(c).alias("t")
    old = part.where("p_partkey % 5 <> 0").select(k.alias("id"), text(F.col("p_name")))
    new = part.where("p_partkey % 7 <> 0").select(k.alias("id"), text(F.when(k % 4 == 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name"))))
    first = wordindex.postings(old, "id", "t").withColumns({"live": F.lit(True), "seq": F.lit(1).cast("long")})
    index = first.unionByName(wordindex.changes(old, new, "id", "t", 2))
    return wordindex.current(index).select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- links
@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)),
    runs AS (SELECT *, sum(CASE WHEN n = 1 OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY n) AS run FROM o)
    SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, run) AS root, n - min(n) OVER (PARTITION BY o_custkey, run) AS steps FROM runs QUALIFY steps > 0""")
def link_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order linked to its customer's order before; links of every eleventh were undone.  The SQL finds the runs by windows."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    log = rows.select(F.col("o_orderkey").alias("link_id"), F.col("o_orderkey").alias("source_id"), before.alias("target_id")).where("target_id IS NOT NULL")
    undone = log.where("link_id % 11 = 0").withColumn("undone", F.lit(True))
    return links.roots(links.open_links(log.withColumn("undone", F.lit(False)).unionByName(undone)))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey // 2 AS above, 1 AS steps FROM part WHERE p_partkey > 1 AND p_partkey % 7 <> 0
    UNION ALL SELECT node, above // 2, steps + 1 FROM up WHERE above > 1 AND above % 7 <> 0), last AS (SELECT node, arg_max(above, steps) AS root, max(steps) AS steps FROM up GROUP BY node),
    codes AS (SELECT l.root, string_agg('HW-' || l.node, ', ' ORDER BY 'HW-' || l.node) AS retired_codes FROM last l GROUP BY l.root) SELECT l.node, l.root, l.steps, c.retired_codes FROM last l JOIN codes c ON c.root = l.root""")
def link_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products linked in a deep tree, some links undone: each one's root and all codes retired below that root."""
    k = F.col("p_partkey")
    log = read(spark, sf_dir, "part").where("p_partkey > 1").select(k.alias("link_id"), k.alias("source_id"), F.floor(k / 2).alias("target_id"), F.concat(F.lit("HW-"), k.cast("string")).alias("retired_code"), (k % 7 == 0).alias("undone"))
    live = links.open_links(log)
    forest = links.roots(live)
    codes = links.retired(live, forest).select("root", F.array_join("retired_codes", ", ").alias("retired_codes"))
    return links.with_text(forest, codes, "retired_codes").select("node", "root", "steps", "retired_codes")


# ---------------------------------------------------------------- sites, sources and brands
_STORED = """stored AS (SELECT s_suppkey % 3 AS source, s_suppkey AS site, s_name AS site_name, 'NATION_1' AS country, CASE WHEN s_suppkey % 4 = 0 THEN 'manual' ELSE 'sin evidencia' END AS country_source, 'office' AS site_type, CASE WHEN s_suppkey % 5 = 0 THEN 'manual' ELSE 'regla' END AS type_source FROM supplier WHERE s_suppkey % 6 <> 0)"""


def _stored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 0").select((k % 3).alias("source"), k.alias("site"), F.col("s_name").alias("site_name"), F.lit("NATION_1").alias("country"), F.when(k % 4 == 0, "manual").otherwise("sin evidencia").alias("country_source"), F.lit("office").alias("site_type"), F.when(k % 5 == 0, "manual").otherwise("regla").alias("type_source"))


@query(f"""WITH {_STORED}, fresh AS (SELECT s_suppkey % 3 AS source, s_suppkey AS site, upper(s_name) AS site_name, nullif('NATION_' || s_nationkey, 'NATION_7') AS country, 'palabra clave' AS country_source, 'branch' AS site_type, 'regla' AS type_source FROM supplier WHERE s_suppkey % 3 = 1)
    SELECT coalesce(f.source, s.source) AS source, coalesce(f.site, s.site) AS site, coalesce(f.site_name, s.site_name) AS site_name,
        CASE WHEN f.site IS NULL OR s.country_source = 'manual' THEN s.country ELSE f.country END AS country, CASE WHEN f.site IS NULL OR s.country_source = 'manual' THEN s.country_source ELSE f.country_source END AS country_source,
        CASE WHEN f.site IS NULL OR s.type_source = 'manual' THEN s.site_type ELSE f.site_type END AS site_type, CASE WHEN f.site IS NULL OR s.type_source = 'manual' THEN s.type_source ELSE f.type_source END AS type_source
    FROM stored s FULL OUTER JOIN fresh f ON s.source = f.source AND s.site = f.site""")
def site_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one source derived anew: names follow, what a person set of country or kind stays, each on its own."""
    k = F.col("s_suppkey")
    named = F.nullif(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")), F.lit("NATION_7"))
    fresh = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1").select((k % 3).alias("source"), k.alias("site"), F.upper("s_name").alias("site_name"), named.alias("country"), F.lit("palabra clave").alias("country_source"), F.lit("branch").alias("site_type"), F.lit("regla").alias("type_source"))
    return sites.merged(_stored_sites(spark, sf_dir), fresh, ["source", "site"])


@query(f"""WITH {_STORED} SELECT source, site, country, country_source, CASE WHEN site % 7 = 0 THEN 'repair' ELSE site_type END AS site_type, CASE WHEN site % 7 = 0 THEN 'manual' ELSE type_source END AS type_source FROM stored""")
def site_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind of site set by hand leaves the country, and who set it, alone."""
    made = sites.set_by_hand(_stored_sites(spark, sf_dir), F.col("site") % 7 == 0, None, F.lit("repair"))
    return made.select("source", "site", "country", "country_source", "site_type", "type_source")


@query("""WITH loads AS (SELECT DISTINCT o_orderkey AS load_id, o_custkey AS source FROM orders), pub AS (SELECT source, load_id FROM loads WHERE load_id % 3 = 0)
    SELECT l.load_id, l.source, coalesce(l.load_id <= (SELECT max(load_id) FROM pub p WHERE p.source = l.source) AND l.load_id <> (SELECT max(load_id) FROM pub p WHERE p.source = l.source), false) AS stale,
        coalesce(l.load_id = (SELECT max(load_id) FROM pub p WHERE p.source = l.source), false) AS already_published FROM loads l""")
def stale_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that a later publication of their source has overtaken; loads staged later do not count."""
    loads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("load_id"), F.col("o_custkey").alias("source")).distinct()
    return publication.load_states(loads, loads.where("load_id % 3 = 0")).select("load_id", "source", "stale", "already_published")


@query(f"""WITH rows AS (SELECT {ORDER_SQL}, l_suppkey % 2 AS source, l_partkey % 50 AS code FROM lineitem), masters AS (SELECT source, code, row_number() OVER (ORDER BY source, code) + 100 AS master_id FROM (SELECT DISTINCT source, code FROM rows))
    SELECT m.source, m.code, m.master_id, count(*) AS n FROM rows r JOIN masters m ON r.source = m.source AND r.code = m.code GROUP BY ALL""")
def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters are numbered by (source, code): one code in two sources is two products."""
    from acervo.operators.numbering import dense_ids

    rows = read(spark, sf_dir, "lineitem").select(*ORDER, (F.col("l_suppkey") % 2).alias("source"), (F.col("l_partkey") % 50).alias("code"))
    masters = dense_ids(rows.select("source", "code").distinct(), ["source", "code"], "master_id", 100)
    return rows.join(masters, ["source", "code"]).groupBy("source", "code", "master_id").agg(F.count("*").alias("n"))


_SPELLED = "CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) ELSE replace(p_brand, '#', ' ') END"


@query(f"""WITH rows AS (SELECT {ORDER_SQL}, l_partkey AS code, {_SPELLED} AS spelling FROM lineitem JOIN part ON l_partkey = p_partkey),
    heads AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY code ORDER BY {ORDER_SQL}) = 1), keyed AS (SELECT *, regexp_replace(upper(spelling), '[^A-Z0-9]+', '', 'g') AS k FROM heads WHERE spelling <> ''),
    named AS (SELECT *, CASE k WHEN 'BRAND1' THEN 'BRAND01' WHEN 'BRAND2' THEN 'BRAND02' ELSE k END AS brand_key FROM keyed),
    counted AS (SELECT brand_key, spelling, count(*) AS n, min([l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice]) AS first FROM named GROUP BY 1, 2)
    SELECT brand_key, spelling, n FROM counted QUALIFY row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, first) = 1""")
def brand_by_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling that most codes have; a code counts once, by its first row, however often it is seen."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    line = F.col("l_linenumber") % 3
    spelling = F.when(line == 0, F.col("p_brand")).when(line == 1, F.lower("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    rows = read(spark, sf_dir, "lineitem").select(*ORDER).join(part, "l_partkey").withColumns({"code": F.col("l_partkey"), "spelling": spelling})
    spelled = checks.spellings_by_code(rows, "code", "spelling", ORDER)
    return checks.brand_names(spelled, T.brand_key(F.col("spelling"), demo.placeholders, demo.brand_aliases))


@query(f"""WITH rows AS (SELECT {ORDER_SQL}, l_partkey AS code, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE l_returnflag END AS text, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS DECIMAL(12,2)) END AS amount FROM lineitem)
    SELECT code, (array_agg(text ORDER BY {ORDER_SQL}) FILTER (text <> ''))[1] AS text, CAST((array_agg(amount ORDER BY {ORDER_SQL}) FILTER (amount <> 0))[1] AS DOUBLE) AS amount FROM rows GROUP BY code""")
def first_filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is filled: a text "0" is, an empty text and a decimal 0.00 are not."""
    line = F.col("l_linenumber")
    text = F.when(line % 4 == 0, "").when(line % 4 == 1, "0").when(line % 4 == 3, F.col("l_returnflag"))
    amount = F.when(line % 2 == 0, 0).otherwise(F.col("l_quantity")).cast("decimal(12,2)")
    rows = read(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag").withColumns({"code": F.col("l_partkey"), "text": text, "amount": amount})
    return checks.first_filled(rows, "code", ORDER, ["text", "amount"]).withColumn("amount", F.col("amount").cast("double"))


# ---------------------------------------------------------------- as of
@query(f"""WITH pub AS (SELECT o_custkey % 25 AS source, o_orderdate AS since, max(o_orderkey) AS load_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
    SELECT {ORDER_SQL}, a.l_suppkey % 25 AS source, p.load_id, p.since AS snapshot_at FROM lineitem a ASOF LEFT JOIN pub p ON a.l_suppkey % 25 = p.source AND a.l_shipdate >= p.since""")
def load_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which load was a source's published one at a time: orders are publications, every line item asks for the day it was shipped."""
    publications = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select((F.col("o_custkey") % 25).alias("source"), F.col("o_orderkey").alias("load_id"), F.col("o_orderdate").alias("snapshot_at")).distinct()
    asked = read(spark, sf_dir, "lineitem").select(*ORDER, (F.col("l_suppkey") % 25).alias("source"))
    return asof.latest(asked, publications, "l_shipdate", "snapshot_at", ["source"], ["load_id"], ["load_id", "snapshot_at"])


@query("""WITH pub AS (SELECT DISTINCT o_custkey % 25 AS source, o_orderkey AS load_id, o_orderdate AS snapshot_at FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders)),
    seen AS (SELECT *, max(load_id) OVER (PARTITION BY source ORDER BY snapshot_at, load_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM pub) SELECT source, load_id, snapshot_at, previous FROM seen WHERE previous IS NULL OR load_id > previous""")
def load_pointer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every takeover of a source's current load, by the stateful stream over the orders as publications; those of the last day still wait."""
    folder, path = fresh_path(spark, "pointer"), f"{sf_dir}/orders.parquet"
    orders = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/orders.parque[t]")  # a pattern: a stream takes no single file by its name
    rows = orders.select((F.col("o_custkey") % 25).cast("string").alias("source"), F.col("o_orderkey").alias("load_id"), F.col("o_orderdate").cast("timestamp").alias("snapshot_at"))
    with pointer.rocks(spark):
        pointer.changes(rows, "1 hour").writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kind = spark.read.parquet(path).schema["o_orderdate"].dataType
    found = spark.read.schema(pointer.CHANGE).parquet(f"{folder}/changes")
    return found.select(F.col("source").cast("long").alias("source"), "load_id", F.col("snapshot_at").cast(kind).alias("snapshot_at"), "previous")


@query("""WITH pub AS (SELECT o_custkey % 25 AS source, o_orderdate AS since, max(o_orderkey) AS load_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), asked AS (SELECT DISTINCT o_custkey % 25 AS source, o_orderdate AS at FROM orders WHERE o_orderstatus = 'P'),
    cur AS (SELECT a.source, a.at, (SELECT arg_max(load_id, since) FROM pub p WHERE p.source = a.source AND p.since <= a.at) AS load_id FROM asked a)
    SELECT c.source, c.at, c.load_id, count(l_partkey) AS n_rows, coalesce(sum(l_quantity), 0) AS stock FROM cur c LEFT JOIN lineitem l ON l.l_orderkey = c.load_id GROUP BY 1, 2, 3""")
def inventory_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and stock of the load that a source had published at a time, for many sources and times; none where nothing was published yet."""
    orders = read(spark, sf_dir, "orders")
    source = (F.col("o_custkey") % 25).alias("source")
    publications = orders.where("o_orderstatus = 'F'").select(source, F.col("o_orderkey").alias("load_id"), F.col("o_orderdate").alias("snapshot_at")).distinct()
    asked = orders.where("o_orderstatus = 'P'").select(source, F.col("o_orderdate").alias("at")).distinct()
    facts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("load_id")).agg(F.count("*").alias("n_rows"), inventory.total(F.col("l_quantity")).alias("stock"))
    current = asof.latest(asked, publications, "at", "snapshot_at", ["source"], ["load_id"], ["load_id"])
    return current.join(facts, "load_id", "left").select("source", "at", "load_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("stock", F.lit(0.0)).alias("stock"))


# ---------------------------------------------------------------- versions, sketches and rules
@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 83 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 89 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice""")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that came, went or changed between two versions, found by their digest trees; the SQL compares every row."""
    rows, k = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    a = rows.where("o_orderkey % 83 <> 0")
    b = rows.where("o_orderkey % 89 <> 0").withColumn("o_orderstatus", F.when(k % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    leaves = 4096
    return merkle.changed_rows(a, b, "o_orderkey", cut(merkle.tree(a, "o_orderkey", leaves), "tree"), cut(merkle.tree(b, "o_orderkey", leaves), "tree"), leaves)


_COUNTED, _RANKS = ["l_partkey", "l_suppkey", "l_orderkey", "l_returnflag"], [0.05, 0.25, 0.5, 0.75, 0.95]


@query(" UNION ALL ".join(f"SELECT '{c}' AS figure, count(DISTINCT {c}) AS exact, true AS within FROM lineitem WHERE year(l_shipdate) <> 1997" for c in _COUNTED)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'l_extendedprice at {r}', count(*), true FROM lineitem WHERE year(l_shipdate) <> 1997" for r in _RANKS))
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts and quantiles over all years but one, from sketches by year: whether each is within its error of the exact figure."""
    rows = read(spark, sf_dir, "lineitem").withColumn("load", F.year("l_shipdate"))
    made = cut(sketches.by_load(rows, "load", _COUNTED, ["l_extendedprice"]), "sketches").where("load <> 1997")
    kept = rows.where("load <> 1997")
    exact = kept.agg(*[F.count_distinct(c).alias(c) for c in _COUNTED])
    exact = exact.unpivot([], exact.columns, "column", "exact")
    counts = sketches.distinct_counts(made, _COUNTED).join(exact, "column").select(F.col("column").alias("figure"), "exact", (F.abs(F.col("n_values") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("exact"))).alias("within"))
    asked = {r["rank"]: r["value"] for r in sketches.quantiles(made, ["l_extendedprice"], _RANKS).collect()}  # a number for each rank
    value = F.col("l_extendedprice")
    held = [F.struct(F.lit(f"l_extendedprice at {r}").alias("figure"), F.lit(r).alias("rank"), F.count_if(value < v).alias("below"), F.count_if(value <= v).alias("upto")) for r, v in asked.items()]
    at = kept.agg(F.count("*").alias("exact"), F.array(*held).alias("q")).select("exact", F.inline("q"))
    slack = sketches.RANK_ERROR * F.col("exact") + 1
    fits = (F.col("below") - slack <= F.col("rank") * F.col("exact")) & (F.col("rank") * F.col("exact") <= F.col("upto") + slack)
    return counts.unionByName(at.select("figure", "exact", fits.alias("within")))


@query("""WITH rules AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS word FROM benchmark), words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS word FROM documents)
    SELECT r.word, count(w.doc_id) AS n_docs FROM rules r JOIN words w ON w.word = r.word GROUP BY 1""".replace("\\\\", "\\"))
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every longer word of the benchmark, as a pattern between word boundaries: how many documents each one fits."""
    words = sorted(r[0] for r in read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct().collect())
    rules = [(w, rf"\b{w}\b") for w in words]
    found = rulematch.match_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules, "fits").select(F.explode("fits").alias("at"))
    named = spark.createDataFrame(list(enumerate(words)), "at int, word string")
    return found.groupBy("at").agg(F.count("*").alias("n_docs")).join(F.broadcast(named), "at").select("word", "n_docs")


# ---------------------------------------------------------------- signed changes
_MOVED = f"""{SITES_SQL}, final AS (SELECT site, CASE WHEN site % 10 = 3 THEN 'NATION_1' WHEN site % 10 = 4 THEN NULL ELSE country END AS country, CASE WHEN site % 10 = 3 THEN 'branch' WHEN site % 10 = 7 THEN 'transit' ELSE site_type END AS site_type FROM sites),
    seen AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN l_partkey + 1 ELSE l_partkey END AS code, coalesce(country, 'Sin país') AS place, country, l_quantity AS stock, site_type IN ({AVAILABLE_SQL}) AND l_quantity > 0 AS free FROM lineitem JOIN final ON l_suppkey = site)"""


def _changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("stock"))
    known, last = site_table(spark, sf_dir), F.col("site") % 10
    before = known.where(last.isin(3, 4, 7))
    after = before.withColumns({"country": F.when(last == 3, "NATION_1").when(last != 4, F.col("country")), "site_type": F.when(last == 3, "branch").when(last == 7, "transit").otherwise(F.col("site_type"))})
    stored = cut(deltas.cells(rows, known, AVAILABLE), "cells")
    changed = cut(deltas.merged(stored, deltas.site_change(rows, before, after, AVAILABLE)), "cells")
    moves = changed.where("code % 50 = 0").select("code", (F.col("code") + 1).alias("target")).distinct()
    return deltas.merged(changed, deltas.link_change(changed, moves))


@query(f"""WITH {_MOVED} SELECT code, place AS country, coalesce(sum(stock) FILTER (free), 0) AS quantity, count(*) FILTER (free) AS n_stock, count(*) AS n_rows FROM seen GROUP BY 1, 2""")
def stock_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock by country after sites changed and codes were linked: the first cells with signed ones added; the SQL starts from the rows."""
    return _changed_cells(spark, sf_dir).select("code", "country", F.col("quantity").cast("double").alias("quantity"), "n_stock", "n_rows")


_GROUPED = """groups AS (SELECT key, count(*) AS members, bool_or(len(countries) = 0) AS unknown FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1), shared AS (SELECT key, max(n) > 1 AS shared FROM (SELECT key, c, count(*) AS n FROM (SELECT key, unnest(countries) AS c FROM keyed WHERE key IS NOT NULL) GROUP BY 1, 2) GROUP BY key)
    SELECT g.key, members, CASE WHEN unknown OR coalesce(shared, false) THEN 'Mismo país' ELSE 'Otro país' END AS kind FROM groups g LEFT JOIN shared s ON g.key = s.key"""


@query(f"""WITH {_MOVED}, own AS (SELECT code, list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)) AS countries FROM seen WHERE code % 4 <> 0 OR place IN ('NATION_1', 'NATION_2') GROUP BY code),
    keyed AS (SELECT code // 3 AS key, coalesce(countries, []) AS countries FROM own), {_GROUPED}""")
def groups_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of duplicate groups after the countries of many members changed, from counts by key with signed ones added."""
    now = _changed_cells(spark, sf_dir).where("code % 4 <> 0 OR country IN ('NATION_1', 'NATION_2')")
    after = deltas.products(now).withColumn("key", F.floor(F.col("code") / 3))
    before = after.withColumns({"countries": F.when(F.col("code") % 5 == 0, F.slice("countries", 1, 1)).otherwise(F.col("countries"))}).where("code % 7 <> 0")
    stored = cut(deltas.members(before, "key"), "members")
    touched = "code % 5 = 0 OR code % 7 = 0"
    counts = deltas.merged_members(stored, deltas.members(before.where(touched), "key", sign=-1), deltas.members(after.where(touched), "key"), key="key")
    return deltas.kinds(counts, "key")


# ---------------------------------------------------------------- smaller figures
@query("""WITH c AS (SELECT p_brand AS key, field, value, count(*) AS n FROM (UNPIVOT (SELECT p_brand, p_type, p_name, CAST(p_size AS VARCHAR) AS p_size, CAST(p_size % 3 AS VARCHAR) AS class FROM part) ON p_type, p_name, p_size, class INTO NAME field VALUE value) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY n DESC, value) AS place FROM c) SELECT key, field, count(*) AS n_labels, string_agg(value || ' (' || n || ')', ', ' ORDER BY place) FILTER (place <= 5) AS top_labels FROM r GROUP BY 1, 2""")
def fragmentation_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of four label fields the distinct labels of a key and its five most frequent ones."""
    from acervo.operators import profile

    part = read(spark, sf_dir, "part").withColumns({"class": (F.col("p_size") % 3).cast("string"), "p_size": F.col("p_size").cast("string")})
    return profile.fragmentation_of(part, "p_brand", ["p_type", "p_name", "p_size", "class"]).withColumnRenamed("p_brand", "key")


@query(f"""WITH {OBS_SQL} SELECT code, coalesce(sum(greatest(stock, 0)) FILTER (site_type IN ({AVAILABLE_SQL})), 0) AS free, coalesce(string_agg(DISTINCT country, ', ' ORDER BY country) FILTER (stock > 0 AND site_type IN ({AVAILABLE_SQL})), '') AS countries FROM obs GROUP BY code""")
def stocked_country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available stock of each code and the countries that have some."""
    free, has = F.col("site_type").isin(*AVAILABLE), F.col("stock") > 0
    return observations(spark, sf_dir).groupBy("code").agg(F.coalesce(inventory.total(F.when(free, F.greatest("stock", F.lit(0.0)))), F.lit(0.0)).alias("free"), F.array_join(F.array_sort(F.collect_set(F.when(free & has, F.col("country")))), ", ").alias("countries"))


@query("SELECT l_partkey AS code, string_agg(l_orderkey, ',' ORDER BY l_orderkey) AS rows, count(*) AS n FROM lineitem WHERE l_partkey % 20 = 0 GROUP BY 1")
def rows_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row list of every code that 20 divides."""
    rows = read(spark, sf_dir, "lineitem").where("l_partkey % 20 = 0").select(F.col("l_partkey").alias("code"), "l_orderkey")
    return checks.row_list(rows, "code", "l_orderkey").select("code", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("rows"), F.size("rows").cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IN (SELECT CAST(r_regionkey * 7 AS VARCHAR) FROM region)")
def json_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload rows whose code is one of a list that another table gives."""
    wanted = read(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).cast("string").alias("k"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).join(wanted, "k", "left_semi").select("event_id", "k")
