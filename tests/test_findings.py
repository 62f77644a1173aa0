"""Queries against their SQL on tables that hold what the driver's small ones do not."""

import os

import duckdb
import pytest

from acervo.plans import ORACLES, QUERIES
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def tables(path, **changed):
    """A folder of the smallest tables, some of them changed by a query."""
    for t in TABLES:
        if t in changed:
            duckdb.execute(f"COPY ({changed[t]}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["assign_codes", "newest_manual", "search_page"])
def test_numbers_of_more_than_five_digits(spark, tmp_path, name):
    moved = {t: f"SELECT * REPLACE ({k} + 123400 AS {k}) FROM '{SF}/{t}.parquet'" for t, k in (("part", "p_partkey"), ("lineitem", "l_partkey"))}
    moved["lineitem"] = moved["lineitem"].replace("REPLACE (", "REPLACE (TIMESTAMP '2000-06-01' AS l_shipdate, ")
    moved["supplier"] = f"SELECT * REPLACE (24 AS s_nationkey) FROM '{SF}/supplier.parquet'"
    assert compare(spark, QUERIES[name], ORACLES[name], tables(tmp_path, **moved)) > 0


def test_flags_and_base_letters_as_the_sql_sees_them(spark, tmp_path):
    texts = ["étrash", "trashé", "TRASH.", "traſh", "_trash", "it is Obsolete\u0301", "do NOT use", "ﬁﬂ", "½½", "ßa", "éÉı", "ａｂｃ", "ǰǰǰ", "K1Å", None, "", "ab", "è 12"]
    rows = ", ".join(f"({i}, " + ("NULL" if t is None else f"'{t}'") + ")" for i, t in enumerate(texts))
    path = tables(tmp_path, documents=f"SELECT CAST(i AS BIGINT) AS doc_id, CAST(t AS VARCHAR) AS text FROM (VALUES {rows}) v(i, t)")
    assert compare(spark, QUERIES["operational_flags"], ORACLES["operational_flags"], path) == len(texts)


def test_numbers_that_lie_half_way(spark, tmp_path):
    prices = [125000.0, 135000.0, 1250.0, 1350.0, 995000.0, 985000.0, 12.5, 13.5, 0.125, 0.375, 1234.565, 2.675, 1e6, 15.0, 0.0, 5.0, 99.5]
    rows = ", ".join(f"({p})" for p in prices)
    orders = f"SELECT CAST(row_number() OVER () AS BIGINT) AS o_orderkey, o_totalprice FROM (SELECT CAST(p AS DOUBLE) AS o_totalprice FROM (VALUES {rows}) v(p), range(8))"
    path = tables(tmp_path, orders=orders.replace("range(8)", "range(8) ORDER BY range, p"))
    assert compare(spark, QUERIES["raw_with_normal"], ORACLES["raw_with_normal"], path) == 8 * len(prices)


def test_detail_has_the_rows_of_every_load(spark, tmp_path):
    lines = f"SELECT * REPLACE (3 AS l_partkey, CASE WHEN l_linenumber < 4 THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '2000-01-01' END AS l_shipdate) FROM '{SF}/lineitem.parquet' ORDER BY l_orderkey, l_linenumber LIMIT 12"
    path = tables(tmp_path, lineitem=lines)
    assert QUERIES["detail_rows"](spark, path).count() == 12
    assert compare(spark, QUERIES["detail_rows"], ORACLES["detail_rows"], path) == 12


ODD_NAMES = "CASE p_partkey % 7 WHEN 1 THEN 'ré' || p_name WHEN 2 THEN 'éR ' || p_name WHEN 3 THEN 'hot_' || p_name || 'ſ' WHEN 4 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 1 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 1 THEN lower(p_type) ELSE p_type END AS p_type"


@pytest.mark.parametrize("odd", [{"part": ODD_NAMES}, {"quantity": "l_quantity * 1e-11"}], ids=["names", "tiny"])
def test_search_page_of_odd_products(spark, tmp_path, odd):
    changed = {"supplier": f"SELECT * REPLACE (24 AS s_nationkey) FROM '{SF}/supplier.parquet'"}
    if "part" in odd:
        changed["part"] = f"SELECT * REPLACE ({odd['part']}) FROM '{SF}/part.parquet'"
    changed["lineitem"] = f"SELECT * REPLACE (TIMESTAMP '2000-06-01' AS l_shipdate, {odd.get('quantity', 'l_quantity')} AS l_quantity) FROM '{SF}/lineitem.parquet'"
    assert compare(spark, QUERIES["search_page"], ORACLES["search_page"], tables(tmp_path, **changed)) > 20
