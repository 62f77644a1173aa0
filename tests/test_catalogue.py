"""The engine over several loads, sources and links, and its partial commands against standardising all."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from acervo.operators import asof, checks, deltas, duplicates, inventory, links, publication, sites, wordindex
from acervo.plans import catalogue_queries, engine_queries
from acervo.plans.pipeline import SHOWN, Engine, Rejected
from acervo.rulepack import demo
from acervo.session import cut
from acervo.sources import buckets
from acervo.sources.buckets import Buckets
from acervo.sources.store import Store
from tests.test_engine import QUICK, ROWS, SCHEMA, products, row


@pytest.fixture(scope="module", autouse=True)
def quick(spark):
    before = {k: spark.conf.get(k) for k in QUICK}
    for k, v in QUICK.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def engine_with(spark, path, *loads):
    engine = Engine(spark, f"file://{path}/store", demo)
    for i, (source, rows) in enumerate(loads, 1):
        engine.stage(spark.createDataFrame(rows, SCHEMA), source, f"k{i}")
        engine.standardise(i)
    return engine


def plain(rows):
    return sorted(str({c: r[c] for c in SHOWN}) for r in rows)


# ---------------------------------------------------------------- loads and sources
def test_a_second_load_does_not_count_twice(spark, tmp_path):
    engine = engine_with(spark, tmp_path, ("src", ROWS), ("src", ROWS[:6]))
    p = products(engine)
    assert p["001"].load_id == 2 and p["008"].load_id == 1
    info = engine.detail(p["001"].master_id)
    assert [(r.code, r.site) for r in info["rows"]] == [("001", "S2"), ("001", "S1")] and sum(r.available for r in info["stock"]) == 5.5
    counts = engine.export(f"file://{tmp_path}/mart")
    mart = spark.read.parquet(f"file://{tmp_path}/mart/inventory")
    assert counts["inventory"] == mart.count() == 5 and {r.load_id for r in mart.collect()} == {2}
    assert mart.columns == ["master_id", "code", "site", "stock", "cost", "replacement_cost", "load_id"]
    texts = {r.source_code: r.description for r in spark.read.parquet(f"file://{tmp_path}/mart/source_codes").collect()}
    assert texts["001"] == "SMALL RING" and texts["008"] is None
    assert counts["categories"] == 5 and counts["countries"] == 3


def test_an_older_load_is_stale_once_a_newer_one_is_published(spark, tmp_path):
    good = [ROWS[0], ROWS[1]]
    engine = Engine(spark, f"file://{tmp_path}/store", demo)
    for k in ("k1", "k2", "k3"):
        engine.stage(spark.createDataFrame(good, SCHEMA), "src", k)
    engine.build(1)
    assert engine.preview(1)["ready"]  # later loads that are only staged do not matter
    engine.publish(2, engine.preview(2)["token"], "2024-01-01T00:00:00Z", True)
    first, second, third = (engine.preview(i) for i in (1, 2, 3))
    assert first["stale"] and not first["ready"] and second["already_published"] and not second["stale"] and third["ready"]
    assert engine.inventory("2023-12-31T00:00:00Z").count() == 0 and engine.inventory("2024-01-01T01:00:00+01:00").count() == 2


def test_one_code_in_two_sources_is_two_products(spark, tmp_path):
    engine = engine_with(spark, tmp_path, ("one", [row(2, "001", "small ring")]), ("two", [row(2, "001", "big gear", site_name="SOUTH 9")]))
    rows = engine.table("standards").orderBy("master_id").collect()
    assert [(r.master_id, r.name.split(" ")[1], r.standard_code) for r in rows] == [(1, "ring", "HW-RNG-00001"), (2, "gear", "DR-GEA-00001")]
    assert {(r.source, r.site): r.country for r in engine.table("sites").collect()} == {("one", "S1"): "NATION_1", ("two", "S1"): "NATION_2"}
    with pytest.raises(Rejected, match="several"):
        engine.set_site("S1", "NATION_3", None, "ana")
    engine.set_site("S1", "NATION_3", None, "ana", source="two", load_id=2)
    assert {r.master_id: r.countries for r in engine.table("standards").collect()} == {1: ["NATION_1"], 2: ["NATION_3"]}


# ---------------------------------------------------------------- sites, search and names
def test_a_kind_of_site_leaves_its_country_open_to_rules(spark, tmp_path):
    engine = engine_with(spark, tmp_path, ("src", ROWS))
    engine.set_site("S1", None, "repair", "ana", load_id=1)
    s1 = {r.site: r for r in engine.table("sites").collect()}["S1"]
    assert (s1.country, s1.country_source, s1.site_type, s1.type_source) == ("NATION_1", "palabra clave", "repair", "manual")
    p = products(engine)["001"]
    assert p.stock_by_country == {"NATION_2": 3.5} and p.countries == ["NATION_1", "NATION_2"]
    assert engine.search("ring", country="NATION_1")[1] == 0 and engine.search("ring", country="NATION_2")[1] == 2
    engine.standardise(1)
    assert {r.site: r.site_type for r in engine.table("sites").collect()}["S1"] == "repair"
    with pytest.raises(Rejected, match="needed"):
        engine.set_site("S1", None, None, "ana")


def test_brands_are_named_by_codes_and_aliases(spark, tmp_path):
    rows = [row(2, "001", "ring", brand="Zed-1"), row(3, "001", "ring", "S2", "SOUTH 6", brand="Zed-1"), row(4, "001", "ring", "S3", "SOUTH 7", brand="Zed-1"), row(5, "002", "bolt", brand="ZED 1"), row(6, "003", "gear", brand="ZED 1"), row(7, "004", "plate", brand="brand 1")]
    engine = engine_with(spark, tmp_path, ("src", rows))
    assert {r.brand_key: r.brand for r in engine.table("brands").collect()} == {"ZED1": "ZED 1", "BRAND01": "Brand#01"}


def test_reviews_follow_the_rules_and_people(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", demo)
    rows = [row(2, "001", "red ring", label="SMALL"), row(3, "002", "red bolt"), row(4, "003", "thing")]
    engine.stage(spark.createDataFrame(rows, SCHEMA), "src", "k1")
    history = spark.createDataFrame([("003", "family", "Gears", "context-1", 1)], "code string, field string, value string, version string, step int")
    engine.build(1, history)
    assert {r.code: r.family for r in engine.proposals(1).collect()}["003"] == "Gears"
    engine.standardise(1)
    said = {r.code: (r.status, r.family, r.reason) for r in engine.proposals(1).collect()}
    assert said["001"] == ("approved_by_rule", "Rings", "demo-1: Alta confianza") and said["002"][0] == "pending" and said["002"][1] == "Bolts"
    assert engine.preview(1)["pending_families"] == 2
    me = products(engine)["002"]
    engine.review(me.master_id, "approved", "Bolts", engine.revision(me.master_id), "ana", "seen")
    assert engine.preview(1)["pending_families"] == 1 and {r.code: r.status for r in engine.review_rows(1).collect()}["002"] == "approved_by_reviewer"


def test_stock_keeps_its_decimals_and_its_size(spark, tmp_path):
    engine = engine_with(spark, tmp_path, ("src", [row(2, "001", "ring", stock="0,12555"), row(3, "001", "ring", "S6", "NORTH 6", stock="2,3456")]))
    assert products(engine)["001"].stock_by_country == {"NATION_1": 2.47115}
    obs = spark.createDataFrame([("a", "X", "branch", 1e16), ("a", "X", "branch", 0.5), ("b", "X", "branch", 3e30), ("b", "X", "branch", 1e30), ("c", "X", "branch", 0.0049), ("c", "X", "branch", 2.3456)], "code string, country string, site_type string, stock double")
    assert {r.code: r.quantity for r in inventory.stock_by_country(obs, ["branch"]).collect()} == {"a": 1e16, "b": 4e30, "c": 2.3505}


def test_filled_values(spark):
    rows = spark.createDataFrame([(1, "a", "0", Decimal("0.00"), False), (2, "a", "x", Decimal("5.00"), True), (3, "b", "", None, None)], "n int, code string, t string, d decimal(8,2), f boolean")
    got = {r.code: (r.t, r.d, r.f) for r in checks.first_filled(rows, "code", ["n"], ["t", "d", "f"]).collect()}
    assert got == {"a": ("0", Decimal("5.00"), True), "b": (None, None, None)}
    assert {r.code: r.rows for r in checks.row_list(rows, "code", "n").collect()} == {"a": [1, 2], "b": [3]}


# ---------------------------------------------------------------- links
def test_linked_codes_follow_along_a_chain_and_back(spark, tmp_path):
    engine = engine_with(spark, tmp_path, ("src", ROWS))
    start = products(engine)
    ids = {c: r.master_id for c, r in start.items()}
    one = engine.link(ids["002"], ids["001"], 1)
    assert [r.code for r in engine.search(start["002"].standard_code)[0]] == ["001"]  # a retired code still finds the product
    two = engine.link(ids["001"], ids["005"], 1)
    p = products(engine)
    assert set(p) == set(start) - {"001", "002"} and p["005"].legacy_codes == ["005", "001", "002"] and p["005"].retired_codes == ["HW-RNG-00001", "HW-RNG-00002"]
    with pytest.raises(Rejected):
        engine.link(ids["008"], ids["001"], 1)  # stands under another
    counts = engine.export(f"file://{tmp_path}/mart")
    assert {r.master_id for r in spark.read.parquet(f"file://{tmp_path}/mart/source_codes").where("source_code IN ('001', '002', '005')").collect()} == {ids["005"]} and counts["retired_codes"] == 2
    engine.unlink(one, 1)  # the inner link first
    p = products(engine)
    assert p["002"].standard_code == "HW-RNG-00002" and p["005"].legacy_codes == ["005", "001"] and p["005"].retired_codes == ["HW-RNG-00001"]
    engine.unlink(two, 1)
    assert plain(products(engine).values()) == plain(start.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    log = [(k, k, rng.randrange(k), False) for k in range(1, 120)] + [(k, k, 0, True) for k in rng.sample(range(1, 120), 15)]
    log += [x for x in log if x[0] % 10 == 0]  # repeats
    rng.shuffle(log)
    undone = {x[0] for x in log if x[3]}
    parent = {s: t for i, s, t, u in log if not u and i not in undone}

    def walk(n):
        steps = 0
        while n in parent:
            n, steps = parent[n], steps + 1
        return n, steps

    live = links.open_links(spark.createDataFrame(log, "link_id long, source_id long, target_id long, undone boolean"))
    assert {(r.node, r.root, r.steps) for r in links.roots(live).collect()} == {(n, *walk(n)) for n in parent}


def test_long_chains_stars_and_circles(spark):
    edges = lambda rows: spark.createDataFrame(rows, "source_id long, target_id long")
    chain = links.roots(edges([(i, i - 1) for i in range(1, 300)])).collect()
    assert {(r.node, r.root, r.steps) for r in chain} == {(i, 0, i) for i in range(1, 300)}
    star = links.roots(edges([(i, 1) for i in range(2, 3000)] + [(1, 0)])).collect()
    assert {r.root for r in star} == {0} and max(r.steps for r in star) == 2
    assert links.roots(edges([])).count() == 0
    for circle in ([(1, 2), (2, 1)], [(5, 5)], [(1, 2), (2, 3), (3, 1), (4, 1)]):
        with pytest.raises(links.Cycle):
            links.roots(edges(circle))


# ---------------------------------------------------------------- buckets and the index
def test_partial_commands_give_what_standardising_all_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "ROWS", 2)
    engine = engine_with(spark, tmp_path, ("src", ROWS))
    assert engine.catalogue.count() == 4
    rng, opened = random.Random(7), []
    for step in range(6):
        p = products(engine)
        plain_codes = sorted(c for c, r in p.items() if r.origin == "import")
        kind = ("link", "site", "create", "review", "link", "unlink")[step]
        if kind == "link":
            a, b = rng.sample(plain_codes, 2)
            opened.append(engine.link(p[a].master_id, p[b].master_id, 1))
        elif kind == "unlink" and opened:
            engine.unlink(opened.pop(rng.randrange(len(opened))), 1)
        elif kind == "site":
            engine.set_site(rng.choice(["S1", "S2", "S3"]), rng.choice([None, "NATION_2", "NATION_3"]), rng.choice(["branch", "transit"]), "ana", load_id=1)
        elif kind == "create":
            engine.create(f"r{step}", "small ring", "acme", "X-1", confirm_duplicate=True)
        else:
            me = p[rng.choice(plain_codes)]
            engine.review(me.master_id, "approved", "Gizmos", engine.revision(me.master_id), "ana", "seen")
        if step in (1, 5):
            partial = plain(engine.table("standards").collect())
            engine.standardise(1)
            assert partial == plain(engine.table("standards").collect()), (step, kind)
        for token in ("ACME R", "HW RNG 00001", "NOTHING"):
            scan = engine.table("standards").where(F.concat(F.lit(" "), "search_text").contains(" " + token.split()[0]))
            for t in token.split()[1:]:
                scan = scan.where(F.concat(F.lit(" "), "search_text").contains(" " + t))
            assert engine.search(token)[1] == scan.count(), token


def test_a_review_writes_its_buckets_and_no_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "ROWS", 1)
    engine = engine_with(spark, tmp_path, ("src", ROWS))
    me = products(engine)["005"]
    before = engine.store.manifest()["tables"]
    engine.review(me.master_id, "approved", "Widgets", engine.revision(me.master_id), "ana", "seen")
    after = engine.store.manifest()["tables"]
    changed = [t for t in after if t.startswith("standards.") and after[t] != before.get(t)]
    n = engine.catalogue.count()
    assert n == 8 and changed == [f"standards.{Buckets.number(me.master_id, n):05d}of{n:05d}"]
    assert engine.product(me.master_id).family == "Widgets" and engine.product(10**6) is None


def test_buckets_replace_remove_and_empty(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    b = Buckets(store, "t", "k long, v string", "k", rows=3)
    assert b.read().count() == 0 and b.count() == 0 and b.of_keys([1]).count() == 0
    rows = lambda *v: spark.createDataFrame(list(v), "k long, v string")
    store.commit(b.whole(rows(*[(i, "a") for i in range(10)]), 10), "whole")
    assert b.count() == 4 and b.read().count() == 10
    store.commit(b.changed(rows((3, "b"), (77, "new")), rows((4, "")).select("k")), "changed")
    assert {r.k: r.v for r in b.read().collect()} == {**{i: "a" for i in range(10) if i not in (3, 4)}, 3: "b", 77: "new"}
    gone = rows(*[(i, "") for i in [*range(10), 77]]).select("k")
    store.commit(b.changed(rows((5, "c")).limit(0), gone), "emptied")
    assert b.read().count() == 0 and b.count() == 4
    store.commit(b.whole(rows((1, "z")), 1), "one bucket")
    assert b.count() == 1 and [r.k for r in b.read().collect()] == [1]


def test_index_answers_like_a_scan_after_changes(spark):
    rng = random.Random(2)
    words = ["RING", "RINGS", "RINGSIDE", "R", "BOLT", "B2", "GEARBOX", "GEAR", "9"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(5))) for i in range(60)}
    frame = lambda t: spark.createDataFrame(list(t.items()), "id long, t string")
    index = wordindex.postings(frame(texts), "id", "t").withColumns({"live": F.lit(True), "seq": F.lit(1).cast("long")})
    for seq in (2, 3):
        later = {i: (" ".join(rng.choices(words, k=3)) if rng.random() < 0.3 else t) for i, t in texts.items() if rng.random() < 0.8} | {100 + seq: "GEAR RINGSIDE"}
        index = index.unionByName(wordindex.changes(frame(texts), frame(later), "id", "t", seq))
        texts = later
    held = lambda t, tokens: all(any(w.startswith(k) for w in t.split()) for k in tokens)
    asked = {1: ["R"], 2: ["RINGS"], 3: ["GEAR", "B"], 4: ["RINGSIDE", "G"], 5: ["NONE", "R"], 6: ["GEARB"], 7: ["9", "R", "BOLT"]}
    got = wordindex.answers(index, spark.createDataFrame([(q, k) for q, t in asked.items() for k in t], "query long, token string")).collect()
    assert {(r.query, r.id) for r in got} == {(q, i) for q, tokens in asked.items() for i, t in texts.items() if held(t, tokens)} and len(got) == len(set(got))
    for tokens in asked.values():
        ids, _ = wordindex.intersected([wordindex.found(index, t) for t in wordindex.tokens_of(" ".join(tokens))])
        assert {r.id for r in ids.collect()} == {i for i, t in texts.items() if held(t, tokens)}
    assert wordindex.tokens_of("RING R RINGS B B") == ["RINGS", "B"]


def shuffled_rows(spark, job) -> int:
    """Rows that ``job`` writes to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    job()
    return written() - before


def test_index_answers_of_like_queries_are_not_shuffled_pair_by_pair(spark):
    texts = spark.createDataFrame([(i, f"RING BOLT {i}") for i in range(400)], "id long, t string")
    index = cut(wordindex.postings(texts, "id", "t").withColumns({"live": F.lit(True), "seq": F.lit(1).cast("long")}), "index")
    queries = spark.createDataFrame([(q, t) for q in range(200) for t in ("RIN", "B")], "query long, token string")
    made, broadcast = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(spark, lambda: made.append(wordindex.answers(index, queries).count())) < 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert made == [80_000]


def test_similar_products_are_not_shuffled_pair_by_pair(spark, monkeypatch):
    rows = [(i, f"RED RING {i}", f"k{i % 3}") for i in range(2000)]
    table = spark.createDataFrame(rows, "master_id long, search_text string, key string")
    index = cut(wordindex.postings(table, "master_id", "search_text").withColumns({"live": F.lit(True), "seq": F.lit(1).cast("long")}), "index")
    monkeypatch.setattr(catalogue_queries, "catalogue", lambda *_: table)
    monkeypatch.setattr(catalogue_queries, "word_index", lambda *_: index)
    made, broadcast = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(spark, lambda: made.append(catalogue_queries.similar_not_equal(spark, "").count())) < 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert made == [sum(k != o for i, _, k in rows if i % 20 == 0 for _, _, o in rows)]


def test_expanded_meets_every_block_once(spark, monkeypatch):
    monkeypatch.setattr(wordindex, "IDS", 7)
    monkeypatch.setattr(wordindex, "ASKERS", 3)
    members = spark.createDataFrame([(q, q % 2) for q in range(20)], "query long, class long")
    matched = spark.createDataFrame([(c, i) for c in (0, 1, 2) for i in range(30 + c)], "class long, id long")
    got = [tuple(r) for r in wordindex.expanded(members, matched).collect()]
    assert sorted(got) == [(q, i) for q in range(20) for i in range(30 + q % 2)]


def test_nodes_of_a_large_tree_get_its_codes_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 40_000, raising=False)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = engine_queries.link_forest(spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id())
        got = df.where("root = 1").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert len(got) > 2 and max(r["count"] for r in got) * 2 < sum(r["count"] for r in got)


def test_copies_of_a_long_text_are_never_held_together(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 40_000)
    df = engine_queries.link_forest(spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert made and not any("retired_codes" in line for line in made)
    below = plan[plan.index("Generate explode") :].split("Join", 1)[0]
    assert "retired_codes" not in below.split("Relation")[0]


def test_pages_of_long_texts_are_written_in_bounded_memory(spark, tmp_path):
    text, n = "x" * 3_000_000, 60
    forest = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("root"), F.lit(1).cast("long").alias("steps"))
    links.with_text(forest, spark.createDataFrame([(1, text)], "root long, t string"), "t").coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 4 * len(text)
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("t") == text).agg(F.count("*"), F.countDistinct("node")).first()
    assert tuple(got) == (n, n)


# ---------------------------------------------------------------- as of
def test_as_of_against_a_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([*range(40), None]), i) for i in range(150)]
    asked = [(i, rng.choice(["hot", "b", "none", None]), rng.choice([*range(-2, 45), None])) for i in range(200)]
    want = {}
    for i, s, at in asked:
        fit = [(t, n) for k, t, n in rows if k is not None and k == s and t is not None and at is not None and t <= at]
        want[i] = max(fit)[1] if fit else None
    left = spark.createDataFrame(asked, "i int, source string, t int")
    right = spark.createDataFrame(rows, "source string, t int, n int")
    monkeypatch.setattr("acervo.operators.numbering.partitions", lambda spark: 7)
    got = asof.latest(left, right, "t", "t", ["source"], ["n"], ["n"]).collect()
    assert {r.i: r.n for r in got} == want and len(got) == len(asked)
    assert asof.latest(left, right.limit(0), "t", "t", ["source"], ["n"], ["n"]).where("n IS NOT NULL").count() == 0
    assert asof.latest(left.limit(0), right, "t", "t", ["source"], ["n"], ["n"]).count() == 0


def test_load_states_and_site_rules(spark):
    loads = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "load_id long, source string")
    got = {r.load_id: (r.active, r.stale, r.already_published) for r in publication.load_states(loads, loads.where("load_id IN (1, 2)")).collect()}
    assert got == {1: (2, True, False), 2: (2, False, True), 3: (2, False, False), 4: (None, False, False)}
    schema = "site string, site_name string, country string, country_source string, site_type string, type_source string"
    old = spark.createDataFrame([("a", "A", None, "manual", "office", "regla"), ("b", "B", "X", "sin evidencia", "transit", "manual"), ("c", "C", "X", "manual", "office", "manual")], schema)
    new = spark.createDataFrame([("a", "A2", "Y", "palabra clave", "branch", "regla"), ("b", "B2", "Y", "palabra clave", "branch", "regla"), ("d", "D", "Y", "palabra clave", "branch", "regla")], schema)
    found = {r.site: tuple(r)[1:] for r in sites.merged(old, new, ["site"]).collect()}
    assert found == {"a": ("A2", None, "manual", "branch", "regla"), "b": ("B2", "Y", "palabra clave", "transit", "manual"), "c": ("C", "X", "manual", "office", "manual"), "d": ("D", "Y", "palabra clave", "branch", "regla")}


# ---------------------------------------------------------------- the store
def test_old_versions_are_given_up(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"a": spark.range(1), "b": spark.range(5)}, "one")
    for n in (2, 3, 4):
        store.commit({"a": spark.range(n)}, f"a {n}")
    kept = store.at(3)
    assert store.expire(2) == 2 and store.version() == 4
    assert store.read("a").count() == 4 and store.read("b").count() == 5 and store.read("a", kept).count() == 3
    assert store.missing() == [] and store.expire(2) == 0
    store.commit({"a": spark.range(9)}, "five")
    assert store.version() == 5 and store.expire(1) == 2 and store.read("a").count() == 9 and store.read("b").count() == 5


def test_a_damaged_store_does_not_start(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", demo)
    assert engine.problems() == [] and engine.start() is None
    masters = engine.rows_as("masters", [("s", "1", 1, "import"), ("s", "1", 2, "import"), ("t", "1", 2, "import")])
    links_ = engine.rows_as("links", [(1, 1, "1", 2, None, [], False, "a", "r", "t"), (2, 2, "1", 1, None, [], False, "a", "r", "t")])
    engine.store.commit({"masters": masters, "links": links_}, "broken")
    assert engine.problems() == ["a master number stands twice", "a source's code has two masters", "2 links lead in a circle"]
    with pytest.raises(Rejected, match="damaged"):
        engine.start()


def test_a_failed_export_leaves_the_old_mart(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"file://{tmp_path}/store", demo)
    engine.stage(spark.createDataFrame([row(2, "001", "small ring")], SCHEMA), "src", "k1")
    engine.standardise(1)
    path = f"file://{tmp_path}/mart"
    engine.export(path)
    broken = F.raise_error(F.lit("no room"))
    monkeypatch.setattr(publication, "load_inventory", lambda rows, *a: rows.withColumn("x", broken))
    with pytest.raises(Exception, match="no room"):
        engine.export(path)
    assert spark.read.parquet(f"{path}/inventory").count() == 1 and [p.name for p in tmp_path.iterdir() if "draft" in p.name] == []


def test_signed_changes_equal_computing_again(spark):
    rng = random.Random(9)
    types = ["branch"]
    rows = [(f"c{rng.randrange(12)}", f"s{rng.randrange(6)}", round(rng.uniform(-1, 3), 4)) for _ in range(150)]
    place = {f"s{i}": (rng.choice(["X", "Y", None]), rng.choice(["branch", "office"])) for i in range(5)}
    frame = lambda r: spark.createDataFrame(r, "code string, site string, stock double")
    table = lambda p: spark.createDataFrame([(s, *v) for s, v in p.items()], "site string, country string, site_type string")
    stored = deltas.cells(frame(rows), table(place), types)
    for step in range(4):
        if step % 2:
            moves = {"c1": "c2", "c3": "c2"} if step == 1 else {"c2": "c4", "c9": "c8"}
            stored = deltas.merged(stored, deltas.link_change(stored, spark.createDataFrame(list(moves.items()), "code string, target string")))
            rows = [(moves.get(c, c), s, n) for c, s, n in rows]
        else:
            after = {s: (rng.choice(["X", "Y", "Z", None]), rng.choice(["branch", "office"])) for s in rng.sample(sorted(place), 2)}
            stored = deltas.merged(stored, deltas.site_change(frame(rows), table({s: place[s] for s in after}), table(after), types))
            place |= after
        stored = cut(stored, "cells")
        again = deltas.cells(frame(rows), table(place), types)
        assert sorted(map(str, stored.collect())) == sorted(map(str, again.collect()))
    obs = frame(rows).join(table(place), "site", "left")
    want = inventory.presence(obs).join(inventory.stock_map(obs, types), "code", "left")
    got = {r.code: (r.stock_by_country, r.countries) for r in deltas.products(stored).collect()}
    assert got == {r.code: (r.stock_by_country or {}, r.countries) for r in want.collect()}


def test_signed_members_equal_counting_again(spark):
    rng = random.Random(3)
    schema = "id int, key string, countries array<string>"
    make = lambda: {i: (rng.choice(["k1", "k2", "k3", None]), sorted(rng.sample(["X", "Y", "Z"], rng.randrange(3)))) for i in range(9)}
    frame = lambda d: spark.createDataFrame([(i, *v) for i, v in d.items()], schema)
    now = make()
    stored = deltas.members(frame(now), "key")
    for _ in range(4):
        later = now | {i: v for i, v in make().items() if rng.random() < 0.4}
        moved = [i for i in now if now[i] != later[i]]
        stored = cut(deltas.merged_members(stored, deltas.members(frame({i: now[i] for i in moved}), "key", sign=-1), deltas.members(frame({i: later[i] for i in moved}), "key"), key="key"), "members")
        now = later
        want = {(r.key, r.members, r.kind) for r in duplicates.kinds(frame(now), "key").collect()}
        assert {(r.key, r.members, r.kind) for r in deltas.kinds(stored, "key").collect()} == want


def test_commands_at_once_remove_their_own_tables_only(spark):
    import threading

    from acervo.session import fresh_path, tidy, together

    inside, done = threading.Event(), threading.Event()
    seen = {}

    def slow():
        with tidy(spark):
            seen["slow"] = cut(spark.range(3), "slow")
            inside.set()
            done.wait(60)
            seen["rows"] = seen["slow"].count()

    other = threading.Thread(target=slow)
    other.start()
    inside.wait(60)
    with tidy(spark):
        first, second = together(lambda: cut(spark.range(5), "a"), lambda: cut(spark.range(6), "b"))
        assert (first.count(), second.count()) == (5, 6)
        paths = first.inputFiles() + second.inputFiles()
    done.set()
    other.join()
    assert seen["rows"] == 3 and fresh_path(spark, "x")
    store = Store(spark, fresh_path(spark, "s"))
    assert not any(store._fs.exists(store._path(p)) for p in [*paths, *seen["slow"].inputFiles()])
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 // 0)
