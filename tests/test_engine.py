"""The catalogue engine end to end on a small load of our own, with its guards."""

import zipfile

import pytest
from pyspark.sql import functions as F

from acervo.plans.pipeline import COLUMNS, Engine, Rejected, describe_mart
from acervo.rulepack import demo
from acervo.sources import files, xlsx
from acervo.sources.store import StaleVersion, Store

SCHEMA = ", ".join(f"{c} {'long' if c == 'row_number' else 'string'}" for c in COLUMNS)


def row(n, code, description, site="S1", site_name="NORTH depot 5", brand="Acme", model="X-1", stock="2,00", label="", kind="ITEM", package="ITEM"):
    return (n, code, description, kind, package, brand, model, site, site_name, stock, label, "")


ROWS = [
    row(2, "001", "SMALL RING"), row(3, "001", "SMALL RING", "S2", "SOUTH branch 6", stock="3.50"), row(4, "002", "small ring", "S2", "SOUTH branch 6"),
    row(5, "003", "big bolt", brand="acme ", stock="1,234"), row(6, "004", "big gear do not use"), row(7, "005", "hot widget"), row(8, "006", "large thing", package="PACKAGE"),
    row(9, "007", "???"), row(10, "", "no code"), row(11, "008", "red widget", "S3", "unknown 9", stock="-4"),
]


QUICK = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}  # tiny tables: planning is all the time


@pytest.fixture(scope="module", autouse=True)
def quick(spark):
    before = {k: spark.conf.get(k) for k in QUICK}
    for k, v in QUICK.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", demo)


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    """One engine with a standardised load; the tests below follow one another on it."""
    made = Engine(spark, f"file://{tmp_path_factory.mktemp('catalogue')}/store", demo)
    made.first_report, made.first_summary = loaded(made, spark)
    return made


def staged(engine, spark, rows=ROWS, key="k1"):
    return engine.stage(spark.createDataFrame(rows, SCHEMA), "src", key)


def loaded(engine, spark):
    report = staged(engine, spark)
    return report, engine.standardise(report["load_id"])


def products(engine):
    return {r.code: r for r in engine.table("standards").collect()}


def test_load_standardise_and_repeat(spark, catalogue):
    engine, report, summary = catalogue, catalogue.first_report, catalogue.first_summary
    assert report["rows"] == 10 and report["accepted"] == 8 and not report["ready"]
    found = {(r.field, r.code): r.n for r in engine.report(1).collect()}
    assert found[("stock", "invalid_number")] == 1 and found[("code", "required_value")] == 1 and found[("stock", "negative_value")] == 1
    p = products(engine)
    assert p["001"].family == "Rings" and p["001"].standard_code == "HW-RNG-00001" and p["001"].name == "Small ring ACME X-1"
    assert p["001"].stock_by_country == {"NATION_1": 2.0, "NATION_2": 3.5} and p["001"].countries == ["NATION_1", "NATION_2"]
    assert p["001"].duplicate_group == p["002"].duplicate_group and p["001"].duplicate_kind == "Mismo país"
    assert p["004"].status.startswith("Revisar") and p["004"].standard_code is None
    assert p["005"].method.startswith("Revisar: conflicto") and p["006"].method == "Por tipo" or p["006"].family == "Bundles"
    assert "003" not in p and p["007"].name is None
    again = engine.stage(spark.createDataFrame(ROWS, SCHEMA), "src", "k1")
    assert again["repeated"] and engine.store.read("rows").count() == 10
    assert engine.standardise(1) == summary | {"new_codes": 0} and products(engine) == p


def test_quarantine_rules(spark, engine):
    rows = [row(2, "A", "ring one"), row(3, "A", "ring one"), row(4, "B", "bolt"), row(5, "B", "gear", "S2", "SOUTH 6"), row(6, "C", "ring", "S9", "one"), row(7, "D", "ring", "S9", "two")]
    report = staged(engine, spark, rows)
    assert report["accepted"] == 0
    codes = {i.code for r in engine.store.read("rows").collect() for i in r.issues if i.severity == "error"}
    assert codes == {"duplicate_key", "conflicting_identity", "conflicting_site"}
    missing = engine.stage(spark.createDataFrame([("x",)], "code string"), "src", "k2")
    assert missing["missing"] == ["description", "site", "site_name"] and not missing["ready"]


def test_search_and_detail(catalogue):
    engine = catalogue
    page, total = engine.search("ring ac")
    assert total == 2 and page[0].code in ("001", "002")
    assert engine.search("", named="with_stock")[1] + engine.search("", named="without_stock")[1] == engine.search("")[1]
    assert engine.search("", country="NATION_2")[1] == 2
    info = engine.detail(products(engine)["001"].master_id)
    assert [r.site for r in info["rows"]] == ["S2", "S1"] and sum(r.available for r in info["stock"]) == 5.5


def test_link_and_unlink(catalogue):
    engine = catalogue
    before = products(engine)
    a, b = before["001"].master_id, before["002"].master_id
    link = engine.link(b, a, 1)
    p = products(engine)
    assert "002" not in p and p["001"].legacy_codes == ["001", "002"] and p["001"].standard_code == before["001"].standard_code
    with pytest.raises(Rejected):
        engine.link(a, a, 1)
    made = engine.create("r9", "silver ring")
    assert engine.table("standards").where(F.col("master_id") == made).first().standard_code == "HW-RNG-00003"
    engine.unlink(link, 1)
    assert products(engine)["002"].standard_code == before["002"].standard_code
    with pytest.raises(Rejected):
        engine.unlink(link, 1)


def test_create_is_idempotent_and_guarded(catalogue):
    engine = catalogue
    plan = engine.propose("Small ring", "ACME", "x-1")
    assert len(plan["exact"]) == 2
    with pytest.raises(Rejected):
        engine.create("r1", "Small ring", "ACME", "x-1")
    made = engine.create("r1", "Small ring", "ACME", "x-1", confirm_duplicate=True)
    assert engine.create("r1", "Small ring", "ACME", "x-1") == made
    assert len(engine.propose("Small ring", "ACME", "x-1")["exact"]) == 3
    with pytest.raises(Rejected):
        engine.create("r1", "other", "ACME", "x-1")


def test_people_outrank_rules(catalogue):
    engine = catalogue
    me = products(engine)["005"]
    with pytest.raises(Rejected):
        engine.review(me.master_id, "approved", "Widgets", "stale", "ana", "seen")
    engine.review(me.master_id, "approved", "Widgets", engine.revision(me.master_id), "ana", "seen")
    engine.set_site("S3", "NATION_3", "branch", "ana")
    engine.standardise(1)
    p = products(engine)
    assert p["005"].method == "Revisor" and p["005"].standard_code == "HW-WDG-00002" and p["008"].countries == ["NATION_3"]
    with pytest.raises(Rejected):
        engine.set_site("S3", "ATLANTIS", None, "ana")


def test_publish(spark, engine):
    good = [ROWS[0], ROWS[1], ROWS[5]]
    report = staged(engine, spark, good)
    assert report["ready"]
    plan = engine.preview(1)
    with pytest.raises(Rejected):
        engine.publish(1, "wrong", "2024-01-01T00:00:00Z", True)
    with pytest.raises(Rejected):
        engine.publish(1, plan["token"], "2024-01-01T00:00:00Z", True)  # its codes have no masters yet
    engine.build(1)
    plan = engine.preview(1)
    assert plan["ready"] and plan["pending_families"] >= 0 and plan["missing_masters"] == 0
    with pytest.raises(Rejected):
        engine.publish(1, plan["token"], "2024-01-01T00:00:00Z")  # not confirmed as complete
    with pytest.raises(Rejected):
        engine.publish(1, plan["token"], "2024-01-01T00:00:00", True)
    made = engine.publish(1, plan["token"], "2024-01-01T00:00:00Z", True)
    assert made["rows"] == 3 and engine.inventory().count() == 3 and engine.preview(1)["already_published"]
    facts = {(r.code, r.site): r.amount for r in engine.inventory().collect()}
    assert facts[("001", "S2")] == 3.5
    staged(engine, spark, good[:2], "k2")
    second = engine.preview(2)
    assert second["absent_codes"] == 1 and second["ready"]
    with pytest.raises(Rejected):
        engine.publish(2, second["token"], "2023-01-01T00:00:00Z", True)
    assert not engine.store.read("publications").where("load_id = 2").count()


def test_export(catalogue, tmp_path):
    engine = catalogue
    counts = engine.export(f"file://{tmp_path}/mart")
    assert counts["products"] == 9 and counts["source_codes"] == 7 and counts["sites"] == 3 and counts["inventory"] == 8


def test_store_swaps_and_keeps(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = spark.range(3)
    v = store.commit({"t": one}, "first")
    store.commit({}, "more", append={"t": spark.range(2)})
    assert store.read("t").count() == 5 and store.read("t", store.at(v)).count() == 3
    with pytest.raises(StaleVersion):
        store.commit({"t": one}, "late", expected=v)
    assert store.describe()[0]["rows"] == 5


def test_xlsx_and_hashes(spark, tmp_path):
    path = tmp_path / "in.xlsx"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>code</t></si><si><t>name</t></si><si><t>00123</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    xlsx.register(spark)
    got = spark.read.format("acervo_xlsx").option("sheet", "Data").load(str(path)).orderBy("row_number").collect()
    assert [tuple(r) for r in got] == [(2, "00123", ""), (3, "", "x")]
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/s.xml"] = parts["xl/worksheets/s.xml"].replace(b"<row><c r=\"A1\"", b"<row r=\"1\"><c r=\"A1\"").replace(b"<row><c r=\"A2\"", b"<row r=\"2\"><c r=\"A2\"").replace(b"<row><c r=\"B3\"", b"<row r=\"5\"><c r=\"B5\"")
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    gaps = spark.read.format("acervo_xlsx").option("sheet", "Data").load(str(path)).orderBy("row_number").collect()
    assert [tuple(r) for r in gaps] == [(2, "00123", ""), (3, "", ""), (4, "", ""), (5, "", "x")]  # blank rows the sheet leaves out
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("acervo_xlsx").option("sheet", "Other").load(str(path)).collect()
    found = files.file_hashes(spark, f"file://{tmp_path}")
    assert found.count() == 1 and files.new_files(found, found).count() == 0
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.desc("i"))).first()
    same, turned = df.orderBy(F.desc("i")), df.withColumn("i", 3 - F.col("i"))
    assert files.ordered_fingerprint(df, "i") == files.ordered_fingerprint(same, "i") != files.ordered_fingerprint(turned, "i")
    files.write_csv(df, f"{tmp_path}/out")
    assert files.read_text_csv(spark, f"{tmp_path}/out").columns == ["i", "s"] and files.read_text_csv(spark, f"{tmp_path}/out").count() == 2


def test_landing_stream(spark, engine, tmp_path):
    from acervo.streaming.landing import watch

    folder = tmp_path / "landing"
    folder.mkdir()
    header = [c for c in COLUMNS if c != "row_number"]
    (folder / "a.csv").write_text(",".join(header) + "\n" + ",".join(["001", "small ring", "ITEM", "ITEM", "Acme", "X1", "S1", "NORTH 5", "2", "", ""]) + "\n")
    schema = spark.createDataFrame([], ", ".join(f"{c} string" for c in header)).schema
    watch(spark, str(folder), schema, engine, "stream", f"{tmp_path}/cp").awaitTermination()
    watch(spark, str(folder), schema, engine, "stream", f"{tmp_path}/cp").awaitTermination()
    assert engine.store.read("loads").count() == 1 and engine.store.read("rows").count() == 1
    other = tmp_path / "other"
    other.mkdir()
    text = (folder / "a.csv").read_text()
    (other / "b.csv").write_text(text.replace("001", "002"))
    (other / "copy.csv").write_text(text)  # a renamed copy brings nothing
    watch(spark, str(other), schema, engine, "stream", f"{tmp_path}/cp2").awaitTermination()
    assert sorted(r.code for r in engine.store.read("rows").collect()) == ["001", "002"] and engine.store.read("loads").count() == 2
    watch(spark, str(other), schema, engine, "stream", f"{tmp_path}/cp3").awaitTermination()  # a fresh checkpoint
    assert engine.store.read("rows").count() == 2


def test_a_failing_commit_leaves_nothing(spark, engine, monkeypatch):
    create = Store._create

    def broken(self, version, manifest):
        raise OSError("no room")

    monkeypatch.setattr(Store, "_create", broken)
    with pytest.raises(OSError):
        staged(engine, spark)
    assert engine.store.names() == [] and engine.store.version() == 0
    monkeypatch.setattr(Store, "_create", create)
    report = staged(engine, spark)
    assert engine.store.read("rows").count() == 10 and report["load_id"] == 1 and engine.store.version() == 1


def test_two_writers_on_one_version(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    seen = one.manifest()
    monkeypatch.setattr(two, "manifest", lambda: seen)  # it read before the other committed
    one.commit({"t": spark.range(3)}, "first")
    with pytest.raises(StaleVersion):
        two.commit({"t": spark.range(5)}, "second")
    assert one.read("t").count() == 3 and one.version() == 1


def test_labels_are_stored_once(spark, engine):
    first = [row(2, "001", "ring", label="GROUP A"), row(3, "002", "bolt", label="GROUP B")]
    staged(engine, spark, first, "k1")
    staged(engine, spark, [row(2, "003", "gear", label="GROUP A")], "k2")
    values = {r.value: r.value_id for r in engine.store.read("label_values").collect()}
    assert values == {"GROUP A": 1, "GROUP B": 2}
    assert sorted((r.load_id, r.row_number, r.value_id) for r in engine.store.read("row_labels").collect()) == [(1, 2, 1), (1, 3, 2), (2, 2, 1)]


def test_technical_exclusion_unlocks_a_publication(spark, engine):
    staged(engine, spark, [row(2, "001", "small ring"), row(3, "SYSTEMDEFAULT", "internal", site="", site_name=""), row(4, "002", "red bolt", site="", site_name="")])
    engine.build(1)
    assert engine.preview(1)["unresolved"] == 2
    with pytest.raises(Rejected):
        engine.exclude(1, 4, "exclude", "ana", "not a technical code")
    engine.exclude(1, 3, "exclude", "ana", "system code")
    plan = engine.preview(1)
    assert plan["excluded"] == 1 and plan["unresolved"] == 1 and not plan["ready"]
    assert {r.row_number: (r.eligible, r.decision) for r in engine.technical(1).collect()} == {3: (True, "exclude"), 4: (False, "pending")}
    staged(engine, spark, [row(2, "001", "small ring"), row(3, "SYSTEMDEFAULT", "internal", site="", site_name="")], "k2")
    engine.build(2)
    engine.exclude(2, 3, "exclude", "ana", "system code")
    plan = engine.preview(2)
    assert plan["ready"] and engine.publish(2, plan["token"], None, True, "received_at", "ana", "complete")["rows"] == 1
    with pytest.raises(Rejected):
        engine.exclude(2, 3, "pending", "ana", "too late")


def test_unknown_flag_stops_the_whole_publication(spark, engine):
    frame = spark.createDataFrame([row(2, "001", "small ring"), row(3, "002", "red bolt")], SCHEMA).withColumn("is_freight", F.when(F.col("code") == "002", "PERHAPS").otherwise("FREIGHT"))
    engine.stage(frame, "src", "k1")
    engine.build(1)
    plan = engine.preview(1)
    with pytest.raises(Rejected, match="is_freight=PERHAPS"):
        engine.publish(1, plan["token"], "2024-01-01T00:00:00Z", True)
    assert not engine.store.has("snapshots") and not engine.store.has("publications")


def test_build_review_sample_and_state(spark, engine):
    rows = [row(2, "001", "red ring", label="SMALL"), row(3, "002", "red bolt"), row(4, "003", "big ring obsolete", label="SMALL"), row(5, "004", "thing"), row(6, "005", "ring", site="", site_name="")]
    staged(engine, spark, rows)
    first = engine.build(1)
    assert first["new_masters"] == 4 and first["status"] == {"approved_by_rule": 1, "pending": 3, "quarantined": 1}
    assert engine.build(1)["new_reviews"] == 0 and engine.freeze_sample(1) == 1 == engine.freeze_sample(1)
    state = engine.state(1)
    assert state["counts"]["pending"] == 3 and sum(state["groups"].values()) == 3 and state["sample"] == ["001"] and state["latest"] is None
    assert {r.code: r.waits_as for r in state["rows"]}["003"] == "Advertencias operacionales" and len(state["technical"]) == 1
    engine.migrate("samples", "load_id long, family string, code string, original string, note string")
    assert engine.store.read("samples").columns[-1] == "note" and engine.store.read("samples").count() == 1


def test_a_locked_export_keeps_the_old_one(catalogue, tmp_path, monkeypatch):
    engine, path = catalogue, f"file://{tmp_path}/mart"
    engine.export(path)
    monkeypatch.setattr(engine, "exported", lambda draft: {"products": 0})  # nothing to move: every rename fails
    assert "locked" in engine.refresh_export(path)
    assert engine.spark.read.parquet(f"{path}/products").count() == 9
    found = describe_mart(engine.spark, path, ["products", "metadata"])
    assert found["tables"]["products"]["rows"] == 9 and found["metadata"]["source"] == "src"


def test_manual_product_with_a_stock_at_a_site(catalogue):
    engine = catalogue
    with pytest.raises(Rejected):
        engine.create("r20", "blue gear", stock="2,00")
    with pytest.raises(Rejected):
        engine.create("r20", "blue gear", site="nowhere", stock="2,00")
    made = engine.create("r20", "blue gear", site="S1", stock="2,00", actor="ana", reason="found in store")
    info = engine.detail(made)
    assert [(r.site, r.stock) for r in info["manual_stock"]] == [("S1", 2.0)] and info["history"][0].action == "manual_create"


def test_review_gives_a_code_at_once(catalogue):
    engine = catalogue
    me = products(engine)["008"]
    engine.review(me.master_id, "rejected", None, engine.revision(me.master_id), "ana", "no")
    assert products(engine)["008"].family is None and products(engine)["008"].method == "Revisar: rechazada por revisor"
    engine.review(me.master_id, "approved", "Widgets", engine.revision(me.master_id), "ana", "yes")
    after = products(engine)["008"]
    assert after.family == "Widgets" and after.standard_code and engine.search(after.standard_code)[1] == 1
    assert engine.state()["latest"]["products"] > 0 and len(engine.sites()) == 3


def test_http_commands(catalogue, tmp_path):
    import http.client
    import io
    import json
    import tarfile
    import threading

    from acervo.server import Commands, serve

    mart = f"file://{tmp_path}/mart"
    catalogue.export(mart)
    server, token = serve(Commands(catalogue, f"{tmp_path}/inbox", mart))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]

    def ask(method, path, body=None, host=None, key=token):
        link = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
        link.request(method, path, None if body is None else json.dumps(body), {"Host": host or f"127.0.0.1:{port}", **({"X-Catalog-Token": key} if method == "POST" else {})})
        answer = link.getresponse()
        return answer.status, json.loads(answer.read())

    try:
        code, found = ask("GET", "/api/search?q=ring&limit=2")
        assert code == 200 and found["total"] >= 2 and len(found["rows"]) == 2 and "stock" not in found["rows"][0]
        code, info = ask("GET", f"/api/product?id={found['rows'][0]['master_id']}")
        assert code == 200 and info["product"]["master_id"] == found["rows"][0]["master_id"]
        assert ask("GET", "/api/search", host="elsewhere:1")[0] == 403 and ask("GET", "/api/none")[0] == 404
        assert ask("POST", "/api/link", {"source_id": 1, "target_id": 1}, key="wrong")[0] == 403
        code, refused = ask("POST", "/api/link", {"source_id": 1, "target_id": 1, "actor": "ana", "reason": "same"})
        assert code == 400 and "itself" in refused["error"]
        assert ask("POST", "/api/propose", {"name": "small ring"})[0] == 200
        assert ask("POST", "/api/import", {"filename": "x.csv", "content": ""})[0] == 400
        link = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
        link.request("GET", "/api/download", None, {"Host": f"127.0.0.1:{port}"})
        with tarfile.open(fileobj=io.BytesIO(link.getresponse().read())) as tar:
            tar.extractall(tmp_path / "got", filter="data")
        assert catalogue.spark.read.parquet(f"file://{tmp_path}/got/products").count() == catalogue.spark.read.parquet(f"{mart}/products").count() > 0
    finally:
        server.shutdown()
