"""Digest trees, sketches, rule matching, XLSX files of any folder, and the streams."""

import datetime
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from acervo.operators import merkle, rulematch, sketches
from acervo.plans.pipeline import HEADERS, Engine
from acervo.rulepack import demo
from acervo.sources import xlsx
from acervo.streaming import landing, pointer


# ---------------------------------------------------------------- versions
@pytest.mark.parametrize("leaves", [1, 16, 100, 5000])
def test_changed_rows_are_those_of_a_full_comparison(spark, leaves):
    rng = random.Random(leaves)
    a = {i: (i % 7, f"t{i}") for i in range(400)}
    b = {i: v for i, v in a.items() if rng.random() < 0.97} | {i: (0, "new") for i in rng.sample(range(500), 8)} | {None: (1, None)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()] + [(7, 9, "twice")], "k long, n int, `a.b` string")
    x, y = frame(a), frame(b).repartition(3)
    trees = [merkle.tree(df, "k", leaves) for df in (x, y)]
    got = {(r.k, r.change) for r in merkle.changed_rows(x, y, "k", *trees, leaves).collect()}
    want = {(k, "removed" if k not in b else "added" if k not in a else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert got - {(7, "changed")} == want - {(7, "removed"), (7, "added"), (7, "changed")}
    assert merkle.changed_rows(x, frame(a).repartition(5), "k", trees[0], merkle.tree(frame(a), "k", leaves), leaves).count() == 0
    assert merkle.differing(*trees, leaves).count() <= max(1, len(want) + 1)


def test_sketches_of_loads_merge_within_their_errors(spark):
    rows = spark.range(40_000).select((F.col("id") % 5).alias("load"), (F.col("id") * 7 % 9001).alias("v"), F.rand(3).alias("x"))
    made = sketches.by_load(rows, "load", ["v"], ["x"])
    assert made.count() == 5
    n = sketches.distinct_counts(made.where("load <> 2"), ["v"]).first().n_values
    assert abs(n - 9001) <= sketches.DISTINCT_ERROR * 9001
    kept = sorted(r.x for r in rows.where("load <> 2").collect())
    for r in sketches.quantiles(made.where("load <> 2"), ["x"], [0.0, 0.1, 0.5, 0.99]).collect():
        rank = sum(x <= r.value for x in kept) / len(kept)
        assert abs(rank - r["rank"]) <= sketches.RANK_ERROR


# ---------------------------------------------------------------- rules
def test_matcher_finds_what_trying_all_rules_finds(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    shapes = ["\\b{}\\b", "{}s?$", "^{}", "{}.*{}", "({}|{})", "(?i){}", "{}+", "[xy]?{}", "(?:{}){{2}}", "{}\\d*"]
    rules = [(str(i), shape.replace("{}", "@").replace("@", rng.choice(words), 1).replace("@", rng.choice(words)).replace("{{", "{").replace("}}", "}")) for i in range(10_000) for shape in [rng.choice(shapes)]]
    texts = [None, "", "bal", "BAL bel"] + [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(12)]
    matcher = rulematch.Matcher(rules)
    compiled = [re.compile(p) for _, p in rules]
    want = [[i for i, p in enumerate(compiled) if p.search(t or "")] for t in texts]
    assert [matcher.matches(t or "") for t in texts] == want
    assert max(len(matcher.near(t or "")) for t in texts[4:]) < 0.45 * len(rules)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("rules", F.lit("kept")).withColumnRenamed("rules", "other.name")
    got = rulematch.match_rules(frame, "text", rules).orderBy("id").collect()
    assert [r["rules"] for r in got] == want and got[0]["other.name"] == "kept"
    assert rulematch.match_rules(frame.limit(0), "text", rules).count() == 0
    assert [r["rules"] for r in rulematch.match_rules(frame, "text", []).collect()] == [[]] * len(texts)


def test_a_literal_is_in_every_match():
    found = {p: rulematch.literal(p) for p in (r"\bRING\b", r"a+bcd*", r"(foo|bar)baz", r"x?yz{2}w", r"(?i)abc", r"", r"a(b(c))d", r"[a-z]+", r"(?:ab)*cd")}
    assert found == {r"\bRING\b": "RING", r"a+bcd*": "bc", r"(foo|bar)baz": "baz", r"x?yz{2}w": "yz", r"(?i)abc": "", r"": "", r"a(b(c))d": "abcd", r"[a-z]+": "", r"(?:ab)*cd": "cd"}


# ---------------------------------------------------------------- files and streams
def book(rows):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


HEADER = ["Product ID", "Description", "Type", "Package", "MANUFACTURER", "MODEL", "SITEID", "SITENAME", "Stock"]


def line(code, name="small ring"):
    return [code, name, "ITEM", "ITEM", "Acme", "X1", "S1", "NORTH 5", "2,5"]


def test_books_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "BATCH", 2)
    (tmp_path / "a.xlsx").write_bytes(book([HEADER, *[line(f"00{i}") for i in range(5)]]))
    (tmp_path / "b.xlsx").write_bytes(book([["Description", "Product ID"], ["bolt", "9"]]))
    (tmp_path / "c.txt").write_text("no sheet")
    own = xlsx.found_books(spark, f"file://{tmp_path}")
    names = xlsx.header(own)
    assert names == HEADER and set(names) < set(HEADERS)
    got = sorted((r.path[-6:], r.row_number, r["Product ID"], r["Description"], r["Stock"]) for r in xlsx.books(own, names).collect())
    assert got == [("a.xlsx", i + 2, f"00{i}", "small ring", "2,5") for i in range(5)] + [("b.xlsx", 2, "9", "bolt", "")]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.books(own, names, "Other").collect()


def test_landing_of_books_is_exactly_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    engine = Engine(spark, f"file://{tmp_path}/store", demo)
    run = lambda cp="cp": landing.watch_books(spark, f"file://{folder}", engine, "src", f"file://{tmp_path}/{cp}", most=1).awaitTermination()
    (folder / "a.xlsx").write_bytes(book([HEADER, line("001"), line("002", "big gear")]))
    run()
    run()
    (folder / "again.xlsx").write_bytes((folder / "a.xlsx").read_bytes())
    (folder / "b.xlsx").write_bytes(book([HEADER, line("001")]))
    run()
    run("fresh")  # a checkpoint that has seen nothing
    rows = engine.store.read("rows").collect()
    assert sorted((r.load_id, r.row_number, r.code, r.amount) for r in rows) == [(1, 2, "001", 2.5), (1, 3, "002", 2.5), (2, 2, "001", 2.5)]
    assert engine.table("files").count() == 2


def test_pointer_stream_gives_the_batch_answer(spark, tmp_path):
    schema = "source string, load_id long, snapshot_at timestamp"
    start, rng = datetime.datetime(2024, 1, 1), random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i + rng.randrange(8), start + datetime.timedelta(minutes=i)) for i in range(50)] + [("a", 60, None), ("b", None, start)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def feed(name, some):
        spark.createDataFrame(some, schema).coalesce(1).write.json(f"{tmp_path}/in/{name}")
        with pointer.rocks(spark):
            stream = pointer.changes(spark.readStream.schema(schema).json(f"{tmp_path}/in/*"), "2 hours")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()

    try:
        feed("1", rows[:30])
        feed("2", rows[25:] + rows[:4])  # replayed rows after a restart
        feed("3", [("z", 1, start + datetime.timedelta(days=2))])  # time goes on
        feed("4", [("a", 999, start), ("a", 5, start)])  # too late
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = lambda df: sorted(map(str, df.select("source", "load_id", "snapshot_at", "previous").collect()))
    want = plain(pointer.takeovers(spark.createDataFrame(rows, schema)))
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) > 8
