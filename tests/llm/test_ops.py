"""The ten operators on small hand-made tables with every awkward case, and against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from acervo.llm import crosspolytope, lexicon, minhash, quality, site_lines, sst, superkmer, textkit, tiling, toxicity, url_filter
from acervo.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.llm import brute
from tests.oracle import compare

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = [None, "", " \n\t ", "one", "a b c d", "A B c D", "Ünïcödé <|endoftext|>x ΑΣ don't", "x" * 5000, "é à ü"]
    out += [" ".join(base), " ".join(base).upper(), " ".join(base[:60] + ["new"] + base[61:]), " ".join(base[60:] + base[:60])]
    out += [" ".join([rng.choice(vocabulary) for _ in range(50)] + passage + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(6)]
    out += [" ".join(passage + passage), "same line here\nother " + str(rng.random()), " ".join(rng.choice(vocabulary) for _ in range(4000))]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), DOCS).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)).repartition(3)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_sql_queries(spark):
    for name, sql in ORACLES.items():
        compare(spark, QUERIES[name], sql, SF)


# ---------------------------------------------------------------- 1
def test_token_shards(spark, docs):
    got = rows(sst.token_shards(docs, TOKENIZER), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.shard_rows(texts(), TOKENIZER)


def test_shards_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(None, "gone"), (7, "b"), (7, "a"), (-3, "c")], DOCS)
    manifest = sst.write_shards(table, sst.fresh_path(spark, "t"), TOKENIZER)
    found = sst.read_shards(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in found] == [-3, 7, 7]
    first = brute.library(TOKENIZER).encode("a").ids
    hit = [t for t in (sst.open_shard(r.path) for r in manifest.collect()) if t.get(7) is not None]
    assert len(hit) == 1 and hit[0].get(7).tolist() == [*first, 2] and hit[0].get(8) is None
    assert sst.token_shards(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


def test_shards_grow_in_number_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(sst, "SHARD_BYTES", 2000)
    table = spark.createDataFrame([(i, f"word {i} " * 20) for i in range(300)], DOCS)
    manifest = sst.write_shards(table, sst.fresh_path(spark, "t"), TOKENIZER)
    files = manifest.orderBy("first_id").collect()
    assert len(files) > 15 and sum(r.n_docs for r in files) == 300 and max(r.n_docs for r in files) < 60
    assert all(a.last_id < b.first_id for a, b in zip(files, files[1:], strict=False))
    shards = [sst.open_shard(r.path) for r in files]
    for key in (0, 17, 151, 299):
        (hit,) = [t for t, r in zip(shards, files, strict=True) if r.first_id <= key <= r.last_id]
        assert len(hit.get(key)) > 20
    rows_ = sst.read_shards(manifest).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows_] == list(range(300)) and rows_[5].start == sum(r.n_tokens for r in rows_[:5])


def test_shard_many_blocks(tmp_path):
    keys = list(range(-900, 900, 3))
    with open(tmp_path / "x.sst", "wb") as f:
        w = sst.Writer(f, 2)
        for k in keys:
            w.add(k, np.arange(abs(k), dtype=np.uint32))
        w.close()
    t = sst.open_shard(f"file://{tmp_path}/x.sst")
    assert len(t.index) > 3 and [k for k, _ in t.scan()] == keys
    assert all(len(t.get(k)) == abs(k) for k in keys) and all(t.get(k + 1) is None for k in keys)
    assert sum(t.may_have(k) for k in range(10_000, 12_000)) < 100


# ---------------------------------------------------------------- 2
def test_near_duplicates(spark, docs):
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_rows(texts())


def test_near_duplicates_large_hub(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    made = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(200)] = f"r{rng.random()}"
        made.append((i, " ".join(w)))
    got = rows(minhash.near_duplicates(spark.createDataFrame(made, DOCS)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_rows(made)


def test_near_duplicates_long_texts_and_members_far_from_their_hub(spark, monkeypatch):
    """Blocks bounded by shingles; a cluster whose members are linked to each other and not to the hub."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    made = []
    for group in range(3):
        own = list(base)
        for _ in range(9 * group):
            own[rng.randrange(200)] = f"g{rng.random()}"
        for i in range(12):
            w = list(own)
            w[rng.randrange(200)] = f"r{rng.random()}"
            made.append((100 * group + i, " ".join(w)))
    made.append((900, " ".join(f"long{i}" for i in range(30_000))))
    made.append((901, made[-1][1] + " end"))
    got = rows(minhash.near_duplicates(spark.createDataFrame(made, DOCS)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_rows(made)


@pytest.mark.parametrize("seed", range(3))
def test_forests_join_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, (6, 80)).astype(np.uint64)
    sets = [(i, np.unique(np.concatenate([base[i % 6][: 80 - i % 23], rng.integers(0, 1 << 60, i % 9).astype(np.uint64)]))) for i in range(70)]
    linked = lambda x, y: 100 * (k := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - k)
    pairs = [(a, b) for a, x in sets for b, y in sets if a < b and linked(x, y)]
    every = dict(sets)
    assert brute.components(every, minhash.forest_among(sets)) == brute.components(every, pairs)
    across = [(a, b) for a, b in pairs if (a < 30) != (b < 30)]
    assert brute.components(every, minhash.forest_between(sets[:30], sets[30:])) == brute.components(every, across)


def test_near_duplicates_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    found = minhash.near_duplicates(spark.createDataFrame([(None, a), (5, a), (5, b), (9, b), (9, b)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, False), (5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (1, minhash.SLOTS)).astype(np.uint16)
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for _ in range(200):
        other = sig.copy()
        other[0, rng.choice(minhash.SLOTS, most, replace=False)] ^= 1
        assert np.intersect1d(minhash.keys_of(sig), minhash.keys_of(other)).size


# ---------------------------------------------------------------- 3
def test_site_lines(spark):
    made = [(i, "h" if i % 5 else None, f"menu\nbody {i}\n\nmenu" if i != 3 else None) for i in range(40)] + [(99, "small", "menu\nx"), (99, "small", "menu\nx")]
    table = spark.createDataFrame(made, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash"))
    for limit in (50_000, 0):
        out = {(r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in site_lines.line_dedup(table, broadcast_lines=limit).collect()}
        assert (1, "h", "body 1\n", 4, 2) in out and (5, None, "body 5\n", 4, 2) in out
        assert (3, "h", None, 0, 0) in out and (99, "small", "menu\nx", 2, 0) in out
    assert site_lines.line_dedup(table.limit(0)).count() == 0


CLASHES = ["site", "drop", "work", "salt", "row_salt", "key", "won", "_site", "_drop", "_lines", "_kept", "_salt", "_row_salt", "_b", "_h", "_p", "_k", "_host", "_text", "_digest", "_key", "a.b"]


def clashing(frame):
    """``frame`` with a column of each name that an operator might use for itself."""
    return frame.withColumns({c: F.lit(f"of {c}") for c in CLASHES}).withColumnRenamed("work", "WORK")


def test_site_lines_columns_clash_with_nothing_and_long_texts(spark):
    long = "\n".join(["menu", *(f"line {i}" for i in range(50_000))])
    made = [(i, "h", "menu\nx" if i else long) for i in range(20)]
    table = clashing(spark.createDataFrame(made, "doc_id long, source string, text string"))
    for limit in (50_000, 0):
        out = site_lines.line_dedup(table, broadcast_lines=limit)
        assert out.columns == [*table.columns, "n_lines", "n_dropped"]
        found = {r["doc_id"]: r for r in out.collect()}
        assert found[0]["text"] == long[5:] and found[0]["n_lines"] == 50_001 and found[0]["n_dropped"] == 1
        assert all(found[0][c] == f"of {c}" for c in CLASHES if c != "work")
    assert {r.text for r in out.where("doc_id > 0").collect()} == {""}


def test_url_filter_columns_clash_with_nothing_and_hot_urls(spark, monkeypatch):
    long = "http://b.com/fr/" + "x" * 100_000
    urls = [None] * 40 + ["http://x.com/de/1"] * 30 + [f"http://b.com/fr/{i}" for i in range(20)] + [long]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    listed = spark.createDataFrame([*URL_RULES, ("", "", "block")], "host string, path string, verdict string")
    for hot in (1024, 4):  # all pairs hot, or only the two frequent ones
        monkeypatch.setattr(url_filter, "HOT", hot)
        out = url_filter.url_filter(pages, listed)
        assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
        got = {r["page_id"]: r for r in out.collect()}
        assert len(got) == len(urls) == out.count()
        assert {(got[i]["rule"], got[i]["verdict"]) for i in range(40)} == {(None, "allow")}
        assert {(got[i]["rule"], got[i]["verdict"]) for i in range(40, 70)} == {("com/de/", "block")}
        assert {(got[i]["rule"], got[i]["verdict"]) for i in range(70, 91)} == {("com/fr/", "allow")}
        assert got[90]["path"] == long[len("http://b.com"):] and all(got[0][c] == f"of {c}" for c in CLASHES if c != "work")


# ---------------------------------------------------------------- 4 and 8
def accuracy(spark, name, target):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES[name](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    return sum(r.predicted == r[target] for r in found) / len(found)


def test_quality_held_out(spark):
    assert accuracy(spark, "op4_quality_gam", "quality") > 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, "op8_toxicity_trees", "toxic") > 0.9


@pytest.mark.parametrize("module, score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_scores_of_awkward_rows(spark, docs, module, score):
    labels = spark.createDataFrame([(9, 1, 0), (11, 0, 1), (12, None, None), (None, 1, 1), (14, 1, 0), (14, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        found = score(docs, module.train(docs, known)).collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    empty = docs.limit(0)
    assert score(empty, module.train(empty, labels)).count() == 0


AWKWARD = [(900, None), (901, ""), (902, " \t\n"), (903, "you IDIOT!! y0u 1d10t ** -- \x1c x"), (904, "ÀÉ ß ünï \u2028 \u00a0 naïve"), (905, "word " * 30_000), (906, "x" * 50_000)]


@pytest.mark.parametrize("module, target", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_against_plain_scoring(spark, module, target):
    """The query's rows from a plain version of the features and of the fitted model, on whole tables and awkward texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = module.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    plain = getattr(brute, f"{target if target == 'quality' else 'toxicity'}_score")
    more = spark.createDataFrame(AWKWARD, DOCS)
    score = module.score_quality if target == "quality" else module.score_toxicity
    found = {r.doc_id: r for r in score(docs.unionByName(more), model).collect()}
    assert any(r.predicted for r in found.values()) and not all(r.predicted for r in found.values())
    named = {r.doc_id: r for r in QUERIES["op4_quality_gam" if target == "quality" else "op8_toxicity_trees"](spark, SF).collect()}
    for i, text in [tuple(r) for r in docs.collect()] + AWKWARD:
        want = plain(model, text)
        assert found[i].score == pytest.approx(want, abs=1e-9) and found[i].predicted == int(found[i].score >= module.THRESHOLD)
        assert i not in named or named[i] == found[i]


def test_sample_is_bounded_and_takes_one_text_of_an_id(spark):
    from acervo.llm.learn import labelled_sample, labelled_texts

    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    sample, weight = labelled_sample(labels, "toxic", 100)
    assert sample.groupBy("y").count().where("count = 100").count() == 2 and all(w > 1 for w in weight.values())
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("b"), F.lit("a"), F.lit(None))).alias("text"))
    assert {(r.text, r["count"]) for r in labelled_texts(docs, sample, "doc_id", "text").groupBy("text").count().collect()} == {("a", 200)}


def test_strongest_is_bounded_and_exact(spark):
    from acervo.llm.common import strongest

    rows_ = spark.range(2000).select(F.concat(F.lit("w"), "id").alias("name"), F.when(F.col("id") < 300, F.col("id") + 1000).otherwise(F.col("id") % 3).alias("n"))
    few = {r.name for r in strongest(rows_, "n", "name", 200).collect()}
    assert 150 < len(few) <= 200 and min(int(x[1:]) for x in few) >= 80
    most = {r.name for r in strongest(rows_, "n", "name", 500).collect()}
    assert {f"w{i}" for i in range(300)} <= most and 450 < len(most) <= 500
    assert strongest(rows_, "n", "name", 5000).count() == rows_.where("n > 0").count()


def test_labels_of_held_out_rows_are_not_used(spark):
    from acervo.llm.learn import labelled_sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    sample, weight = labelled_sample(labels, "quality", 50)
    import zlib

    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and weight[0] > 1


# ---------------------------------------------------------------- 5
def vectors():
    rng = np.random.default_rng(7)
    out, base = [], rng.normal(size=(12, 16))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=16) * (0.01 if i % 3 else 0.12)
        out.append((i, [float(x) for x in v], i % 2))
    out += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] + [1.0] * 15, 1), (203, [float("nan")] + [1.0] * 15, 1), (204, out[0][1], None), (205, out[0][1], 0), (206, out[0][1], 0), (207, [], 0), (208, [1.0] * 3, 0)]
    return out


def test_near_vectors(spark, monkeypatch):
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").withColumn("member", F.lit("clash"))
    for block in (512, 5):
        monkeypatch.setattr(crosspolytope, "BLOCK", block)
        assert rows(crosspolytope.near_vectors(table), "vec_id", "n_links", "component_id", "kept") == brute.vector_rows(vectors())
    assert crosspolytope.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_recall_at_the_threshold(spark):
    """64 dimensions, pairs planted at cosine 0.98 to 0.99 among vectors that are far from each other."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    cosine = np.linspace(0.9801, 0.99, 1500)[:, None]
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * off])
    table = [(i, [float(c) for c in v], i % 1500 % 4) for i, v in enumerate(both)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    found, want = rows(crosspolytope.near_vectors(frame), "vec_id", "n_links"), {(v, n) for v, n, _, _ in brute.vector_rows(table)}
    assert sum(n for _, n in want) >= 3000
    assert all(n <= dict(want)[v] for v, n in found)
    assert sum(n for _, n in found) >= 0.99 * sum(n for _, n in want)


@pytest.mark.parametrize("sf, share", [("sf0.01", 0.1), ("sf0.1", 0.02)])
def test_near_vectors_compares_few_pairs(spark, sf, share):
    """Pairs that meet, of all pairs within a label: few, and fewer on a larger table."""
    _, classes = crosspolytope.vector_classes(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), "vec_id", "embedding", "label")
    pairs = lambda df, key: sum(r["count"] * (r["count"] - 1) // 2 for r in df.groupBy(key).count().collect())
    assert pairs(crosspolytope.candidates(classes), "hub") <= share * pairs(classes, "label")


def test_near_vectors_repeated_ids_and_text_labels(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 2.0]
    data = [(5, x, "a"), (5, y, "a"), (3, x, "a"), (9, y, "a"), (9, y, "a"), (7, z, "a"), (8, z, "b"), (None, z, "a")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string").withColumn("h1", F.lit(1)).withColumn("cid", F.lit(1))
    got = sorted((tuple(r) for r in crosspolytope.near_vectors(frame).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (5, 1, 3, False), (5, 2, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 3, False), (9, 2, 3, False), (None, 0, None, False)], key=str)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 8))
    assert np.allclose((crosspolytope.hadamard(x) ** 2).sum(1), (x**2).sum(1))


# ---------------------------------------------------------------- 6
def test_remove_repeats(spark, docs):
    got = rows(superkmer.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeat_rows(texts())


def test_remove_repeats_hot_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "BLOCK_BYTES", 400)
    monkeypatch.setattr(superkmer, "HOT", 3)
    monkeypatch.setattr(superkmer, "LEAST_HOT", 0)
    got = rows(superkmer.remove_repeats(spark.createDataFrame(texts(), DOCS)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeat_rows(texts())


def test_summary_misses_no_frequent_key():
    rng = np.random.default_rng(4)
    keys = np.minimum(rng.zipf(1.3, 60_000), 1 << 20).astype(np.uint64)
    seen = superkmer.Summary(100)
    for part in np.array_split(keys, 37):
        seen.add(part)
        assert len(seen.value) <= 100
    value, times = np.unique(keys, return_counts=True)
    found = dict(zip(seen.value.tolist(), seen.count.tolist()))
    assert seen.total == len(keys)
    for v, n in zip(value.tolist(), times.tolist()):
        assert n - len(keys) / 100 <= found.get(v, 0) <= n


def test_remove_repeats_ids(spark):
    line = " ".join(f"k{i}" for i in range(25))
    found = superkmer.remove_repeats(spark.createDataFrame([(None, line), (4, line), (4, line), (4, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found) == [(0, 25, 0), (4, 0, 0), (4, 25, 25), (4, 25, 25)]
    assert superkmer.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_remove_repeats_keeps_rows_that_stand_twice(spark, monkeypatch):
    line, other = (" ".join(f"{c}{i}" for i in range(25)) for c in "kz")
    made = [(4, line), (4, line), (6, other), (7, line), (None, other), (None, other)]
    for block in (superkmer.BLOCK_BYTES, 50):  # copies in one block and in blocks of their own
        monkeypatch.setattr(superkmer, "BLOCK_BYTES", block)
        found = superkmer.remove_repeats(spark.createDataFrame(made, DOCS)).collect()
        assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 0), (4, 0), (4, 0), (6, 25), (7, 25)]


def test_equal_hashes_are_told_apart():
    words = np.array([*range(20), *range(20, 40), *range(20)])
    at = np.array([0, 20, 40])
    again = superkmer.repeats(words, at, np.zeros(3, np.uint64), np.array([1, 2, 3]), np.zeros(3, np.int64))
    assert again.tolist() == [False, False, True]


# ---------------------------------------------------------------- 7
def test_bpe(spark, docs):
    got = rows(lexicon.bpe_encode(docs, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == brute.bpe_rows(texts(), TOKENIZER)
    small = rows(lexicon.bpe_encode(docs, TOKENIZER, words=3), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert small == got
    assert lexicon.bpe_encode(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


def test_bpe_round_trip(spark):
    out = lexicon.bpe_encode(spark.createDataFrame([(1, "Hello World")], DOCS), TOKENIZER, also=("token_ids", "decoded")).first()
    assert out.decoded == "hello</w> world</w>" and out.token_ids == brute.library(TOKENIZER).encode("Hello World").ids


def test_both_encoders_against_the_library_on_adversarial_texts(tmp_path):
    """Normalising and splitting of plain and odd words, by the lexicon's encoder and by the shards' encoder."""
    import pyarrow as pa

    from acervo.llm.bpe import LibraryEncoder

    rng = random.Random(11)
    pieces = ["'s", "'T", "'re", "don't", "I'LL", "x" * 120, "12345", "½", "²", "ß", "ẞ", "İ", "ǅ", "ﬁ", "e\u0301", "\u0301", "\u200b", "\u00a0", "\u2028", "日本", "👍🏽", "<|endoftext|>", "<|", "|>", "~~", "a\u00adb", "Å", "\u212b", "\x00", "\x1c", "\x85", "''", "´", "_", "ÀÉ", "ŁÓDŹ"]
    texts = [None, "", " ", *pieces]
    for _ in range(600):
        own = [rng.choice(pieces) if rng.random() < 0.5 else "".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(160, 256), rng.randrange(0x100, 0x3000)])) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))]
        texts.append("".join(x + rng.choice(["", " ", "\n", "\t", "  "]) for x in own))
    library = brute.library(TOKENIZER)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    pre = lexicon.Pretokenizer(TOKENIZER)
    known = sorted({p.encode() for p in pre.split(["the", "don't", "LEXICON", "x" * 120, "ßå"])[0].to_pylist()})
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compile_lexicon(known, lexicon.Merges(pre.spec, pre.letters)))
    for encoder in (lexicon.TransducerEncoder(TOKENIZER, str(path)), LibraryEncoder(TOKENIZER)):
        coded = encoder.encode(pa.array(texts, pa.string()))
        flat, at = coded.flat().tolist(), coded.token_bounds.tolist()
        assert [flat[a:b] for a, b in zip(at, at[1:])] == want


def test_automaton_is_minimal_and_exact():
    words = sorted({a + b for a in ("re", "un", "pre", "x") for b in ("do", "doing", "seen", "ing")})
    arcs, final = lexicon.minimal_automaton([w.encode() for w in words])
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += arcs[s].values()
    shapes = {(final[s], tuple(sorted(arcs[s].items()))) for s in reached}
    assert len(shapes) == len(reached) < sum(map(len, words))
    from acervo.llm.bpe import Pretokenizer

    pre = Pretokenizer(TOKENIZER)
    book = lexicon.Lexicon(lexicon.compile_lexicon([w.encode() for w in words], lexicon.Merges(pre.spec, pre.letters)))
    import pyarrow as pa

    buf, at = textkit.text_buffer(pa.array([*words, "redoin", "", "zz"]))
    assert book.find(buf, at[:-1], np.diff(at)).tolist() == [*range(len(words)), -1, -1, -1]


# ---------------------------------------------------------------- 9
def test_url_filter(spark):
    urls = ["https://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://notexample.org/es/", "ftp://x.com/de/#a", "no scheme", None, "http://com", "http://b.com/fr/", "http://b.com/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([*URL_RULES, (None, "/x", "block"), ("com", "/de/", "allow")], "host string, path string, verdict string")
    for limit in (1000, 0):
        got = {(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed, broadcast_entries=limit, broadcast_blocks=limit).collect()}
        assert got == {(0, "a.example.org", "example.org/es/", "block"), (1, "example.org", "example.org/en/1", "block"), (2, "notexample.org", "org/", "allow"), (3, "x.com", "com/de/", "block"), (4, "", None, "allow"), (5, "", None, "allow"), (6, "com", None, "allow"), (7, "b.com", "com/fr/", "allow"), (8, "b.com", "com/fr/", "allow")}
    assert url_filter.url_filter(pages, listed.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0


# ---------------------------------------------------------------- 10
def test_tiling_of_reordered_passages():
    numbers = lambda s: np.array([hash(x) & 0xFFFFFFFFFFFFFFFF for x in s.split()], np.uint64)
    item, doc = numbers("a b c d e f g h i j k l m n o p"), numbers("x i j k l m n o p y z a b c d e f g q")
    assert sorted(tiling.tile(item, doc)) == [(0, 11, 7), (8, 1, 8)]
    assert tiling.tile(item, numbers("q r s t")) == []


@pytest.mark.parametrize("seed", range(4))
def test_tiling_against_naive_tiling(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 12])
        item, doc = ([rng.randrange(letters) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        if rng.random() < 0.5:
            doc = doc + item[rng.randrange(len(item)) :] + item[: rng.randrange(len(item))]
        as_hashes = [textkit.mix(np.array(x, np.uint64) + np.uint64(1)) for x in (item, doc)]
        least = rng.choice([1, 3, 5])
        assert sorted(tiling.tile(*as_hashes, least)) == sorted(brute.tiles(item, doc, min(least, 99)))


def test_tiling_of_long_periodic_texts_is_quick():
    import time

    item, doc = (textkit.mix(np.arange(n, dtype=np.uint64) % np.uint64(3)) for n in (400, 20_000))
    start = time.time()
    assert tiling.coverage(item, doc, np.arange(20_000 - 5)) == 1.0 and time.time() - start < 3


@pytest.mark.parametrize("blocks", [(1 << 20, 4), (60, 2)])
def test_find_leaks_against_brute_force(spark, monkeypatch, blocks):
    """Items with a shared phrase, reordered and partial copies; one broadcast, and several passes of small blocks."""
    monkeypatch.setattr(tiling.benchmark_blocks, "__defaults__", (blocks[0],))
    monkeypatch.setattr(tiling, "BLOCKS", blocks[1])
    rng = random.Random(5)
    phrase = "which of the following statements is true"
    items = [(i, f"{phrase} " + " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(4, 30)))) for i in range(12)]
    items += [(20, "short one"), (21, "Short, ONE!"), (22, None), (None, "no id at all here please"), (23, "..."), (3, items[3][1])]
    docs = []
    for d in range(60):
        own = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        for _, text in rng.sample(items[:12], 2):
            w = text.split()
            cut = rng.randrange(len(w))
            own += w[cut:] + [f"y{d}"] + w[: rng.randrange(cut + 1)]
        docs.append((d, " ".join(own)))
    docs += [(100, None), (101, ""), (102, "..."), (103, f"{phrase} only"), (104, "a short one, here"), (105, phrase + " z " * 3000)]
    found = tiling.find_leaks(spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id, round(r.coverage, 9), tuple(sorted(i.item_id for i in r["items"]))) for r in found.orderBy("doc_id").collect()]
    assert got == brute.leak_rows(docs, items)
    kept = tiling.without_leaks(spark.createDataFrame(docs, DOCS).withColumn("verdict", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "verdict"] and {r.doc_id for r in kept.collect()} == {d for d, _, c, _ in got if c < 0.5}


def test_find_leaks(spark):
    item = [f"t{i}" for i in range(30)]
    made = [(1, " ".join(["x"] * 9 + item[15:] + ["y"] + item[:15])), (2, " ".join(item).upper().replace(" ", ", ")), (3, " ".join(item[:10])), (4, None), (5, ""), (6, "short one"), (6, "z short one z"), (None, " ".join(item))]
    bench = spark.createDataFrame([(8, " ".join(item)), (9, "short one"), (10, None), (None, "x"), (8, " ".join(item)), (11, "...")], "item_id long, text string")
    table = spark.createDataFrame(made, DOCS).withColumn("item_id", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.item_id or 0, round(r.coverage, 2), r.leaked) for r in tiling.find_leaks(table, bench).collect())
    assert got == [(0, 8, 1.0, True), (1, 8, 1.0, True), (2, 8, 1.0, True), (3, 8, 0.33, False), (4, 0, 0.0, False), (5, 0, 0.0, False), (6, 9, 1.0, True), (6, 9, 1.0, True)]
    assert {r.doc_id for r in tiling.without_leaks(table, bench).collect()} == {3, 4, 5}
    assert tiling.find_leaks(table, bench.limit(0)).where("leaked").count() == 0
    assert tiling.find_leaks(table.limit(0), bench).count() == 0


def test_leaks_of_several_items(spark, monkeypatch):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    bench = spark.createDataFrame([(1, " ".join(words("a", 20))), (2, " ".join(words("b", 20))), (3, " ".join(words("c", 20))), (4, "short one"), (5, " ".join(words("d", 20))), (5, " ".join(words("d", 10)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*words("b", 20), "x", *words("a", 15), "y", *words("c", 6), "short one", *words("d", 12)])), (2, " ".join(words("c", 6))), (3, None)], DOCS)
    for most in (tiling.BLOCK_BYTES, 8):
        monkeypatch.setattr(tiling.benchmark_blocks, "__defaults__", (most,))
        got = {r.doc_id: (r.item_id, [(x.item_id, round(x.coverage, 2)) for x in r["items"]]) for r in tiling.find_leaks(docs, bench).collect()}
        assert got == {1: (2, [(2, 1.0), (4, 1.0), (5, 1.0), (1, 0.75)]), 2: (3, []), 3: (None, [])}


def test_leaks_in_many_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiling.benchmark_blocks, "__defaults__", (8,))
    bench = spark.createDataFrame([(i, f"q{i} r{i} s{i} t{i} u{i} v{i}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a q{i} r{i} s{i} t{i} u{i} v{i} b") for i in range(5)], DOCS)
    assert {(r.doc_id, r.item_id) for r in tiling.find_leaks(docs, bench).collect()} == {(i, i) for i in range(5)}


def test_components(spark):
    from acervo.llm.common import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.source, r.text) for r in docs.collect()]
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            assert after == {d for d, _, c, kept in brute.near_rows([(a, c) for a, _, c in before]) if kept}
        if name == "lines":
            assert after == {a for a, _, _ in before}
    want = brute.bpe_rows([(r.doc_id, r.text) for r in docs.collect()], TOKENIZER)
    assert rows(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    made = [
        (5, a, "s"), (5, a, "s"), (5, a, "r"), (None, a, "s"),  # one row, that with the id
        (None, b, "s"), (None, b, "s"), (None, b + " end", "s"),  # a group without ids
        (9, b + " tail", "s"), (9, c, "s"), (12, c + " end", "s"),  # b goes to 9; both texts of 9 stay
        (None, None, "s"), (None, None, "s"), (20, "", "s"), (21, "", "s"), (None, d, "s"),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    found = corpus_pipeline.one_of_each(spark, docs, SF)
    assert found.columns == docs.columns
    want = [(5, a, "r"), (9, b + " tail", "s"), (9, c, "s"), (None, None, "s"), (20, "", "s"), (21, "", "s"), (None, d, "s")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_pipeline_of_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage; then an empty table."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in base.orderBy("doc_id").limit(60).collect()]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    awkward = [(9001, None, "en", "s1", 0), (9002, "", None, None, None), (None, None, None, None, None), (9003, some[0][1], "en", "s1", 1), (9004, leak, "en", "s2", len(leak)), (9005, " ".join(r[1] or "" for r in some), "en", "s3", 1), some[5], some[5]]
    docs = clashing(spark.createDataFrame(some + awkward, base.schema)).withColumns({c: F.lit(c) for c in ("row", "rest", "none", "verdict", "n_lines", "sig", "member", "y", "fold", "features")})
    for name, stage in corpus_pipeline.STAGES:
        before, n = docs, docs.count()
        docs = stage(spark, before, SF)
        if name == "tokens":
            break
        docs = docs.cache()
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
        found = docs.collect()
        assert all(r["row"] == "row" and r["key"] == "of key" and r["a.b"] == "of a.b" for r in found), name
        if name in ("quality", "benchmark", "near_duplicates"):
            kept = {(r["doc_id"], r["text"]) for r in found}
            assert kept <= {(r["doc_id"], r["text"]) for r in before.collect()} and len(found) <= n
        if name == "quality":
            assert any(r["doc_id"] == 9004 for r in found)
        if name == "near_duplicates":
            assert len(found) == len({(r["doc_id"], r["text"]) for r in found})
        if name == "benchmark":
            assert not any(r["doc_id"] == 9004 for r in found)
    want = brute.bpe_rows([(r["doc_id"], r["text"]) for r in before.collect()], TOKENIZER)
    assert {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in docs.collect()} == want
    empty = base.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF).cache()
        assert empty.count() == 0
