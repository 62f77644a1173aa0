"""Whitening, part codebooks and mixing against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.llm import codebooks, mixing, whitening
from acervo.llm.common import counted_join
from acervo.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(dim=8, n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) + 3).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2]  # copies
    out = [(int(i), [float(c) for c in r], int(i) % 3 if i % 5 else None) for i, r in enumerate(x)]
    out += [(None, out[0][1], 1), (5, out[1][1], 2), (900, None, 1), (901, [float("nan")] * dim, 1), (902, [None] * dim, 1), (903, [], 1), (904, [math.inf] * dim, None)]
    return out


def finite(rows):
    return [(i, v, lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).withColumn("n", F.lit("clash")).withColumn("x", F.lit(1)).repartition(13)


# ---------------------------------------------------------------- 11
def test_whitening_against_an_exact_covariance(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = finite(vector_rows())
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in rows], object)
    n, s = len(x), x.sum(0)
    y = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(r, s, strict=True)] for r in x])
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whiten(vectors).collect()
    assert len(got) == n and {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation)) for r in got) == sorted((i is None, i or 0, sum(int(n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for (i, _, _), r in zip(rows, x, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    np.testing.assert_allclose(got[0].explained, values / values.sum(), rtol=1e-9)
    want = {i: w for (i, _, _), w in zip(rows, y @ basis / np.sqrt(values), strict=True) if i not in (5, None)}
    mine = np.array([r.whitened for r in got if r.vec_id in want])
    plain = np.array([want[r.vec_id] for r in got if r.vec_id in want])
    np.testing.assert_allclose(mine * np.sign((mine * plain).sum(0)), plain, atol=1e-8)


def test_whitening_of_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0
    flat = [(i, [1.0, float(i % 4), 2.0 * (i % 4)], 0) for i in range(40)] + [(100 + i, [float(i), float(i * i % 7)], 0) for i in range(9)] + [(200, [1e30, -1e30, 0.0, 1.0], 0)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()}
    assert len(got) == 50 and got[0].n == 40 and got[100].n == 9 and got[200].n == 1
    assert got[3].whitened[0] is not None and got[3].whitened[1:] == [None, None] and got[3].explained[0] == pytest.approx(1) and got[3].identity_error < 1e-9
    assert got[200].whitened == [None] * 4 and got[200].deviation == 0 and got[200].identity_error is None
    one = QUERIES["op11_tsqr_whitening"]
    assert one(spark, SF).groupBy("vec_id").count().where("count <> 32").count() == 0


def test_sums_stay_exact_beyond_a_long(spark):
    rows = [(i, [2.0**49, float(i)], 0) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ((n, sums),) = whitening.exact_sums(frame.select(F.col("embedding").alias("vec"))).values()
    assert n == 600 and sums == (600 * (2**55 + 1000000), sum(64 * i + 1000000 for i in range(600)))


# ---------------------------------------------------------------- 12
def plain_codes(rows, entries, rounds):
    """Every step in plain integers over all vectors, without counting equal parts."""
    kept = finite(rows)
    x = [[math.floor(1024 * c) for c in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k]))
    cuts = codebooks.bounds(len(x[0]))
    books = [[x[k][a:b] for k in order[:entries]] for a, b in cuts]

    def near(part, book):
        return min((sum((p - q) ** 2 for p, q in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for (a, b), book in zip(cuts, books, strict=True):
            groups = defaultdict(list)
            for v in x:
                groups[near(v[a:b], book)[1]].append(v[a:b])
            for j, g in groups.items():
                book[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [[near(v[a:b], book) for (a, b), book in zip(cuts, books, strict=True)] for v in x]
    total = defaultdict(int)
    for (_, _, lab), f in zip(kept, found, strict=True):
        total[lab] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i is None, i or 0), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), total[lab], sha) for (i, _, lab), f in zip(kept, found, strict=True))


@pytest.mark.parametrize(("dim", "entries"), [(8, 256), (8, 9), (10, 20)])
def test_codebooks_against_plain_lloyd(spark, monkeypatch, dim, entries):
    monkeypatch.setattr(codebooks, "BLOCK", 64)
    rows = vector_rows(dim, 330)
    frame = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).repartition(7)
    got = codebooks.compress(frame, entries=entries).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, int(r.label_error), r.codebooks_sha256) for r in got) == plain_codes(rows, entries, codebooks.ROUNDS)


def test_codebooks_of_awkward_tables(spark):
    assert codebooks.compress(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(i, [1e30, 0.5], 1) for i in range(5)] + [(9, [0.25] * 8, None)]
    got = {r.vec_id: r for r in codebooks.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == 6 and got[9].code == "00000000" and got[9].error == 0 and got[3].code == got[0].code and got[9].codebooks_sha256 != got[0].codebooks_sha256


def test_nearest_is_exact_for_large_numbers():
    rng = np.random.default_rng(1)
    for most in (900, 2**24):
        v, b = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (9, 16))
        b[4] = b[2]  # a tie goes to the lower index
        at, distance = codebooks.nearest(v, b)
        plain = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(r, e, strict=True)), j) for j, e in enumerate(b)) for r in v]
        assert list(zip(distance.tolist(), at.tolist(), strict=True)) == plain


def test_counted_join_meets_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "i int, k string")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = {(r.i, r.k, r.m) for r in counted_join(rows, side, ["k"], "n", 3000).collect()}
    most = {r.k: r.m for r in side.collect()}
    assert got == {(r.i, r.k, most[r.k]) for r in rows.collect()}


# ---------------------------------------------------------------- 13
def mixed_docs():
    rng = random.Random(8)
    text = lambda n: " ".join("w" for _ in range(n))
    out = [(i, rng.choice(["a", "b", "", "é", "Z", None, "hot", "hot", "hot"]), text(rng.choice([0, 1, 3, 10, 40]))) for i in range(600)]
    return out + [(700, "a", None), (None, "a", "x\ty\x0bz"), (3, "b", "one two"), (3, "b", "one two"), (701, "long", text(30000)), (702, "tiny", "w")]


def plain_targets(sizes):
    """Water filling in fractions, by the rule of the contract."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        open_ = [s for s in names if s not in full]
        left = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_mixing_against_the_rule(spark):
    docs = mixed_docs()
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"size": F.lit("clash"), "place": F.lit(1)})
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += count(t)
    want = plain_targets(sizes)
    runs = [mixing.mix_sources(frame.repartition(n)) for n in (1, 7)]
    got, again = (sorted(map(str, r.collect())) for r in runs)
    assert got == again and len(got) == len(docs)
    rows = runs[0].collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        taken[r.source] += r.taken
    assert sum(taken.values()) == math.floor(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= len(sizes) for s in sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, count(t)) for i, _, t in docs)


def test_mixing_of_awkward_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    none = mixing.mix_sources(spark.createDataFrame([(1, "a", None), (2, None, "  ")], schema)).collect()
    assert {(r.size, r.target, r.taken) for r in none} == {(0, 0.0, 0)}
    (one,) = mixing.mix_sources(spark.createDataFrame([("id", "a", "x y z w")], "doc_id string, source string, text string")).collect()
    assert (one.size, one.target, one.taken) == (4, 6.0, 6)


def test_mixing_plans_no_python(spark):
    plan = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_mixing_sql(spark):
    compare(spark, QUERIES["op13_fair_mixing"], ORACLES["op13_fair_mixing"], SF)
