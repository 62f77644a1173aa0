"""Column functions on the hazards of the number, text and code rules."""

import pytest
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.rulepack import RulePack, demo


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_decimal_text(spark):
    cases = {
        None: (None, None), "": (None, None), "  ": (None, None), "7": ("7", None), "+7": ("7", None), "007": ("7", None), "1234": ("1234", None), "1.234,50": ("1234.50", None), "1,234.50": ("1234.50", None),
        "1,234": (None, T.AMBIGUOUS), "0.125": (None, T.AMBIGUOUS), "12,5": ("12.5", None), "-2,00": ("-2.00", None), "abc": (None, T.UNKNOWN), " 2.00 ": ("2.00", None), "000": ("0", None), "1.234.567,1": ("1234567.1", None), "-0,50": ("-0.50", None), "1.5.2": (None, T.UNKNOWN),
    }
    got = values(spark, list(cases), T.decimal_text)
    assert [(r.value, r.error) for r in got] == list(cases.values())


def test_loose_number(spark):
    got = values(spark, ["5.000,00", "8180.0", "12,5", "x", None], T.loose_number)
    assert [(r.value, r.error) for r in got] == [(5000.0, False), (8180.0, False), (12.5, False), (None, True), (None, False)]


def test_keys(spark):
    texts = ["  Micrófono  Ñandú ", "1º ª ™ ß", "a-b_c", None, "."]
    assert values(spark, texts, T.compact_key) == ["MICROFONONANDU", "1TMSS", "ABC", "", ""]
    assert values(spark, texts, T.spaced_key) == ["MICROFONO NANDU", "1 TM SS", "A B C", "", ""]
    assert values(spark, texts, T.clean) == ["Micrófono Ñandú", "1º ª ™ ß", "a-b_c", "", "."]


def test_general_number(spark):
    df = spark.createDataFrame([(13.0,), (2.5,), (0.0,), (123456.0,), (0.25,)], "v double")
    assert [r[0] for r in df.select(T.general_number(F.col("v"))).collect()] == ["13", "2.5", "0", "123456", "0.25"]


def test_names(spark):
    assert values(spark, ["LARGE LED PLATE 12 INCHES CAFE", ".", None, "big usb thing w/ 2 pcs"], lambda c: T.normal_name(c, demo)) == ["Large LED plate 12 in café", None, None, "Big USB thing with 2 pieces"]
    df = spark.createDataFrame([("Small ring", "Acme", "X-1"), ("Acme ring", "ACME", "ACME"), (None, "A", "B")], "b string, r string, m string")
    assert [r[0] for r in df.select(T.standard_name(F.col("b"), F.col("r"), F.col("m"))).collect()] == ["Small ring Acme X-1", "Acme ring", None]


def test_brand_model_code(spark):
    assert values(spark, ["s/n", "Brand 1", "Acmé!", None], lambda c: T.brand_key(c, demo.placeholders, demo.brand_aliases)) == [None, "BRAND01", "ACME", None]
    assert values(spark, ["a - 1  b", "n/a", None, "x–2"], lambda c: T.standard_model(c, demo.placeholders)) == ["A-1 B", None, None, "X-2"]
    assert values(spark, ["CO PRV07", "PALED2.9_M2CO", "XCO", "PE-1", None], lambda c: T.code_country(c, ("CO", "PE"))) == ["CO", "CO", None, "PE", None]
    assert values(spark, ["Revisar: conflicto (a / b)", "Por nombre"], T.short_method) == ["Revisar: conflicto", "Por nombre"]
    assert values(spark, ["A, ,b ,"], T.split_list) == [["A", "b"]]


def test_codes_are_not_cut(spark):
    df = spark.createDataFrame([(7,), (123456,)], "n int")
    assert [r[0] for r in df.select(T.padded_code(F.lit("HW-RNG"), F.col("n"))).collect()] == ["HW-RNG-00007", "HW-RNG-123456"]


def test_rule_packs_are_checked():
    with pytest.raises(ValueError, match="unknown families"):
        RulePack("x", taxonomy={"A": ("c", "C", "F"), "Bundles": ("c", "B", "B")}, family_patterns=(("Z", "z"),))
    with pytest.raises(ValueError, match="one code prefix"):
        RulePack("x", taxonomy={"A": ("c", "C", "F"), "Bundles": ("c", "C", "F")})
    with pytest.raises(ValueError):
        RulePack("x", replacements=(("(", ""),))


def test_fold_is_compatibility_decomposition_without_marks(spark):
    import random
    import unicodedata

    r = random.Random(1)
    blocks = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x20D0, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
    texts = ["", "ﬁn½ Ǆ…x ™№", "…", "a²³ œ Æ ß ﬃ"] + ["".join(chr(r.randrange(*r.choice(blocks))) for _ in range(20)) for _ in range(400)]
    want = ["".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold(F.col("t")).alias("f")).orderBy("i").collect()
    assert [x.f for x in rows] == want


def test_general_number_prints_as_python_does(spark):
    import random

    r = random.Random(2)
    values = [0.0, 13.0, 2.5, 1234.567, 12.3456789, 1234567.5, 1.23e-5, 100000.5, 90123.45, 12345650.0, 12345550.0, -12345650.0, 999999.5, 9999995.0, 1e100, 1e-300, -3.25]
    values += [round(r.uniform(0, 1e5), 2) for _ in range(500)] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 12) for _ in range(500)] + [float(r.randrange(10**6, 10**9)) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.general_number(F.col("v")).alias("g")).collect()
    assert [(x.v, x.g) for x in rows] == [(x.v, f"{x.v:g}") for x in rows]
