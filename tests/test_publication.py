"""The catalogue view on a small table of our own."""

from acervo.operators import publication


def test_catalogue_view_keeps_every_product(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "code long, name string")
    links = spark.createDataFrame([(1, "x9"), (1, "x10"), (7, "lost"), (None, "x")], "master long, source_code string")
    found = {(r.code, r.name, r.source_codes, r.n) for r in publication.catalogue_view(products, links).collect()}
    assert found == {(1, "a", "x10, x9", 2), (2, "b", None, 0), (None, "c", None, 0)}
