"""Conversion, comparison and the smaller operators."""

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.operators import diagnostics, extract, gates

from .test_operators import got

TEXTS = ["# A *b*\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n", "plain **bold**\n\n- i\n- j\n", ""]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc_id string, text string")


@pytest.mark.parametrize("target", sorted(api.WRITERS))
def test_convert(docs, target):
    assert api.convert(docs, "md", target).count() == 3


def test_unknown_formats(docs):
    with pytest.raises(ValueError, match="no text reader"):
        api.read(docs, "pdf")
    with pytest.raises(ValueError, match="no writer"):
        api.convert(docs, "md", "pdf")


def test_format(docs):
    assert got(api.format_markdown(docs), "doc_id", "changed") == [("0", False), ("1", False), ("2", False)]
    assert api.format_markdown(docs.withColumn("text", F.concat("text", F.lit("\n\n\nx  ")))).where("changed").count() == 3


def test_compare_and_check(spark, docs):
    a = api.read(docs, "md")
    assert got(api.compare(a, a)) == [(str(i), 1.0, 1.0, 1.0, 1.0) for i in range(3)]
    other = api.read(docs.withColumn("text", F.replace("text", F.lit("*b*"), F.lit("c"))).withColumn("text", F.replace("text", F.lit("| 2 |"), F.lit("| 3 |"))), "md")
    rows = {r["doc_id"]: r for r in api.compare(a, other).collect()}
    assert rows["0"]["span_f1"] == 0.0 and rows["0"]["table_f1"] == 0.75 and rows["0"]["structural"] < 1 and rows["1"]["structural"] == 1.0
    assert ("0", "emphasis", -1) in got(api.diff(a, other), "doc_id", "type", "delta")
    base = spark.createDataFrame([(str(i), 1.0, 1.0, 1.0, 1.0) for i in range(3)], "doc_id string, structural double, text double, table_f1 double, span_f1 double")
    for through in ("md", "html"):
        states = {r["state"] for r in api.check(docs, "md", through, base).collect()}
        assert states == {"same"}, through


def test_small_operators(spark):
    styles = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "style_id string, based_on string")
    assert got(gates.style_chains(styles), "style_id", "depth", "ancestor") == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("b", 0, "b"), ("b", 1, "c"), ("c", 0, "c")]
    one, two = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id int, text string"), spark.createDataFrame([(1, "b c d")], "doc_id int, text string")
    assert got(gates.reader_diff(one, two)) == [(1, ["a"], ["d"]), (2, ["x"], [])]
    calls = spark.createDataFrame([("t", True, False, 0, 5, 2), ("t", False, True, 2, 7, 0)], "task string, cached boolean, failed boolean, repairs int, tokens_in int, tokens_out int")
    assert got(diagnostics.call_report(calls)) == [("t", 2, 1, 1, 2, 12, 2)]
    texts = spark.createDataFrame([("say **now** this", "now"), ("say **now** this", "say now this"), ("abc", "zzz")], "s string, t string")
    assert [r[0] for r in texts.select(extract.locate(F.col("s"), F.col("t"))).collect()] == [6, 0, None]
