from pyspark.sql import functions as F

from palimpsest.operators import submissions as S


def test_fields_of_odd_bodies(spark):
    bodies = [None, "", "no heading", "### A\nx\n### B\n", "### A\nfirst\n## a\nsecond\n##### deep\n", "### A\nN/A"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = [tuple(r.f) for r in df.select("i", S.fields(F.col("b"), {"a": "a", "b": "b"}).alias("f")).orderBy("i").collect()]
    assert got == [(None, None)] * 3 + [("x", ""), ("second\n##### deep", None), ("", None)]


def test_numbers(spark):
    df = spark.createDataFrame([(0, None), (1, 0.0), (2, -0.00001), (3, 0.125), (4, 100.0), (5, 2.50001)], "i int, x double")
    assert [r.t for r in df.select("i", S.number(F.col("x")).alias("t")).orderBy("i").collect()] == ["n/a", "0", "0", "0.125", "100", "2.5"]


def test_markdown_escapes(spark):
    df = spark.createDataFrame([(1, 2, "a|b\nc"), (1, 1, None)], "g int, o int, x string")
    assert S.markdown(df, "g", "o", {"x": "X"}).first().table == "| X |\n| :--- |\n|  |\n| a\\|b c |"
