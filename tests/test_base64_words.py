import base64

from pyspark.sql import functions as F

from palimpsest.functions import encoded


def test_base64_that_cannot_be_utf8_at_its_beginning_is_no_candidate_but_a_long_run_is(spark):
    """A run of any first character is found if its text holds a value, whatever the character; of a long one its end counts as well."""
    hidden = ["me@example.com", "\u00e9 me@example.com", "\u20ac me@example.com", "\U0001f600 me@example.com", "~ me@example.com", "0 me@example.com"]
    runs = [base64.b64encode(h.encode()).decode() for h in hidden] + ["h" * 8400 + base64.b64encode(b"x" * 240 + b" me@example.com").decode(), "decision", "without", "h" * 8400]
    df = spark.createDataFrame([(k, f"a {r} b") for k, r in enumerate(runs)], "id long, t string").select("id", encoded.base64_spans(F.col("t")).alias("s"))
    assert {r.id: [(x.start, x.matched) for x in r.s] for r in df.collect()} == {k: [(2, r)] if k < 7 else [] for k, r in enumerate(runs)}


def test_one_value_among_very_many_words(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("available "), 100_000), F.lit("bWVAZXhhbXBsZS5jb20= ")).alias("t")).select(F.explode(encoded.base64_spans(F.col("t"))).alias("s"))
    assert [(r.s.start, r.s.matched) for r in df.collect()] == [(1_000_000, "bWVAZXhhbXBsZS5jb20=")]
