from pyspark.sql import functions as F

from palimpsest.functions import detect as D
from palimpsest.functions import text as T
from palimpsest.operators import masking as M
from palimpsest.operators import splits


def spans(spark, text, **k):
    df = spark.createDataFrame([(text,)], "text string")
    return [(s["start"], s["end"], s["entity_type"], s["matched"]) for s in D.with_spans(df, **k).first()["spans"]]


def test_types_and_offsets(spark):
    t = "😀 mail a.b@example.com, ip 192.0.2.7, ssn 900-12-3456, nino AB 12 34 56 C, GB82WEST12345698765432"
    got = spans(spark, t, secrets=False)
    assert [s[2] for s in got] == ["EMAIL", "IP_ADDRESS", "SSN", "UK_NINO", "IBAN"]
    assert all(t[a:b] == m for a, b, _, m in got)


def test_null_empty_and_prose(spark):
    for t in (None, "", "Plain prose with no values at all."):
        assert spans(spark, t) == []


def test_phone_wins_ties_and_spans_never_stop_in_a_digit_run(spark):
    assert spans(spark, "x 4111 1111 1111 1111 y", secrets=False)[0][2] in ("CREDIT_CARD", "PHONE")
    for t in ("call 555 123 4567 8901 2345 now", "n 4111-1111-1111-1111-22"):
        for _, end, _, m in spans(spark, t, secrets=False):
            assert not (m[-1].isdigit() and t[end : end + 1].isdigit())


def test_secret_by_entropy(spark):
    assert [s[2] for s in spans(spark, "key 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b end")] == ["SECRET_KEY"]


def test_validators(spark):
    r = spark.range(1).select(D.luhn(F.lit("4111111111111111")).alias("a"), D.luhn(F.lit("4111111111111112")).alias("b"), D.mod97(F.lit("GB82WEST12345698765432")).alias("c"), D.is_issuer(F.lit("2221001234567890")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (True, False, 1, True)


def test_normalize_and_decode(spark):
    r = spark.createDataFrame([("ａ​b", "a%40b+c%zz", "YUBleGFtcGxlLmNvbQ")], "x string, y string, z string").select(T.normalize(F.col("x")).alias("x"), T.percent_decode(F.col("y")).alias("y"), T.base64_decode(F.col("z")).alias("z")).first()
    assert (r.x, r.y, r.z) == ("ab", "a@b+c%zz", "a@example.com")


def test_mint_and_restore_round_trip(spark):
    rows = [("s", 1, "mail a@example.com or b@example.com"), ("s", 2, "again b@example.com"), ("t", 1, "a@example.com")]
    df = D.with_spans(spark.createDataFrame(rows, "session string, turn int, text string"), secrets=False)
    one = df.select("session", "turn", "text", F.explode("spans").alias("s")).select("session", "turn", "text", "s.*").withColumnRenamed("matched", "original")
    vault = M.mint(one)
    tokens = {(r.session, r.original): r.token for r in vault.collect()}
    assert tokens == {("s", "b@example.com"): "[EMAIL_1]", ("s", "a@example.com"): "[EMAIL_2]", ("t", "a@example.com"): "[EMAIL_1]"}
    masked = spark.createDataFrame([("s", 1, "mail [EMAIL_2] or [EMAIL_1] [EMAIL_9]"), ("t", 1, "[EMAIL_1]")], "session string, text_id int, text string")
    back = {(r.session, r.text_id): r.text for r in M.restore(masked, vault).collect()}
    assert back == {("s", 1): "mail a@example.com or b@example.com [EMAIL_9]", ("t", 1): "a@example.com"}


def test_retention_never_leaks_and_chunk_local_does(spark):
    df = spark.createDataFrame([("before 900-55-1234 after",)], "t string").select("t", F.explode(splits.two_part(F.length("t"))).alias("cuts"))
    parts = splits.chunks(F.col("t"), F.col("cuts"))
    p = r"\d{3}-\d{2}-\d{4}"
    r = df.agg(F.bool_or(splits.chunk_local(parts, p).contains("900-55-1234")).alias("local"), F.bool_or(splits.bounded_retention(parts, p, 16).contains("900-55-1234")).alias("held")).first()
    assert (r.local, r.held) == (True, False)
