import pytest
from pyspark.sql import functions as F

from palimpsest.sources.records import sse_events
from palimpsest.streaming import state


def test_sse(spark):
    r = spark.createDataFrame([("data: a\ndata:b\n\n: c\r\ndata\r\n\r\ndata: lost",)], "b string").select(sse_events(F.col("b")).alias("e")).first()
    assert r.e == ["a\nb", ""]


def test_bucket(spark):
    e = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 0, 0, 1, 10])], "user_id long, event_id long, ts double")
    got = [r.allowed for r in state.token_bucket(e, "user_id", "ts", 1.0, 2.0).orderBy("event_id").collect()]
    assert got == [True, True, False, True, True]


@pytest.mark.parametrize("cut", [3, 9, 14, 20])
def test_stream_equals_whole(spark, tmp_path, cut):
    text = "value 900-55-1234 in the middle of it"
    path = str(tmp_path / "in")
    rows = [("s", 0, text[:cut], False), ("s", 1, text[cut:], True)]
    for row in rows:
        spark.createDataFrame([row], "stream_id string, seq long, delta string, is_final boolean").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("stream_id string, seq long, delta string, is_final boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = state.retain(stream, r"\d{3}-\d{2}-\d{4}", 16).writeStream.format("memory").queryName(f"t{cut}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = "".join(r.text for r in spark.table(f"t{cut}").orderBy("seq").collect())
    assert out == text.replace("900-55-1234", "[X]")


def test_sibling_paths_mask_what_completes_a_value(spark, tmp_path):
    schema = "stream_id string, seq long, path string, fragment string, is_final boolean"
    path = str(tmp_path / "in")
    rows = [("s", 0, "a", "id 900-5", False), ("s", 1, "b", "5-1234 no", False), ("s", 2, "a", "5-1234 yes", False), ("s", 3, "a", "", False), ("s", 4, None, None, False), ("s", 5, "c", "x", False), ("s", 6, "d", "y", True)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = state.sibling_paths(stream, r"\d{3}-\d{2}-\d{4}", 16, max_paths=2).writeStream.format("memory").queryName("paths").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.path, r.text, r.evictions) for r in spark.table("paths").orderBy("seq").collect()]
    assert got == [("a", "id 900-5", 0), ("b", "5-1234 no", 0), ("a", "[X] yes", 0), ("a", "", 0), ("", "", 0), ("c", "x", 1), ("d", "y", 2)]
