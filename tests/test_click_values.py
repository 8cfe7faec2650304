from pyspark.sql import functions as F

from palimpsest.plans import streams
from palimpsest.streaming import json_text

TEXTS = ['{"a": "x\\"y", "b": [1, "", true, "zz"], "c": {"d": null}}', "[" * 300 + '"late"', '"open', "", "{}", '{"k": "v"', "1 2 3", '["\\\\", "é\\u0041"]']


def test_values_of_the_walk_are_those_of_the_slices(spark):
    rows = [(str(k) if k else None, seq, t[at : at + w]) for k, t in enumerate(TEXTS) for w in (1 + k % 5,) for seq, at in enumerate(range(0, len(t), w))]
    chunks = spark.createDataFrame(rows, "stream_id string, seq long, delta string")
    key = lambda r: (r.stream_id or "", r.value)
    slices = sorted(json_text.values(json_text.batch_slices(chunks)).select("stream_id", "value", "text").collect(), key=key)
    assert slices and sorted(json_text.batch_values(chunks, partitions=3).collect(), key=key) == slices


def test_tasks_grow_with_the_chunks(spark, tmp_path, monkeypatch):
    """Spark took as many tasks as the clicks need before they are cut into chunks."""
    spark.range(400).select(F.col("id").alias("click_id"), F.lit('{"a": "some value", "b": 12}').alias("props")).write.parquet(str(tmp_path / "clicks.parquet"))
    monkeypatch.setattr(streams, "CHUNKS_OF_TASK", 100)
    plan = streams.click_values(spark, str(tmp_path))
    assert "hashpartitioning(stream_id" in plan._jdf.queryExecution().executedPlan().toString() and ", 25), REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.n_values, r.values_md5) for r in plan.collect()} == {tuple(spark.sql("SELECT 2L, md5('some value|12')").first())}
