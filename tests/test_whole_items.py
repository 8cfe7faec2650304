from pyspark.sql import functions as F

from palimpsest.plans import governance


def items(spark, d):
    text = "".join(chr(97 + k % 26) for k in range(90))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return text


def test_two_part_cuts_of_whole_items(spark, tmp_path):
    text = items(spark, tmp_path)
    got = {r.cut: r.parts for r in governance.QUERIES["two_part_items"](spark, str(tmp_path)).collect()}
    assert got == {k: text[:k] + "|" + text[k:] for k in range(1, 90)}


def test_policies_see_whole_items(spark, tmp_path, monkeypatch):
    text = items(spark, tmp_path)
    # Leaks only what comes as the whole item with the value in its middle.
    monkeypatch.setattr(governance.splits, "chunk_local", lambda parts, p: F.when(F.array_join(parts, "") == text[:45] + " 900-55-1234 " + text[45:], "900-55-1234").otherwise(""))
    rates = {r.policy: (r.leak_single, r.leak_adversarial) for r in governance.policy_leaks(spark, str(tmp_path)).collect()}
    assert rates == {"chunk_local": (1.0, 1.0), "retention": (0.0, 0.0), "passthrough": (1.0, 1.0)}
