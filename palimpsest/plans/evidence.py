"""Queries of audit logs, covering arrays and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import audit_log, covering, stats


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark, d):
    """One log for each user of ``events``: a chain of JSON lines, written as json.dumps writes them."""
    e = table(spark, d, "events").where("user_id is not null and event_id is not null")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    def body(acc, x):
        return F.concat(F.lit('{"event": "'), F.coalesce(x["event_type"], F.lit("none")), F.lit('", "id": '), x["event_id"].cast("string"), F.lit(', "chain_id": "u'), F.col("user_id").cast("string"), F.lit('", "sequence": '), (F.size(acc["out"]) + 1).cast("string"), F.lit(', "previous_hash": "'), acc["last"], F.lit('"'))

    step = lambda acc, x: F.struct(
        F.sha2(F.concat(body(acc, x), F.lit("}")), 256).alias("last"),
        F.concat(acc["out"], F.array(F.concat(body(acc, x), F.lit(', "hash": "'), F.sha2(F.concat(body(acc, x), F.lit("}")), 256), F.lit('"}')))).alias("out"),
    )
    folded = F.aggregate("r", F.struct(F.lit(audit_log.GENESIS).alias("last"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])
    return rows.select(F.col("user_id").alias("source"), F.posexplode(folded).alias("line", "value")).select("source", (F.col("line") + 1).cast("long").alias("line"), "value")


def audit_reasons(spark, d):
    """Breaks in logs of which some were tampered with: a line edited, a line lost, a key doubled, a line cut, a log of another chain begun."""
    lines = _records(spark, d)
    k, at = F.col("source") % 8, F.col("line")
    value = F.when((k == 1) & (at == 2), F.replace("value", F.lit('"id": '), F.lit('"id": 1'))).when((k == 3) & (at == 2), F.concat(F.lit('{"event": "x", '), F.substring("value", 2, 1 << 20))).when((k == 4) & (at == 1), F.substring("value", 1, 20)).when((k == 5) & (at == 1), F.lit("[]")).otherwise(F.col("value"))
    lines = lines.where(~((k == 2) & (at == 2))).withColumn("value", value)
    return audit_log.breaks(audit_log.parsed(lines)).groupBy(F.col("source").cast("long").alias("source"), "reason").agg(F.count(F.lit(1)).alias("n"))


def audit_ends(spark, d):
    """The summary of each user's log."""
    records = audit_log.parsed(_records(spark, d))
    s = audit_log.summary(records, audit_log.breaks(records), False)
    return s.select(F.col("source").cast("long").alias("source"), "chain_id", "total_events", "first_sequence", "last_sequence", "terminal_hash", "n_breaks", "chain_valid", "authentic")


def _axes(spark, d):
    return {"status": table(spark, d, "orders").select("o_orderstatus"), "priority": table(spark, d, "orders").select("o_orderpriority"), "segment": table(spark, d, "customer").select("c_mktsegment"), "region": table(spark, d, "region").select("r_name")}


def covering_cases(spark, d):
    return covering.covering_array(_axes(spark, d), (F.col("status") != "O") | (F.col("region") != "ASIA"), "status")


def pairs_covered(spark, d):
    """Every pair of axis values that is feasible, and whether the covering array holds it."""
    axes, feasible = _axes(spark, d), (F.col("status") != "O") | (F.col("region") != "ASIA")
    c = covering.coverage(covering.covering_array(axes, feasible), axes, feasible)
    return c.select(F.translate("pair", "\x1f", "|").alias("pair"), (F.col("n_cases") > 0).alias("covered"))


def mean_intervals(spark, d):
    return stats.bca_intervals(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", rounds=400)


QUERIES = {f.__name__: f for f in (audit_reasons, audit_ends, covering_cases, pairs_covered, mean_intervals)}
_CHAIN = """RECURSIVE e AS (SELECT user_id, event_id, coalesce(event_type, 'none') AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS q, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
      r AS (SELECT user_id, q, m, sha256(concat('{"event": "', event_type, '", "id": ', event_id, ', "chain_id": "u', user_id, '", "sequence": 1, "previous_hash": "', repeat('0', 64), '"}')) AS h FROM e WHERE q = 1
        UNION ALL SELECT e.user_id, e.q, e.m, sha256(concat('{"event": "', e.event_type, '", "id": ', e.event_id, ', "chain_id": "u', e.user_id, '", "sequence": ', e.q, ', "previous_hash": "', r.h, '"}')) FROM r JOIN e ON e.user_id = r.user_id AND e.q = r.q + 1)"""
ORACLES = {
    "audit_ends": f"""WITH {_CHAIN} SELECT user_id AS source, 'u' || user_id AS chain_id, count(*) AS total_events, min(q) AS first_sequence, max(q) AS last_sequence, arg_max(h, q) AS terminal_hash, 0 AS n_breaks, true AS chain_valid, false AS authentic FROM r GROUP BY user_id""",
    "audit_reasons": """WITH e AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS q, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
      b AS (SELECT s, 'hash_mismatch' AS reason FROM e WHERE s % 8 = 1 AND q = 2 UNION ALL SELECT s, unnest(['chain_discontinuity', 'sequence_discontinuity']) FROM e WHERE s % 8 = 2 AND q = 3
        UNION ALL SELECT s, 'duplicate_json_key' FROM e WHERE s % 8 = 3 AND q = 2 UNION ALL SELECT s, unnest(['chain_discontinuity', 'sequence_discontinuity']) FROM e WHERE s % 8 = 3 AND q = 3
        UNION ALL SELECT s, CASE s % 8 WHEN 4 THEN 'invalid_json' ELSE 'non_object_record' END FROM e WHERE s % 8 IN (4, 5) AND q = 1 UNION ALL SELECT s, unnest(['unanchored_chain_start', 'non_initial_sequence_start']) FROM e WHERE s % 8 IN (4, 5) AND q = 2
        UNION ALL SELECT s, 'empty_log' FROM e WHERE s % 8 IN (4, 5) AND m = 1 AND q = 1)
      SELECT s AS source, reason, count(*) AS n FROM b GROUP BY ALL""",
    "pairs_covered": """WITH a AS (SELECT DISTINCT 'status' AS x, 1 AS k, o_orderstatus AS v FROM orders UNION SELECT DISTINCT 'priority', 2, o_orderpriority FROM orders UNION SELECT DISTINCT 'segment', 3, c_mktsegment FROM customer UNION SELECT DISTINCT 'region', 4, r_name FROM region)
      SELECT concat(a.x, '|', a.v, '|', b.x, '|', b.v) AS pair, true AS covered FROM a JOIN a b ON a.k < b.k WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND NOT (a.v = 'O' AND a.x = 'status' AND b.v = 'ASIA' AND b.x = 'region')""",
}
