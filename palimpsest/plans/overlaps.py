"""Queries of overlaps between texts, and of splits of whole items."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import overlap, splits

SECRET = "900-55-1234"
PATTERN = r"\d{3}-\d{2}-\d{4}"


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def containments(spark, d):
    """Names of parts, brands and types, kinds of orders: which values hold others."""
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    values = part.select(F.col("p_name").alias("v")).unionByName(part.select(F.col("p_brand").alias("v"))).unionByName(part.select(F.col("p_type").alias("v"))).unionByName(part.select(F.concat("p_name", F.lit("-"), "p_brand").alias("v"))).unionByName(orders.select(F.col("o_orderpriority").alias("v")))
    pairs, _ = overlap.containments(values.select(F.col("v").alias("name"), "v"), "name", "v")
    return pairs


def emitted_runs(spark, d):
    """The longest run of each conversation's first turn that its assistant repeats and its user's other turns do not have."""
    c = table(spark, d, "conversations")
    needles = c.where("turn = 0").select("conv_id", F.col("text").alias("needle"))
    later = c.where("turn > 0")
    runs = overlap.specific_runs(needles, later.where("role = 'assistant'").select("conv_id", "text"), later.where("role <> 'assistant'").select("conv_id", "text"), "conv_id", 5)
    return overlap.emission_report(runs, 12)


def three_part_items(spark, d):
    """All splits of whole items into up to three parts: how many, and a sum over their cuts."""
    s = splits.all_splits(table(spark, d, "benchmark").select("item_id", "text"), "text", 3)
    cut = lambda i: F.coalesce(F.try_element_at("cuts", F.lit(i)), F.lit(0)).cast("long")
    return s.groupBy("item_id", (F.size("cuts") + 1).alias("n_parts")).agg(F.count(F.lit(1)).alias("n_splits"), F.sum(cut(1) * 1000 + cut(2) * cut(1)).alias("cuts_sum"))


def planted(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, d, "benchmark").select("item_id", F.concat(F.substring("text", F.lit(1), half), F.lit(f" {SECRET} "), F.substring("text", half + 1, F.length("text"))).alias("t"))


def chunk_local_report(spark, d):
    """Where masking chunk by chunk first differs from masking the whole item, over all splits into two parts."""
    return splits.invariance(planted(spark, d), "item_id", "t", 2, lambda c: splits.chunk_local(c, PATTERN), F.regexp_replace("t", PATTERN, "[X]"), F.lit(SECRET)).withColumn("first_cuts", F.array_join(F.transform("first_cuts", lambda c: c.cast("string")), ","))


def retention_report(spark, d):
    """The report's lines for bounded retention over all splits into two parts of whole items: none differs."""
    found = splits.invariance(planted(spark, d), "item_id", "t", 2, lambda c: splits.bounded_retention(c, PATTERN, 16), F.regexp_replace("t", PATTERN, "[X]"), F.lit(SECRET))
    return splits.report(found, "item_id")


QUERIES = {f.__name__: f for f in (containments, emitted_runs, three_part_items, chunk_local_report, retention_report)}
_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PLANTED = f"b AS (SELECT item_id, text[1:length(text) // 2] || ' {SECRET} ' || text[length(text) // 2 + 1:] AS t FROM benchmark)"
ORACLES = {
    "containments": f"""WITH v AS (SELECT p_name AS v FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT p_name || '-' || p_brand FROM part UNION SELECT o_orderpriority FROM orders),
      c AS (SELECT {_FOLD.format("v")} AS f, min(v) AS name FROM v GROUP BY 1 HAVING f <> '') SELECT a.name AS container, b.name AS contained FROM c a JOIN c b ON a.f <> b.f AND contains(a.f, b.f)""",
    "emitted_runs": f"""WITH t AS (SELECT conv_id, turn, role, {_FOLD.format("coalesce(text, '')")} AS f FROM conversations), n AS (SELECT conv_id, f FROM t WHERE turn = 0),
      h AS (SELECT conv_id, coalesce(string_agg(f, '|') FILTER (WHERE role = 'assistant'), '') AS hay, coalesce(string_agg(f, '|') FILTER (WHERE role <> 'assistant'), '') AS known FROM t WHERE turn > 0 GROUP BY conv_id),
      s AS (SELECT conv_id, f, hay, known, unnest(range(1, length(f) - 3)) AS i FROM n JOIN h USING (conv_id)),
      k AS (SELECT conv_id, i, f[i:i + 4] AS g, hay, known, f FROM s WHERE contains(hay, f[i:i + 4])),
      e AS (SELECT conv_id, i, list_max(list_filter(range(5, length(f) - i + 2), lambda m: contains(hay, f[i:i + m - 1]))) AS m, f, known FROM k),
      r AS (SELECT conv_id, max(m) AS run FROM e WHERE NOT contains(known, f[i:i + m - 1]) GROUP BY conv_id)
      SELECT n.conv_id, coalesce(run, 0)::INT AS run, CASE WHEN coalesce(run, 0) >= 12 THEN 'partial' ELSE 'clean' END AS verdict FROM n LEFT JOIN r USING (conv_id)""",
    "three_part_items": """WITH b AS (SELECT item_id, length(text) AS n FROM benchmark), one AS (SELECT item_id, n, unnest(range(1, n)) AS i FROM b), two AS (SELECT item_id, i, unnest(range(i + 1, n)) AS j FROM one)
      SELECT item_id, 1 AS n_parts, 1 AS n_splits, 0 AS cuts_sum FROM b UNION ALL SELECT item_id, 2, count(*), sum(i * 1000)::BIGINT FROM one GROUP BY item_id UNION ALL SELECT item_id, 3, count(*), sum(i * 1000 + i * j)::BIGINT FROM two GROUP BY item_id""",
    "chunk_local_report": rf"""WITH {_PLANTED}, s AS (SELECT item_id, t, unnest(range(0, length(t))) AS c FROM b),
      o AS (SELECT item_id, c, regexp_replace(t, '\d{{3}}-\d{{2}}-\d{{4}}', '[X]', 'g') AS w, regexp_replace(t[1:c], '\d{{3}}-\d{{2}}-\d{{4}}', '[X]', 'g') || regexp_replace(t[c + 1:], '\d{{3}}-\d{{2}}-\d{{4}}', '[X]', 'g') AS g FROM s),
      r AS (SELECT item_id, count(*) AS n_splits, count(*) FILTER (WHERE g <> w) AS n_failing, count(*) FILTER (WHERE g <> w AND contains(g, '{SECRET}') AND NOT contains(w, '{SECRET}')) AS n_leaked, min(c) FILTER (WHERE g <> w) AS first, arg_min(g, c) FILTER (WHERE g <> w) AS g, arg_min(w, c) FILTER (WHERE g <> w) AS w FROM o GROUP BY item_id),
      d AS (SELECT *, list_max(list_filter(range(0, least(length(g), length(w)) + 1), lambda k: g[1:k] = w[1:k])) AS k FROM r),
      e AS (SELECT *, list_max(list_filter(range(0, least(length(g), length(w)) - k + 1), lambda m: right(g, m) = right(w, m))) AS m FROM d)
      SELECT item_id, n_splits, n_failing, n_leaked, first::VARCHAR AS first_cuts, k::INT AS at, w[k + 1:length(w) - m] AS expected, g[k + 1:length(g) - m] AS got FROM e""",
    "retention_report": f"WITH {_PLANTED} SELECT 1 AS part, '' AS key, concat('0 of ', count(*), ' texts differ over ', sum(length(t))::BIGINT, ' splits') AS line FROM b",
}
