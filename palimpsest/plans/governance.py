"""Queries of governance, audit, splits, leak scoring and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import audit, governance, splits, stats


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tool_verdicts(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    allowed = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("click"), F.lit("view")))
    blocked = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("click"))).when(F.col("user_id") % 7 == 0, F.array(F.lit("__deny_all__")))
    return e.select("event_id", governance.tool_allowed(F.col("event_type"), allowed, blocked).alias("allowed"))


def hosts(spark, d):
    return table(spark, d, "pages").select("page_id", governance.host(F.col("url")).alias("host"))


def addresses_denied(spark, d):
    ip = F.concat_ws(".", (F.col("c_custkey") % 256).cast("string"), F.lit("168"), (F.col("c_nationkey") % 256).cast("string"), F.lit("9"))
    return table(spark, d, "customer").select("c_custkey", ip.alias("ip"), governance.ipv4(ip).alias("n"), governance.denied_address(ip).alias("denied"))


def network_join(spark, d):
    ip = F.concat_ws(".", (F.col("s_suppkey") % 256).cast("string"), (F.col("s_nationkey") * 8).cast("string"), F.lit("0"), F.lit("1"))
    a = table(spark, d, "supplier").select("s_suppkey", ip.alias("ip"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("net"), (F.col("n_nationkey") * (1 << 24)).cast("long").alias("low"), (F.col("n_nationkey") * (1 << 24) + F.when(F.col("n_nationkey") % 2 == 0, (1 << 24) - 1).otherwise((1 << 19) - 1)).cast("long").alias("high"))
    return governance.in_networks(a, n).select("s_suppkey", "net")


def egress_verdicts(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    addresses = F.when(k % 4 == 0, F.array(F.lit("93.184.216.34"), F.lit("10.0.0.8"))).when(k % 4 == 1, F.array(F.lit("2606:2800:220:1::1"))).when(k % 4 == 2, F.array(F.lit("fd00::8"))).when(k % 8 == 3, F.array(F.lit("93.184.216.34")))
    mode = F.when(k % 3 == 0, "DEFAULT_BLOCK").when(k % 3 == 1, "allowlist-only")
    url = F.when(k % 11 == 5, F.lit("http://user@[::1]:80/x")).when(k % 11 == 6, F.lit("http:\\\\a.example.com")).otherwise(F.col("url"))
    return p.select("page_id", governance.egress_verdict(url, mode, ("*.example.com", "*.example.org"), addresses).alias("verdict"))


def providers(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    host = F.when(k % 3 == 0, "API.anthropic.com.").when(k % 3 == 1, "notanthropic.com")
    model = F.when(k % 2 == 0, F.lit("claude-x")).when(k % 5 == 0, F.lit("Anthropic/y")).otherwise(F.lit("other"))
    return e.select("event_id", governance.provider_of(F.when(k % 7 == 0, "Custom"), model, host, "OpenAI").alias("provider"))


def ranges_joined(spark, d):
    """Addresses in ranges that begin and end anywhere."""
    ip = F.concat_ws(".", (F.col("s_suppkey") % 256).cast("string"), (F.col("s_nationkey") * 8).cast("string"), F.lit("0"), F.lit("1"))
    a = table(spark, d, "supplier").select("s_suppkey", ip.alias("ip"))
    low = (F.col("n_nationkey") * (1 << 23) + 12345).cast("long")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("net"), low.alias("low"), (low + F.pow(F.col("n_nationkey") + 1, 5).cast("long")).alias("high"))
    return governance.in_networks(a, n).select("s_suppkey", "net")


def system_hoisted(spark, d):
    c = governance.collapse_roles(table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 4 == 0, "system").otherwise(F.col("role"))))
    return c.select("conv_id", "block", "role", "n_turns", F.md5("system").alias("system_md5"), F.md5("text").alias("text_md5"))


def urls_introduced(spark, d):
    p = table(spark, d, "pages")
    after = F.concat("url", F.lit(" http://new.example.com/x "), F.col("url"))
    return p.select("page_id", F.size(governance.find_urls(after)).alias("n_urls"), F.array_join(governance.introduced(F.col("url"), after), ",").alias("introduced"))


def role_collapse(spark, d):
    c = governance.collapse_roles(table(spark, d, "conversations"))
    return c.select("conv_id", "block", "role", "n_turns", F.md5("text").alias("text_md5"))


def key_roles(spark, d):
    roles = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key_id")).agg(F.min("o_orderpriority").alias("role"))
    return governance.role_of_key(table(spark, d, "customer").select(F.col("c_custkey").alias("key_id")), roles, None)


def audit_chains(spark, d):
    e = table(spark, d, "events")
    log = audit.link(e, "user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))
    log = log.withColumn("line", F.col("sequence"))
    tampered = log.withColumn("body", F.when((F.col("chain_id") % 10 == 0) & (F.col("sequence") == 2), F.concat("body", F.lit("!"))).otherwise(F.col("body"))).where("not (chain_id % 10 = 1 and sequence = 2)")
    return audit.breaks(tampered).groupBy("chain_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def chain_roots(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.md5(F.col("event_id").cast("string")).alias("h")))).alias("r"))
    return e.select("user_id", audit.merkle_root(F.transform("r", lambda x: x["h"]), F.lit("")).alias("root"))


def event_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def _two_parts(b):
    s = b.select("item_id", "t", F.explode(splits.two_part(F.length("t"))).alias("cuts"))
    return s.select("item_id", F.element_at("cuts", 1).alias("cut"), F.array_join(splits.chunks(F.col("t"), F.col("cuts")), "|").alias("parts"))


def two_part_items(spark, d):
    return _two_parts(table(spark, d, "benchmark").select("item_id", F.col("text").alias("t")))


def three_part_counts(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.length("text").alias("n"))
    return b.select("item_id", splits.capped(F.col("n")).alias("capped"), F.size(splits.three_part(F.col("n"))).alias("n_splits"))


def policy_leaks(spark, d):
    """A value of 11 characters in the middle of a whole item, cut everywhere: chunk-local leaks, retention does not."""
    half = F.floor(F.length("text") / 2).cast("int")
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.substring("text", F.lit(1), half), F.lit(" 900-55-1234 "), F.substring("text", half + 1, F.length("text"))).alias("t"))
    s = b.select("item_id", "t", F.explode(F.concat(F.array(F.array().cast("array<int>")), splits.two_part(F.length("t")))).alias("cuts"))
    p, parts = r"\d{3}-\d{2}-\d{4}", splits.chunks(F.col("t"), F.col("cuts"))
    arm = F.when(F.size("cuts") == 0, "single_chunk").otherwise("adversarial")
    one = lambda name, text: s.select("item_id", F.lit(name).alias("policy"), arm.alias("fragmentation"), text.contains("900-55-1234").alias("leaked"), F.lit(False).alias("capped"))
    cases = one("chunk_local", splits.chunk_local(parts, p)).unionByName(one("retention", splits.bounded_retention(parts, p, 16))).unionByName(one("passthrough", F.array_join(parts, "")))
    worst = cases.groupBy("policy", "item_id", "fragmentation").agg(F.bool_or("leaked").alias("leaked"), F.bool_or("capped").alias("capped"))
    return splits.leak_rates(worst, "policy")


def twin_discordance(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "single").otherwise("adversarial").alias("arm"), (F.col("o_totalprice") > 150000).alias("leaked"))
    return stats.discordance(o, ["k"], "arm")


def axis_arms(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("leaked"), F.expr("stack(2, 'priority', o_orderpriority, 'clerk', substring(o_orderpriority, 1, 1)) as (axis, arm)"))
    return o.groupBy("axis", "arm").agg(F.count(F.lit(1)).alias("n"), stats.rate(F.col("leaked")).alias("rate"))


def index_percentiles(spark, d):
    return stats.index_percentiles(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", {"p95_floor": (0.95, "floor"), "p50_round": (0.5, "round")})


def sweep(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.median("o_totalprice"), 2).alias("median"), F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"))


def sign_tests(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") + 3).alias("plus"), (F.col("n_nationkey") % 5).alias("minus"))
    return n.select("n_nationkey", F.round(stats.sign_test(F.col("plus"), F.col("minus")), 6).alias("p"))


def sign_flip(spark, d):
    """Of each market segment, the differences by region and half of its customers' balances: an exact test that their mean is 0."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, d, "customer").join(n, "c_nationkey")
    half = F.avg(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))) - F.avg(F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal")))
    d_ = c.groupBy("c_mktsegment", "n_regionkey").agg(F.round(half, 2).alias("x"))
    return stats.sign_flips(d_, "c_mktsegment", "x")


def holm_adjusted(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") * 7 % 25) / 500.0).alias("p"))
    return stats.holm(n, "n_regionkey").select("n_regionkey", "test", F.round("p_holm", 9).alias("p_holm"))


def usage_totals(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_requests"), F.round(F.sum("value"), 2).alias("total"))


_ALL = (tool_verdicts, hosts, addresses_denied, network_join, ranges_joined, egress_verdicts, providers, system_hoisted, urls_introduced, role_collapse, key_roles, audit_chains, chain_roots, event_counts, two_part_items, three_part_counts, policy_leaks, twin_discordance, axis_arms, index_percentiles, sweep, sign_tests, sign_flip, holm_adjusted, usage_totals)
QUERIES = {f.__name__: f for f in _ALL}

_N = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
_HOST = r"CASE WHEN regexp_matches(url, '(?i)^https?://[a-z0-9.-]+(?::\d{1,5})?(?:[/?#]|$)') THEN lower(regexp_extract(url, '(?i)^https?://([a-z0-9.-]+)', 1)) END"


def _ranges() -> str:
    import ipaddress

    return " OR ".join(f"n BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in map(ipaddress.ip_network, governance.DENIED_NETS) if x.version == 4)


ORACLES = {
    "tool_verdicts": """SELECT event_id, NOT (user_id % 5 = 0 AND event_type = 'click') AND NOT (user_id % 5 <> 0 AND user_id % 7 = 0) AND (user_id % 3 <> 0 OR event_type IN ('click', 'view')) AS allowed FROM events""",
    "hosts": f"SELECT page_id, {_HOST} AS host FROM pages",
    "addresses_denied": f"WITH a AS (SELECT c_custkey, concat_ws('.', c_custkey % 256, 168, c_nationkey % 256, 9) AS ip FROM customer), b AS (SELECT *, {_N} AS n FROM a) SELECT c_custkey, ip, n, {_ranges()} AS denied FROM b",
    "network_join": f"""WITH a AS (SELECT s_suppkey, concat_ws('.', s_suppkey % 256, s_nationkey * 8, 0, 1) AS ip FROM supplier), b AS (SELECT s_suppkey, {_N} AS n FROM a),
      w AS (SELECT n_nationkey AS net, n_nationkey::BIGINT * 16777216 AS low, n_nationkey::BIGINT * 16777216 + CASE WHEN n_nationkey % 2 = 0 THEN 16777215 ELSE 524287 END AS high FROM nation)
      SELECT s_suppkey, net FROM b JOIN w ON n BETWEEN low AND high""",
    "egress_verdicts": """WITH u AS (SELECT page_id AS k, CASE WHEN page_id % 11 = 5 THEN 'http://user@[::1]:80/x' WHEN page_id % 11 = 6 THEN 'http:' || chr(92) || chr(92) || 'a.example.com' ELSE trim(url) END AS v FROM pages),
      h AS (SELECT k, CASE WHEN k % 11 = 5 THEN '[::1]' WHEN contains(v, chr(92)) THEN NULL ELSE nullif(lower(regexp_replace(regexp_replace(regexp_extract(v, '(?i)^https?://([^/?#]+)', 1), '^.*@', ''), ':[0-9]+$', '')), '') END AS h FROM u)
      SELECT k AS page_id, CASE WHEN h IS NULL OR (k % 11 <> 5 AND NOT regexp_matches(h, '^([a-z0-9_-]+[.])*[a-z0-9_-]+[.]?$')) THEN 'bad_url'
        WHEN k % 3 = 1 AND NOT regexp_matches(h, '[.]example[.](com|org)[.]?$') THEN 'not_listed' WHEN k % 11 = 5 THEN 'denied_address'
        WHEN k % 8 = 7 THEN 'no_address' WHEN k % 4 IN (0, 2) THEN 'denied_address' ELSE 'allow' END AS verdict FROM h""",
    "providers": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'custom' WHEN event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 5 = 0) THEN 'anthropic' ELSE 'openai' END AS provider FROM events""",
    "ranges_joined": f"""WITH a AS (SELECT s_suppkey, concat_ws('.', s_suppkey % 256, s_nationkey * 8, 0, 1) AS ip FROM supplier), b AS (SELECT s_suppkey, {_N} AS n FROM a),
      w AS (SELECT n_nationkey AS net, n_nationkey::BIGINT * 8388608 + 12345 AS low, n_nationkey::BIGINT * 8388608 + 12345 + pow(n_nationkey + 1, 5)::BIGINT AS high FROM nation)
      SELECT s_suppkey, net FROM b JOIN w ON n BETWEEN low AND high""",
    "system_hoisted": """WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 0 THEN 'system' ELSE role END AS role FROM conversations), s AS (SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS system_md5 FROM c WHERE role = 'system' GROUP BY conv_id),
      r AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM c WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM r)
      SELECT conv_id, block, first(role) AS role, count(*) AS n_turns, any_value(system_md5) AS system_md5, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM b LEFT JOIN s USING (conv_id) GROUP BY conv_id, block""",
    "urls_introduced": "SELECT page_id, 2 AS n_urls, 'http://new.example.com/x' AS introduced FROM pages",
    "role_collapse": """WITH r AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM r) SELECT conv_id, block, first(role) AS role, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM b GROUP BY conv_id, block""",
    "key_roles": "SELECT c_custkey AS key_id, coalesce(min(o_orderpriority), 'FAIL_CLOSED') AS role FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "audit_chains": """WITH s AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS q, count(*) OVER (PARTITION BY user_id) AS m FROM events)
      SELECT chain_id, reason, count(*) AS n FROM (SELECT chain_id, 'hash_mismatch' AS reason FROM s WHERE chain_id % 10 = 0 AND q = 2
        UNION ALL SELECT chain_id, unnest(['broken_link', 'sequence_gap']) FROM s WHERE chain_id % 10 = 1 AND q = 3) GROUP BY chain_id, reason""",
    "chain_roots": """WITH RECURSIVE e AS (SELECT user_id, md5(event_id::VARCHAR) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events),
      r AS (SELECT user_id, q, sha256(h) AS root FROM e WHERE q = 1 UNION ALL SELECT e.user_id, e.q, sha256(r.root || e.h) FROM r JOIN e ON e.user_id = r.user_id AND e.q = r.q + 1)
      SELECT user_id, arg_max(root, q) AS root FROM r GROUP BY user_id""",
    "event_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
    "two_part_items": "SELECT item_id, c::INT AS cut, t[1:c] || '|' || t[c + 1:] AS parts FROM (SELECT item_id, text AS t, unnest(range(1, length(text))) AS c FROM benchmark)",
    "three_part_counts": "SELECT item_id, (length(text) - 1) * (length(text) - 2) / 2 > 6000 AS capped, CASE WHEN (length(text) - 1) * (length(text) - 2) / 2 > 6000 THEN 0 ELSE (length(text) - 1) * (length(text) - 2) // 2 END::INT AS n_splits FROM benchmark",
    "policy_leaks": "SELECT * FROM (VALUES ('chunk_local', 0::DOUBLE, 1::DOUBLE, 1::DOUBLE), ('retention', 0.0, 0.0, 0.0), ('passthrough', 1.0, 1.0, 0.0)) t(policy, leak_single, leak_adversarial, delta_frag)",
    "twin_discordance": """WITH c AS (SELECT o_custkey, bool_or(o_totalprice > 150000) FILTER (WHERE o_orderkey % 2 = 0) AS s, bool_or(o_totalprice > 150000) FILTER (WHERE o_orderkey % 2 <> 0) AS a FROM orders GROUP BY 1)
      SELECT count(*) FILTER (WHERE s AND a) AS both, count(*) FILTER (WHERE s AND NOT a) AS single_only, count(*) FILTER (WHERE NOT s AND a) AS adversarial_only, count(*) FILTER (WHERE NOT s AND NOT a) AS neither FROM c WHERE s IS NOT NULL AND a IS NOT NULL""",
    "axis_arms": """SELECT axis, arm, count(*) AS n, round(avg(l), 4) AS rate FROM (SELECT 'priority' AS axis, o_orderpriority AS arm, (o_orderstatus = 'F')::INT AS l FROM orders UNION ALL SELECT 'clerk', o_orderpriority[1:1], (o_orderstatus = 'F')::INT FROM orders) GROUP BY axis, arm""",
    "index_percentiles": "SELECT o_orderpriority, list_sort(list(o_totalprice))[least(count(*) - 1, floor(0.95 * count(*))::BIGINT) + 1] AS p95_floor, list_sort(list(o_totalprice))[round_even(0.5 * (count(*) - 1), 0)::BIGINT + 1] AS p50_round FROM orders GROUP BY 1",
    "sweep": "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round(median(o_totalprice), 2) AS median, round(stddev_samp(o_totalprice), 2) AS sd FROM orders GROUP BY 1",
    "sign_tests": """WITH n AS (SELECT n_nationkey, n_nationkey + 3 AS plus, n_nationkey % 5 AS minus FROM nation), k AS (SELECT *, unnest(range(0, least(plus, minus) + 1)) AS i FROM n),
      c AS (SELECT n_nationkey, any_value(plus + minus) AS m, sum(factorial((plus + minus)::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((plus + minus - i)::INT)::DOUBLE)) AS t FROM k GROUP BY n_nationkey)
      SELECT n_nationkey, round(least(1.0, 2 * t / pow(2.0, m)), 6) AS p FROM c""",
    "sign_flip": """WITH d AS (SELECT c_mktsegment, n_regionkey, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) - avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1), 2) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
      v AS (SELECT c_mktsegment, list(x) AS x, count(*)::INT AS n FROM d WHERE x IS NOT NULL GROUP BY 1), p AS (SELECT c_mktsegment, n, list_sum(x) AS t, x, unnest(range(0, 1 << n)) AS i FROM v)
      SELECT c_mktsegment, any_value(n) AS n, count(*) FILTER (WHERE abs(list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN (i >> (k - 1)) & 1 = 1 THEN -x[k] ELSE x[k] END))) >= abs(t) - 1e-12) / count(*) AS p_value FROM p GROUP BY 1""",
    "holm_adjusted": """WITH n AS (SELECT n_regionkey, n_nationkey AS test, (n_nationkey * 7 % 25) / 500.0 AS p FROM nation), r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p, test) + 1)) AS s FROM n)
      SELECT n_regionkey, test, round(max(s) OVER (PARTITION BY n_regionkey ORDER BY p, test), 9) AS p_holm FROM r""",
    "usage_totals": "SELECT user_id, event_type, count(*) AS n_requests, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
