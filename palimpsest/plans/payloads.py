"""Queries of payload rewriting, encoded values, stand-ins, agent traffic and reports.

Payloads, events and runs are made of the tables' own rows, so that SQL can say
what must come out of each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import detect as D
from palimpsest.functions import encoded, synthetic
from palimpsest.operators import agents, governance, mutation, payload, reports
from palimpsest.operators import masking as M
from palimpsest.plans.detection import _HMAC, KEY
from palimpsest.plans.governance import table

SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def payloads(spark, d):
    """One chat payload for each turn: its text with an address, the turn's role, and an end user."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    address = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    body = F.struct(F.lit("m-1").alias("model"), address.alias("user"), F.array(F.struct("role", F.concat(F.col("text"), F.lit(" mail "), address, F.lit(" now")).alias("content"))).alias("messages"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("payload_id"), F.col("conv_id").alias("session"), "conv_id", "turn", F.to_json(body).alias("payload"))


def payload_scrub(spark, d):
    r = payload.redact(payloads(spark, d), lambda s: F.lit("[REDACTED]"))
    return r.select("conv_id", "turn", F.get_json_object("redacted", "$.model").alias("model"), F.get_json_object("redacted", "$.user").alias("end_user"), F.md5(F.get_json_object("redacted", "$.messages[0].content")).alias("content_md5"), "n_spans")


def payload_tags(spark, d):
    """Tags of a session: one for the end user's address where it is one-way, one where it can be restored."""
    r, _ = payload.redact_minted(payloads(spark, d))
    n = F.regexp_extract_all(F.col("redacted"), F.lit(r"\[EMAIL_\d+\]"), F.lit(0))
    return r.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_payloads"), F.sum(F.size(n)).alias("n_tags"), F.count_if(F.col("redacted").contains("@")).alias("n_bare"))


def payload_errors(spark, d):
    e = table(spark, d, "nation").select("n_nationkey")
    k = F.col("n_nationkey") % 5
    text = F.when(k == 0, F.lit('{"a":"b"}')).when(k == 1, F.lit("[1]")).when(k == 2, F.lit('{"a":')).when(k == 3, F.concat(F.repeat(F.lit('{"a":'), 30), F.lit("1"), F.repeat(F.lit("}"), 30)))
    return payload.redact(e.select(F.col("n_nationkey").alias("payload_id"), text.alias("payload")), lambda s: F.lit("[R]")).select(F.col("payload_id").alias("n_nationkey"), F.coalesce("error", F.lit("none")).alias("error"))


def payload_mutations(spark, d):
    """Each payload, mutated and restored: it must come back whole, and show none of its addresses between."""
    p = payloads(spark, d)
    key = mutation.session_key(KEY, b"palimpsest-salt", F.concat_ws("|", F.lit("vk"), F.col("session").cast("string")))
    m = mutation.mutate(p, key, KEY).select("payload_id", "session", "conv_id", "turn", "mutated", F.col("payload").alias("plain"))
    back = mutation.unmutate(m, key, payload="mutated")
    text = "$.messages[0].content"
    return back.select("conv_id", "turn", (F.get_json_object("restored", text) == F.get_json_object("plain", text)).alias("whole"), (~F.col("mutated").contains(F.get_json_object("plain", "$.user"))).alias("hidden"))


def encoded_values(spark, d):
    """An address in each of three encodings inside each item, and a run of each that hides nothing."""
    a = F.concat(F.lit("user"), F.col("item_id").cast("string"), F.lit("@example.com"))
    b64 = lambda x: F.base64(x.cast("binary"))
    text = F.concat_ws(" ", b64(a), b64(F.lit("nothing to see")), F.replace(a, F.lit("@"), F.lit("%40")), F.lit("a%20b%20c"), F.replace(a, F.lit("@"), F.lit("&commat;")), F.lit("fish&amp;chips"))
    t = encoded.with_entity_spans(table(spark, d, "benchmark").select("item_id", F.explode(F.array(text)).alias("t")), "t")
    spans = F.concat(encoded.base64_spans(F.col("t")), encoded.percent_spans(F.col("t")), F.col("entity_spans"))
    return t.select("item_id", F.explode(spans).alias("s")).select("item_id", "s.entity_type", "s.matched")


def stand_ins(spark, d):
    types = F.array(*[F.lit(t) for t in ("EMAIL", "SSN", "IP_ADDRESS", "PHONE", "CREDIT_CARD")])
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), F.element_at(types, (F.col("c_custkey") % 5 + 1).cast("int")).alias("entity_type"), F.col("c_custkey").cast("string").alias("original"), F.col("c_custkey").alias("turn"), F.lit(0).alias("start"))
    s = synthetic.synthesize(M.mint(c), KEY)
    shape = F.size(D.tier1(F.col("synthetic"))) > 0
    return s.groupBy("session", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("synthetic").alias("n_distinct"), F.count_if(shape).alias("n_shaped"), F.count_if(F.col("synthetic") == F.col("original")).alias("n_bare"))


def agent_loops(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.array("event_type").alias("calls"), F.concat(F.repeat(F.chr(F.lit(97) + F.col("event_id") % 26), 60 + (F.col("event_id") % 7).cast("int")), F.md5(F.col("event_id").cast("string"))).alias("payload"))
    return agents.loops(e).select(F.col("session").alias("user_id"), F.col("turn").alias("event_id"), "run", "tripped")


def forbidden_tools(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.concat(F.lit('{"method":"tools/call","params":{"name":"'), "event_type", F.lit('"}}')).alias("chunk"))
    ok = ~F.array_contains(agents.tool_names(F.col("chunk")), "purchase")
    return agents.until_forbidden(e, ok).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_sent"), F.count_if("is_error").alias("n_errors"))


def provider_chunks(spark, d):
    """Each user's events as blocks: every third opens a tool, which the next one fills; the others are text."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(governance.W.partitionBy("user_id").orderBy("event_id")).alias("seq"), "event_type")
    k = F.col("seq") % 3
    e = e.select("stream_id", "seq", F.when(k == 1, "content_block_start").otherwise("content_block_delta").alias("type"), F.when(k == 0, -F.col("seq")).otherwise(F.floor((F.col("seq") - 1) / 3)).alias("block"), F.when(k == 1, "tool_use").when(k == 2, "input_json_delta").otherwise("text_delta").alias("kind"), F.when(k == 1, F.col("event_type")).alias("name"), F.when(k != 1, F.col("event_type")).alias("delta"))
    return agents.translated(e)


def request_marks(spark, d):
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    who = agents.identity(KEY, F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("vk"), F.col("c_custkey").cast("string"))).otherwise("BYOK"), F.when(F.col("c_custkey") % 4 == 1, F.lit(" h ")), F.when(F.col("c_custkey") % 4 == 2, F.lit("Bearer token")), none)
    return c.select("c_custkey", who.alias("who"), agents.request_mark(KEY, who, F.col("c_nationkey").cast("string"), F.col("c_custkey") % 60).alias("mark"))


def assessment_summary(spark, d):
    a = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.lit("nothing")).otherwise(F.concat_ws(" and ", a, a)).alias("text"))
    return reports.assessment(D.with_spans(c, "text", ("EMAIL",), False), "text", "text")


def seed_conflicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("path"), "o_orderstatus")
    return reports.one_per_seed(o, ["o_custkey"], ["o_orderstatus"])


def runs_compared(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    run = lambda m, q: c.where(F.col("entity") % 11 != m).select("entity", F.when(F.col("entity") % q == 0, "leak").otherwise("contained").alias("state"))
    return reports.compared(run(3, 4), run(5, 6), "entity", "state")


def needle_runs(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 9).alias("needle"), F.md5(F.col("c_nationkey").cast("string")).alias("text"))
    return c.select("c_custkey", reports.longest_run(F.col("needle"), F.col("text")).alias("run"))


def leak_tiers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("ab-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("v"))
    field = lambda p, x: F.struct(F.lit(p).alias("path"), x.alias("value"))
    head, tail = F.substring("v", 1, 5), F.substring("v", 6, 20)
    k, x = F.col("c_custkey") % 5, F.replace(F.upper("v"), F.lit("-"), F.lit(" - "))
    fields = F.when(k < 2, F.array(field("p", x), field("q", F.lit("z")))).when(k == 2, F.array(field("p", head), field("q", F.lit("z")), field("p", tail))).when(k == 3, F.array(field("p", head), field("q", tail))).otherwise(F.array(field("p", F.lit("none"))))
    raw = F.when(k == 0, F.concat(F.lit("x"), "v", F.lit("y"))).otherwise("")
    return c.select("c_custkey", F.coalesce(reports.leak_tier(F.col("v"), raw, fields), F.lit("contained")).alias("tier"))


def verdicts(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select("n_nationkey", reports.verdict(k % 5 != 0, k % 2, (k % 3 == 1).cast("int")).alias("verdict"))


def source_lines(spark, d):
    t = F.concat(F.lit('# a\n\n"""d\nx"""\n  """one"""\n'), F.translate("text", "\r\n\u000b\f \u0085#\"'", "         "), F.lit("!\ny = 1  # z\n"))
    c = table(spark, d, "benchmark").select("item_id", reports.line_census(t).alias("c"))
    return c.select("item_id", "c.*")


def assessment_documents(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("run"), F.concat(F.lit("T"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity_type"), F.col("n_nationkey").alias("n_values"))
    return reports.observations(n, SPACE)


def repeats(spark, d):
    return reports.stable(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity").select("l_suppkey", "n", F.col("median").cast("double").alias("median"), "is_stable")


def case_digests(spark, d):
    return reports.cases_digest(table(spark, d, "nation"), "n_regionkey", F.col("n_name"))


def resource_verdicts(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("docs/"), F.when(F.col("c_custkey") % 4 == 0, F.lit("%2e%2e/")).when(F.col("c_custkey") % 4 == 1, F.lit("%252e%252e/")).when(F.col("c_custkey") % 4 == 2, F.lit("a%20b/")).otherwise(F.lit("x\n/")), F.col("c_custkey").cast("string")).alias("path"))
    return p.select("c_custkey", governance.resource_allowed(F.col("path"), ("docs/*",)).alias("allowed"))


_ALL = (payload_scrub, payload_tags, payload_errors, payload_mutations, encoded_values, stand_ins, agent_loops, forbidden_tools, provider_chunks, request_marks, assessment_summary, seed_conflicts, runs_compared, needle_runs, leak_tiers, verdicts, source_lines, assessment_documents, repeats, case_digests, resource_verdicts)
QUERIES = {f.__name__: f for f in _ALL}

_UUID = lambda name: f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (('0x' || h[17:17])::INT % 4), 1) || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(from_hex('{SPACE.replace('-', '')}') || encode({name})) AS h))"
ORACLES = {
    "payload_scrub": "SELECT conv_id, turn, 'm-1' AS model, '[REDACTED]' AS end_user, md5(coalesce(text, '') || ' mail [REDACTED] now') AS content_md5, 2::BIGINT AS n_spans FROM conversations",
    "payload_tags": "SELECT conv_id, count(*) AS n_payloads, 2 * count(*) AS n_tags, 0::BIGINT AS n_bare FROM conversations GROUP BY conv_id",
    "payload_errors": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'too_deep' ELSE 'null' END AS error FROM nation",
    "payload_mutations": "SELECT conv_id, turn, true AS whole, true AS hidden FROM conversations",
    "encoded_values": """WITH a AS (SELECT item_id, 'user' || item_id || '@example.com' AS a FROM benchmark)
      SELECT item_id, 'BASE64_OBFUSCATED_PII' AS entity_type, to_base64(encode(a)) AS matched FROM a UNION ALL SELECT item_id, 'PERCENT_OBFUSCATED_PII', replace(a, '@', '%40') FROM a
      UNION ALL SELECT item_id, 'ENTITY_OBFUSCATED_PII', replace(a, '@', '&commat;') FROM a""",
    "stand_ins": "SELECT c_nationkey AS session, CASE c_custkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SSN' WHEN 2 THEN 'IP_ADDRESS' WHEN 3 THEN 'PHONE' ELSE 'CREDIT_CARD' END AS entity_type, count(*) AS n, count(*) AS n_distinct, count(*) AS n_shaped, 0::BIGINT AS n_bare FROM customer GROUP BY ALL",
    "agent_loops": """WITH e AS (SELECT user_id, event_id, coalesce(lag(event_type) OVER w = event_type, false) AS rep FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      i AS (SELECT *, count(*) FILTER (WHERE NOT rep) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e), r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - CASE WHEN island = 0 THEN 0 ELSE 1 END)::BIGINT AS run FROM i)
      SELECT user_id, event_id, run, run >= 2 AS tripped FROM r""",
    "forbidden_tools": """WITH f AS (SELECT user_id, event_id, event_type, min(event_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM events)
      SELECT user_id AS stream_id, count(*) AS n_sent, count(*) FILTER (WHERE event_type = 'purchase') AS n_errors FROM f WHERE stop IS NULL OR event_id <= stop GROUP BY user_id""",
    "provider_chunks": """WITH e AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS seq, event_type FROM events), t AS (SELECT *, (seq - 1) // 3 AS tool FROM e)
      SELECT stream_id, seq, CASE WHEN tool >= 256 AND seq % 3 <> 0 THEN '{"error":"too_many_tools"}' WHEN seq % 3 = 1 THEN '{"tool_calls":[{"index":' || tool || ',"function":{"name":"' || event_type || '"}}]}'
        WHEN seq % 3 = 2 THEN '{"tool_calls":[{"index":' || tool || ',"function":{"arguments":"' || event_type || '"}}]}' ELSE '{"content":"' || event_type || '"}' END AS chunk FROM t""",
    "request_marks": f"""WITH w AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'vk' || c_custkey WHEN 1 THEN 'h' WHEN 2 THEN {_HMAC("'token'")}[1:12] ELSE 'anonymous_client' END AS who FROM customer)
      SELECT c_custkey, who, {_HMAC("who || ':' || c_nationkey || ':' || (c_custkey % 60)")}[1:16] AS mark FROM w""",
    "assessment_summary": """SELECT count(*) AS n_records, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS n_with, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n_without,
      sum(CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 2 * (length(c_custkey::VARCHAR) + 13) + 5 END)::BIGINT AS n_bytes, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS n_values FROM customer""",
    "seed_conflicts": "SELECT o_custkey, min(o_orderkey) AS path, count(*) AS n_rows, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY o_custkey",
    "runs_compared": """WITH b AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 4 = 0 THEN 'leak' ELSE 'contained' END AS before FROM customer WHERE c_custkey % 11 <> 3), c AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 6 = 0 THEN 'leak' ELSE 'contained' END AS after FROM customer WHERE c_custkey % 11 <> 5)
      SELECT entity, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'coverage' WHEN before = after THEN 'same' WHEN after = 'leak' THEN 'regression' ELSE 'improvement' END AS change FROM b FULL JOIN c USING (entity)""",
    "needle_runs": """WITH c AS (SELECT c_custkey, md5(c_custkey::VARCHAR)[1:9] AS needle, md5(c_nationkey::VARCHAR) AS text FROM customer), p AS (SELECT *, unnest(range(1, 10)) AS i FROM c), q AS (SELECT *, unnest(range(0, 11 - i)) AS k FROM p)
      SELECT c_custkey, max(CASE WHEN contains(text, substr(needle, i, k)) THEN k ELSE 0 END)::INT AS run FROM q GROUP BY c_custkey""",
    "leak_tiers": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'literal' WHEN 1 THEN 'single_field' WHEN 2 THEN 'same_path' WHEN 3 THEN 'cross_field' ELSE 'contained' END AS tier FROM customer",
    "verdicts": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'NOT MEASURED' WHEN n_nationkey % 3 = 1 THEN 'LEAK' WHEN n_nationkey % 2 = 1 THEN 'CHECK FAILED' ELSE 'CLEAN' END AS verdict FROM nation",
    "source_lines": "SELECT item_id, 2 AS code, 4 AS comment, 1 AS blank FROM benchmark",
    "assessment_documents": f"""SELECT n_regionkey AS run, '{{"uuid":"' || {_UUID("n_regionkey::VARCHAR")} || '","observations":[' || string_agg('{{"uuid":"' || {_UUID("n_regionkey || '/T' || lpad(n_nationkey::VARCHAR, 2, '0')")} || '","description":"T' || lpad(n_nationkey::VARCHAR, 2, '0') || ': ' || n_nationkey || '","methods":["EXAMINE"]}}', ',' ORDER BY n_nationkey) || ']}}' AS document FROM nation GROUP BY n_regionkey""",
    "repeats": "SELECT l_suppkey, count(*) AS n, median(l_quantity)::DOUBLE AS median, count(DISTINCT l_returnflag) = 1 AS is_stable FROM lineitem GROUP BY l_suppkey",
    "case_digests": "SELECT n_regionkey, count(*) AS n_cases, sha256(string_agg(sha256(n_name), '' ORDER BY sha256(n_name))) AS digest FROM nation GROUP BY n_regionkey",
    "resource_verdicts": "SELECT c_custkey, c_custkey % 4 = 2 AS allowed FROM customer",
}
