"""Queries of detection, entropy, validators, masking and restoring, over documents and pages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from palimpsest.functions import detect as D
from palimpsest.functions import text as T
from palimpsest.operators import masking as M
from palimpsest.operators import profiles as R

BASIC = ("EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS")
KEY = b"palimpsest-test-key"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def spans(spark, d, types=None, secrets=True):
    return D.with_spans(docs(spark, d).select("doc_id", "lang", "source", "text"), "text", types, secrets)


def found(spark, d, types=None, secrets=True):
    return spans(spark, d, types, secrets).where(F.size("spans") > 0).select("doc_id", "lang", "source", F.explode("spans").alias("s")).select("doc_id", "lang", "source", "s.*")


def assess_entity_counts(spark, d):
    """Distinct values of each type in each document, summed: the offline assessment. Each document is one partial sum for each of its types."""
    s = spans(spark, d).where(F.size("spans") > 0)
    types = F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))
    each = s.select("doc_id", F.col("spans"), F.explode(types).alias("entity_type"))
    own = F.filter("spans", lambda s: s["entity_type"] == F.col("entity_type"))
    each = each.select("entity_type", F.size(F.array_distinct(F.transform(own, lambda s: s["matched"]))).alias("v"), F.size(own).alias("s"))
    return each.groupBy("entity_type").agg(F.sum("v").alias("n_values"), F.sum("s").alias("n_spans"), F.count(F.lit(1)).alias("n_docs"))


def email_docs(spark, d):
    return docs(spark, d).select("doc_id", "lang", D.tier1(F.col("text"), ("EMAIL",)).alias("s")).groupBy("lang").agg(F.count_if(F.size("s") > 0).alias("n_docs"), F.count(F.lit(1)).alias("n"))


def ip_docs(spark, d):
    return docs(spark, d).select("doc_id", "source", D.tier1(F.col("text"), ("IP_ADDRESS",)).alias("s")).groupBy("source").agg(F.count_if(F.size("s") > 0).alias("n_docs"))


def entropy_tokens(spark, d):
    tokens = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_+=-]{16,}"), F.lit(0)))).alias("token"))
    return tokens.select("doc_id", "token", F.round(D.entropy(F.col("token")), 6).alias("bits"))


def secret_counts(spark, d):
    s = docs(spark, d).select("doc_id", D.secret_spans(F.col("text")).alias("s"))
    return s.where(F.size("s") > 0).select("doc_id", F.size("s").alias("n_secrets"))


def luhn_numbers(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("number"))
    return n.select("o_orderkey", "number", D.luhn(F.col("number")).alias("valid"), D.is_issuer(F.col("number")).alias("issuer"))


def iban_mod97(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 18, "0")).alias("iban"))
    return n.select("c_custkey", "iban", D.mod97(F.col("iban")).alias("rest"))


def scrubbed(spark, d):
    return spans(spark, d, ("EMAIL", "IP_ADDRESS"), False).select("doc_id", F.md5(M.scrub(F.col("text"), F.col("spans"))).alias("text_md5"), F.size("spans").alias("n"))


def hmac_tokens(spark, d):
    return found(spark, d, ("EMAIL",), False).select("doc_id", F.col("matched").alias("value"), T.hmac_sha256(KEY, F.col("matched")).alias("digest"))


def minted(spark, d):
    v = found(spark, d).select(F.col("source").alias("session"), "entity_type", F.col("matched").alias("original"), F.col("doc_id").alias("turn"), "start")
    return M.mint(v)


def restored(spark, d):
    """Masks each document with its source's tags and restores them: all rows must come back whole. The spans are used in five places
    and searched once: they are kept on the executors' disks, which hold no more than the documents with a span."""
    s = spans(spark, d).where(F.size("spans") > 0).persist(StorageLevel.DISK_ONLY)
    one = s.select(F.col("source").alias("session"), "doc_id", "text", F.explode("spans").alias("s"))
    vault = M.mint(one.select("session", F.col("s.entity_type").alias("entity_type"), F.col("s.matched").alias("original"), F.col("doc_id").alias("turn"), F.col("s.start").alias("start")))
    tagged = one.withColumn("original", F.col("s.matched")).join(vault.select("session", "original", "token"), ["session", "original"])
    tagged = tagged.groupBy("session", "doc_id").agg(F.first("text").alias("plain"), F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "token"))).alias("spans"))
    masked = tagged.select("session", F.col("doc_id").alias("text_id"), "plain", M.splice(F.col("plain"), F.col("spans"), lambda x: x["token"]).alias("text"))
    back = M.restore(masked.select("session", "text_id", "text"), vault)
    return back.join(masked.select("session", "text_id", "plain"), ["session", "text_id"]).select(F.col("text_id").alias("doc_id"), (F.col("text") == F.col("plain")).alias("whole"))


def crypto_round_trip(spark, d):
    key, aad = "0123456789abcdef", F.concat(F.lit("v2|"), F.col("source"))
    f = found(spark, d, ("EMAIL", "IP_ADDRESS"), False)
    t = f.select("doc_id", "source", "matched", "start", M.encrypt(F.col("matched"), key, aad).alias("token"))
    return t.select("doc_id", "start", (M.decrypt(F.col("token"), key, aad) == F.col("matched")).alias("opens"), (M.decrypt(F.col("token"), key, F.lit("x")) == F.col("token")).alias("stays_shut"))


def mode_resolution(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    enforced = F.when(F.col("conv_id") % 5 == 0, "hmac").when(F.col("conv_id") % 5 == 1, "nonsense")
    header = F.when(F.col("turn") % 2 == 0, "Scrub").otherwise("other")
    return c.select("conv_id", "turn", M.mode_of(enforced, header, F.col("role") == "user", "STRUCTURAL_TAG").alias("mode"))


_INVISIBLE = "​­⁦x﻿"


def invisible_texts(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.strip_invisible(F.concat("text", F.lit(_INVISIBLE)))).alias("clean_md5"))


def watermarks(spark, d):
    m = T.watermark(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16))
    return docs(spark, d).select("doc_id", F.length(m).alias("n_chars"), T.read_watermark(F.concat(F.lit("a"), m, F.lit("b"))).alias("decoded"))


def fingerprints(spark, d):
    inner = F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256)
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.substring(T.hmac_sha256(KEY, inner), 1, 12).alias("fingerprint"))


def neutralized(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    role = F.when(F.col("turn") % 2 == 1, "tool").otherwise(F.col("role"))
    return c.select("conv_id", "turn", F.md5(T.neutralize(role, F.concat("text", F.lit(" SYSTEM  override now")))).alias("text_md5"))


def percent_decoded(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.percent_decode(F.concat(F.col("url"), F.lit("%20a+b%zz"))).alias("decoded"))


def simple_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.simple_tokens(F.col("text"))).alias("n_tokens"))


def confidences(spark, d):
    f = found(spark, d, ("CREDIT_CARD", "IBAN"), False)
    return f.groupBy("entity_type", D.confidence(F.col("entity_type"), F.col("matched")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def profile_tables(spark, d):
    """Tenants are the sources of documents, dealt by their last character to three profiles and one that does not exist; a rule of codes."""
    last = F.ascii(F.substring(F.col("tenant"), -1, 1)) % 4
    tenants = docs(spark, d).select(F.col("source").alias("tenant")).distinct().withColumn("profile", F.element_at(F.array(*map(F.lit, ("mail", "net", "nothing", "gone"))), last + 1))
    profiles = spark.sql("SELECT * FROM VALUES ('mail', 1, 'EMAIL'), ('mail', 3, 'PERSON'), ('net', 1, 'IP_ADDRESS'), ('net', 1, 'PHONE'), ('net', 1, 'CREDIT_CARD'), ('net', 1, 'CODE'), ('net', 1, 'UNHEARD_OF'), ('nothing', 1, NULL) AS t(profile, tier, entity_type)")
    rules = R.rules_of(spark.sql("SELECT 1 AS position, 'CODE' AS name, '[A-Z]{2,4}-[0-9]{2,6}' AS pattern"))
    return tenants, profiles, rules


def profile_docs(spark, d):
    """Documents of each source in which each type that the source's profile asks for is found."""
    tenants, profiles, rules = profile_tables(spark, d)
    rows = R.scoped(docs(spark, d).select("source", "text"), "source", tenants, profiles, rules)
    types = F.transform(D.tier1(F.col("text"), ("EMAIL", "IP_ADDRESS"), rules, F.col("allowed")), lambda s: s["entity_type"])
    rows = rows.select("source", "profile", F.explode(F.array(F.array_distinct(types))).alias("types"))
    has = lambda t: F.count_if(F.array_contains("types", t)).alias(f"{t.lower()}_docs")
    return rows.groupBy("source", "profile").agg(F.count(F.lit(1)).alias("n"), has("EMAIL"), has("IP_ADDRESS"), has("CODE"))


def profile_spans(spark, d):
    """Resolved values of each document under its tenant's profile, over all built-in types and rules."""
    tenants, profiles, rules = profile_tables(spark, d)
    rows = R.scoped(docs(spark, d).select("doc_id", "source", "text"), "source", tenants, profiles, rules)
    rows = D.with_spans(rows, "text", secrets=False, custom=rules, encoded=False, allowed="allowed").where(F.size("spans") > 0)
    return rows.select("doc_id", "profile", F.explode("spans").alias("s")).select("doc_id", "profile", "s.start", "s.end", "s.entity_type", F.sha2("s.matched", 256).alias("value_sha256"))


def profile_coverage(spark, d):
    tenants, profiles, _ = profile_tables(spark, d)
    return R.coverage(profiles, tenants)


QUERIES = {f.__name__: f for f in (assess_entity_counts, email_docs, ip_docs, entropy_tokens, secret_counts, luhn_numbers, iban_mod97, scrubbed, hmac_tokens, minted, restored, crypto_round_trip, mode_resolution, invisible_texts, watermarks, fingerprints, neutralized, percent_decoded, simple_tokens, confidences, profile_docs, profile_spans, profile_coverage)}

_HMAC = lambda m: f"sha256(from_hex('{bytes(b ^ 0x5C for b in KEY.ljust(64, bytes(1))).hex()}') || from_hex(sha256(from_hex('{bytes(b ^ 0x36 for b in KEY.ljust(64, bytes(1))).hex()}') || encode({m}))))"
_EMAIL = r"(?:^|[^A-Za-z0-9_])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}(?:[^A-Za-z0-9_]|$)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_IP = rf"(?:^|[^A-Za-z0-9_])(?:{_OCTET}\.){{3}}{_OCTET}(?:[^A-Za-z0-9_]|$)"
_PROFILE = "CASE ascii(right(source, 1)) % 4 WHEN 0 THEN 'mail' WHEN 1 THEN 'net' WHEN 2 THEN 'nothing' ELSE 'global_strict' END"
ORACLES = {
    "profile_docs": f"""WITH p AS (SELECT source, text, {_PROFILE} AS profile FROM documents)
      SELECT source, profile, count(*) AS n, count(*) FILTER (WHERE profile IN ('mail', 'global_strict') AND regexp_matches(text, '{_EMAIL}')) AS email_docs,
      count(*) FILTER (WHERE profile IN ('net', 'global_strict') AND regexp_matches(text, '{_IP}')) AS ip_address_docs,
      count(*) FILTER (WHERE profile IN ('net', 'global_strict') AND regexp_matches(text, '[A-Z]{{2,4}}-[0-9]{{2,6}}')) AS code_docs FROM p GROUP BY source, profile""",
    "profile_coverage": f"""WITH t AS (SELECT DISTINCT source, {_PROFILE} AS profile FROM documents WHERE source IS NOT NULL),
      p AS (SELECT * FROM (VALUES ('mail', 'PERSON'), ('net', ''), ('nothing', ''), ('global_strict', 'PERSON')) AS v(profile, expected))
      SELECT profile, expected, expected <> '' AS expects_names, false AS model_loaded, expected <> '' AS unbacked, (SELECT count(*) FROM t WHERE t.profile = p.profile) AS n_tenants FROM p""",
    "email_docs": f"SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '{_EMAIL}')) AS n_docs, count(*) AS n FROM documents GROUP BY lang",
    "ip_docs": f"SELECT source, count(*) FILTER (WHERE regexp_matches(text, '{_IP}')) AS n_docs FROM documents GROUP BY source",
    "entropy_tokens": """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_+=-]{16,}')) AS token FROM documents),
      c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT doc_id, token, ch, count(*) AS k FROM c GROUP BY ALL)
      SELECT doc_id, token, round(-sum((k / length(token)) * log2(k / length(token))), 6) AS bits FROM n GROUP BY doc_id, token""",
    "secret_counts": """WITH t AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_+=-]{16,}') AS x FROM documents)),
      c AS (SELECT doc_id, i, token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT doc_id, i, token, ch, count(*) AS k FROM c GROUP BY ALL),
      e AS (SELECT doc_id, i, token, -sum((k / length(token)) * log2(k / length(token))) AS h FROM n GROUP BY doc_id, i, token)
      SELECT doc_id, count(*)::INT AS n_secrets FROM e WHERE h >= 4.5 OR (regexp_matches(token, '^[0-9a-fA-F]{24,}$') AND h >= 3.4) GROUP BY doc_id""",
    "luhn_numbers": """WITH n AS (SELECT o_orderkey, '4' || lpad(o_orderkey::VARCHAR, 9, '0') || lpad(o_custkey::VARCHAR, 6, '0') AS number FROM orders)
      SELECT o_orderkey, number, list_sum(list_transform(range(1, length(number) + 1), lambda i: CASE WHEN i % 2 = 1 THEN number[length(number) + 1 - i]::INT ELSE (number[length(number) + 1 - i]::INT * 2) // 10 + (number[length(number) + 1 - i]::INT * 2) % 10 END)) % 10 = 0 AS valid,
      regexp_matches(number, '^(4|34|37|30|36|38|39|35|51|52|53|54|55|6011|62|64|65)') OR number[1:6]::INT BETWEEN 222100 AND 272099 AS issuer FROM n""",
    "iban_mod97": "WITH n AS (SELECT c_custkey, 'DE' || lpad((c_custkey % 97)::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 18, '0') AS iban FROM customer) SELECT c_custkey, iban, ((iban[5:] || '1314' || iban[3:4])::HUGEINT % 97)::INT AS rest FROM n",
    "fingerprints": f"SELECT c_custkey, {_HMAC("sha256('key-' || c_custkey)")}[1:12] AS fingerprint FROM customer",
    "mode_resolution": """SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'HMAC' WHEN conv_id % 5 = 1 THEN 'SCRUB' WHEN role = 'user' AND turn % 2 = 0 THEN 'SCRUB' ELSE 'STRUCTURAL_TAG' END AS mode FROM conversations""",
    "invisible_texts": "SELECT doc_id, md5(regexp_replace(text, '[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E007F}]', '', 'g') || 'x') AS clean_md5 FROM documents",
    "watermarks": "SELECT doc_id, 66 AS n_chars, md5(doc_id::VARCHAR)[1:16] AS decoded FROM documents",
    "neutralized": "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 1 OR role IN ('tool', 'function') THEN text || ' [SYSTEM_OVERRIDE_BLOCKED] now' ELSE text || ' SYSTEM  override now' END) AS text_md5 FROM conversations",
    "percent_decoded": "SELECT page_id, url || ' a+b%zz' AS decoded FROM pages",
    "simple_tokens": r"SELECT doc_id, len(regexp_extract_all(text, ' ?[A-Za-z]+|\d{1,3}| ?[^\s\vA-Za-z\d]+|[\s\v]+'))::INT AS n_tokens FROM documents",
}
ORACLES["hmac_tokens"] = rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9_])([A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9.-]{{1,255}}\.[A-Za-z]{{2,}})', 2)) AS value FROM documents)
  SELECT doc_id, value, {_HMAC("value")} AS digest FROM e"""
