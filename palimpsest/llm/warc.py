"""Not-modified revisit records resolved to the full responses they stand for.

A revisit is matched with the latest earlier full response of the same
canonical URL (an as-of join); if its validators agree with that response's,
it takes over the body, and the headers that a 304 answer may carry replace
the stored ones. The as-of join runs in two levels, inside time buckets of a
URL and over one row for each bucket, so that a URL with very many captures is
spread over its buckets; bodies go to the revisits of a response by parts.

Cases: a null URL, or one without an earlier response, is ``orphan``; a
revisit whose validators disagree (or that has none) is ``mismatch`` and takes
nothing over. Responses at the very time of the revisit are not earlier; among
responses of one time the largest id is the latest. Each revisit row is resolved
for itself, whatever its id. Of several responses of one id the latest counts
(ties: the greatest url, validators, headers and body); a response without id
can stand for nothing. Other columns of the inputs are ignored. Empty tables:
all revisits are orphans, or there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import shared

#: Headers that a 304 answer may carry and that then replace the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
BUCKET_SECONDS = 3600
#: Parts into which the revisits of a response are dealt.
SALTS = 32
SHARE = 1000


def canonical_url(url: Column) -> Column:
    """https, host in lower case without www and default port, no fragment, no tracking parameters, no slash at the end."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "([?&])(?:(?:utm_[a-z]+|ref)=[^&]*&?)+", "$1")
    u = F.regexp_replace(u, "[?&]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?]*)", 1)), "^www\\.|:(?:80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z]+://[^/?]*(.*)$", 1), "/+$", "")
    return F.when(u.rlike("^[A-Za-z]+://"), F.concat(F.lit("https://"), host, rest)).otherwise(u)


def as_of(revisits: DataFrame, responses: DataFrame) -> DataFrame:
    """revisits(id, url, t, etag, last_modified, headers), responses(id, url, t, etag, last_modified) with t in seconds:
    adds to each revisit ``canonical`` and ``found``, a struct (t, id, etag, last_modified) of the response or null."""
    bucket = F.floor(F.col("t") / BUCKET_SECONDS)
    named = lambda df: df.withColumn("canonical", canonical_url(F.col("url"))).withColumn("bucket", bucket)
    seen = F.struct("t", "id", "etag", "last_modified")
    r = named(responses).where("canonical is not null and t is not null").select("canonical", "bucket", "t", F.lit(1).alias("kind"), "id", "etag", "last_modified", F.lit(None).cast("map<string,string>").alias("headers"), seen.alias("response"))
    v = named(revisits)
    lone = v.where("canonical is null or t is null")
    v = v.where("canonical is not null and t is not null").select("canonical", "bucket", "t", F.lit(0).alias("kind"), "id", "etag", "last_modified", "headers", F.lit(None).cast(r.schema["response"].dataType).alias("response"))
    events = v.unionByName(r)
    inside = W.partitionBy("canonical", "bucket").orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, -1)
    near = events.withColumn("inside", F.last("response", ignorenulls=True).over(inside)).where("kind = 0")
    latest = events.groupBy("canonical", "bucket").agg(F.max("response").alias("latest"))
    earlier = W.partitionBy("canonical").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    far = latest.withColumn("outside", F.last("latest", ignorenulls=True).over(earlier)).drop("latest")
    out = near.join(far, ["canonical", "bucket"]).withColumn("found", F.coalesce("inside", "outside"))
    keep = ["id", "canonical", "t", "etag", "last_modified", "headers", "found"]
    return out.select(*keep).unionByName(lone.withColumn("found", F.lit(None).cast(r.schema["response"].dataType)).select(*keep))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Headers (lower-case names) of the stored response with the permitted ones of the revisit over them."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    rest = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def resolve(revisits: DataFrame, responses: DataFrame) -> DataFrame:
    """revisits and responses (id, url, t, etag, last_modified, headers map), responses also body: a row for each
    revisit with canonical, response_id, status, headers and body."""
    columns = ["url", "t", "etag", "last_modified", "headers", "body"]
    rank = F.struct("t", "url", "etag", "last_modified", header_text(F.col("headers")), "body")
    one = responses.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns), rank).alias("_one"))
    responses = one.select("id", *[F.col(f"_one.{c}").alias(c) for c in columns])
    found = as_of(revisits.select("id", "url", "t", "etag", "last_modified", "headers"), responses.select("id", "url", "t", "etag", "last_modified"))
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("found.etag")).otherwise(F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "orphan").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("mismatch")
    found = found.select("id", "canonical", F.col("found.id").alias("response_id"), status.alias("status"), F.col("headers").alias("fresh"))
    body = responses.select(F.col("id").alias("response_id"), F.col("headers").alias("stored"), "body")
    found = shared.keep(found, "as-of")
    total, columns = found.count(), [*found.columns, "stored", "body"]
    # At most SHARE responses can each stand for more than one of SHARE parts of the revisits: their bodies go out by parts.
    often = shared.keep(found.where("response_id is not null").groupBy("response_id").count().where(F.col("count") * SHARE > total).select("response_id"), "often")
    few = found.where("response_id is not null").join(F.broadcast(often), "response_id", "left_anti").join(body, "response_id", "left")
    many = found.join(F.broadcast(often), "response_id", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id", "canonical", F.monotonically_increasing_id()), F.lit(SALTS)))
    copies = body.join(F.broadcast(often), "response_id", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = many.join(copies.withColumn("salt", F.col("salt").cast("long")), ["response_id", "salt"])
    lone = found.where("response_id is null").withColumn("stored", F.lit(None).cast("map<string,string>")).withColumn("body", F.lit(None).cast(body.schema["body"].dataType))
    out = few.select(*columns).unionByName(many.select(*columns)).unionByName(lone.select(*columns))
    taken = F.col("status") == "resolved"
    return out.select("id", "canonical", "response_id", "status", F.when(taken, merge_headers(F.col("stored"), F.col("fresh"))).otherwise(F.col("fresh")).alias("headers"), F.when(taken, F.col("body")).alias("body"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisits, responses) of a column ``record``: WARC records with their HTTP messages, as text. Other records are left out."""
    cut = lambda c, k: F.when(F.instr(c, "\r\n\r\n") > 0, F.substr(c, F.instr(c, "\r\n\r\n") + 4)).otherwise(F.lit("")) if k else F.substring_index(c, "\r\n\r\n", 1)
    pairs = lambda c: F.filter(F.transform(F.split(c, "\r\n"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"), F.instr(x, ":").alias("at"))), lambda x: x["at"] > 1)
    # Of a repeated header the last one counts.
    last = lambda a: F.map_from_entries(F.transform(F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"])), lambda x: F.struct(x["k"], x["v"])))
    parts = records.where("record like 'WARC/%'").select(cut(F.col("record"), 0).alias("head"), cut(F.col("record"), 1).alias("message"))
    parts = parts.select(last(pairs(F.col("head"))).alias("w"), last(pairs(cut(F.col("message"), 0))).alias("headers"), cut(F.col("message"), 1).alias("body"))
    t = F.unix_timestamp(F.try_to_timestamp(F.col("w")["warc-date"]))
    named = parts.select(F.lower(F.col("w")["warc-type"]).alias("kind"), F.col("w")["warc-record-id"].alias("id"), F.col("w")["warc-target-uri"].alias("url"), t.alias("t"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"), "headers", "body")
    return named.where("kind = 'revisit'").drop("kind", "body"), named.where("kind = 'response'").drop("kind")


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A crawl made of ``pages``: page k is a full response of hour k, and 30 days later its URL is asked for again with
    its validators and answered with 304. In between, another page of the same canonical URL may have been stored."""
    hour, later, start = 3600, 30 * 86400, 1_704_067_200
    etag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    t = F.lit(start) + F.col("page_id") * hour
    m = lambda **h: F.create_map(*[F.lit(x) if i % 2 == 0 else x for k, v in h.items() for i, x in enumerate((k.replace("_", "-"), v))])
    common = [F.col("page_id").alias("id"), "url"]
    stored = m(cache_control=F.lit("max-age=60"), content_length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), content_type=F.lit("text/html"), etag=etag, date=t.cast("string"))
    fresh = m(cache_control=F.lit("max-age=600"), content_length=F.lit("0"), etag=etag, date=(t + later).cast("string"))
    responses = pages.select(*common, t.alias("t"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), stored.alias("headers"), F.col("html").alias("body"))
    revisits = pages.select(*common, (t + later).alias("t"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), fresh.alias("headers"))
    return revisits, responses


def op9_warc(spark, sf_dir: str) -> DataFrame:
    revisits, responses = captures(shared.table(spark, sf_dir, "pages"))
    out = resolve(revisits, responses)
    return out.select(F.col("id").alias("page_id"), F.col("canonical").alias("canonical_url"), "response_id", "status", header_text(F.col("headers")).alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '([?&])(?:(?:utm_[a-z]+|ref)=[^&]*&?)+', '\1', 'g'), '[?&]+$', '') AS u FROM pages
), c AS (
  SELECT page_id, html, md5(coalesce(html, '')) AS etag, CASE WHEN regexp_matches(u, '^[A-Za-z]+://') THEN
    'https://' || regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*(.*)$', 1), '/+$', '') ELSE u END AS canonical,
    1704067200 + page_id * 3600 AS t FROM u
), v AS (SELECT page_id, canonical, etag, t + 2592000 AS t FROM c)
SELECT v.page_id, v.canonical AS canonical_url, r.page_id AS response_id,
  CASE WHEN r.page_id IS NULL THEN 'orphan' WHEN r.etag = v.etag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN r.etag = v.etag THEN concat('cache-control: max-age=600', chr(10), 'content-length: ', strlen(coalesce(r.html, '')), chr(10), 'content-type: text/html', chr(10), 'date: ', v.t, chr(10), 'etag: ', v.etag)
  ELSE concat('cache-control: max-age=600', chr(10), 'content-length: 0', chr(10), 'date: ', v.t, chr(10), 'etag: ', v.etag) END AS headers,
  CASE WHEN r.etag = v.etag THEN md5(r.html) END AS body_md5
FROM v ASOF LEFT JOIN c r ON v.canonical = r.canonical AND v.t > r.t
"""
