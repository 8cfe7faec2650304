"""Queries of stream operators, run over the tables as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import decoders
from palimpsest.operators import governance
from palimpsest.sources import frames, records
from palimpsest.streaming import json_text, replay, replies, state

CHUNKS_OF_TASK = 400_000


def sse_parse(spark, d):
    body = F.concat(F.lit(": hi\r\ndata: "), F.translate("text", "\r\n", "  "), F.lit("\ndata:x\n\nevent: e\r\rdata\n\ndata: lost"))
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", records.sse_events(body).alias("e"))
    return b.select("item_id", F.size("e").alias("n_events"), F.md5(F.array_join("e", "|")).alias("events_md5"))


def seconds(ts):
    """Seconds of a timestamp, with or without time zone, as it reads."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def token_buckets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", seconds(F.col("ts")))
    return state.token_bucket(e, "user_id", "t", 0.001, 3.0).groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count(F.lit(1)).alias("n"))


def usage_windows(spark, d):
    u = state.usage(spark.read.parquet(f"{d}/events.parquet"))
    return u.select(seconds(F.col("w.start")).alias("window_start"), "user_id", "event_type", "n", F.round("total", 2).alias("total"))


def replies_restored(spark, d):
    """Conversations as replies that come seven characters at a time: each turn is a choice, its words that begin with a capital
    are the vault's tokens, and what the windows give out is put together again."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("stream_id"), "turn", "role", "text").where("text is not null")
    words = F.explode(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]"))))
    vault = c.select("stream_id", words.alias("token")).distinct().withColumn("original", F.concat(F.lit("<"), "token", F.lit(">")))
    pieces = c.select("stream_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("at", "delta"), (F.ceil(F.length("text") / 7) - 1).alias("last"))
    events = pieces.select("stream_id", (F.col("turn").cast("long") * 1_000_000 + F.col("at")).alias("seq"), F.col("turn").cast("int").alias("choice"), F.when(F.col("role") == "user", "reasoning").otherwise("content").alias("channel"), F.lit(None).cast("int").alias("tool"), "delta", (F.col("at") == F.col("last")).alias("final"))
    out = replies.batch_replies(events, vault).groupBy("stream_id", "choice", "channel")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))), lambda x: x["text"]), "")
    return out.agg(F.md5(text).alias("text_md5"), F.count(F.col("error")).alias("n_errors"))


def click_values(spark, d):
    """The values of each click's JSON properties, lexed from chunks of five characters."""
    c = spark.read.parquet(f"{d}/clicks.parquet").where("props is not null").select(F.col("click_id").cast("string").alias("stream_id"), F.col("props"))
    # As many tasks as the chunks need: Spark would size them by the clicks, before these are cut.
    n = (c.agg(F.sum(F.ceil(F.length("props") / 5))).first()[0] or 0) // CHUNKS_OF_TASK + 1
    c = c.repartition(n, "stream_id").groupBy("stream_id").agg(F.min("props").alias("props"))
    chunks = c.select("stream_id", F.posexplode(F.regexp_extract_all("props", F.lit("(?s).{1,5}"), F.lit(0))).alias("seq", "delta")).withColumn("seq", F.col("seq").cast("long"))
    v = json_text.batch_values(chunks, partitions=n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "text"))), lambda x: x["text"]), "|")
    return v.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_values"), F.md5(joined).alias("values_md5"))


def framed_pages(spark, d):
    """Pages as bytes that come 61 at a time, put into lines again: how many and which."""
    p = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select(F.col("page_id").cast("string").alias("source"), F.replace(F.replace("html", F.lit("><"), F.lit(">\r\n<")), F.lit(". "), F.lit(".\r")).cast("binary").alias("b"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 61).cast("int")))
    chunks = p.where("length(b) > 0").select("source", "b", at.alias("seq")).select("source", "seq", F.substring(F.col("b"), F.col("seq") * 61 + 1, F.lit(61)).alias("bytes"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "|")
    return frames.framed(chunks).groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(lines).alias("lines_md5"), F.count("error").alias("n_errors"))


def click_replays(spark, d):
    """Of each click, how often it arrived and how many of these were repeats within 420 seconds of one let through."""
    c = spark.read.parquet(f"{d}/clicks.parquet").where("click_id is not null and arrived_at is not null").select("click_id", "arrived_at", F.monotonically_increasing_id().alias("row"))
    return replay.replays(c, ["click_id"], "arrived_at", "row").groupBy("click_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("replayed").alias("n_replayed"))


def page_urls(spark, d):
    """URLs of any form in whole pages, and how many of them are refused since they are not plainly one host's."""
    u = spark.read.parquet(f"{d}/pages.parquet").select("page_id", governance.find_urls(F.concat(F.coalesce("html", F.lit("")), F.lit(" HTTP:\\\\h.example http:"), F.col("page_id").cast("string"), F.lit("x https:)"))).alias("u"))
    return u.select("page_id", F.size("u").alias("n_urls"), F.size(F.filter("u", lambda x: governance.host(x).isNull())).alias("n_refused"))


def hidden_turns(spark, d):
    """Conversations' turns, each in base64 of hex behind a stray letter: whether a search over decoders finds every one, whole."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("length(text) >= 16")
    t = F.concat(F.lit("k"), F.replace(F.replace(F.base64(F.hex(F.col("text").cast("binary")).cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit("")))
    h = c.select("conv_id", "turn", "text", F.explode(F.array(decoders.hidden_texts(t))).alias("h"))
    return h.select("conv_id", "turn", F.exists("h.decodings", lambda x: x["text"] == F.col("text")).alias("found"))


QUERIES = {f.__name__: f for f in (framed_pages, click_replays, page_urls, hidden_turns, replies_restored, click_values, sse_parse, token_buckets, usage_windows)}
ORACLES = {
    "framed_pages": r"""WITH p AS (SELECT page_id::VARCHAR AS source, string_split(replace(replace(replace(html, '><', '>' || chr(10) || '<'), '. ', '.' || chr(10)), chr(13), chr(10)), chr(10)) AS x FROM pages WHERE html <> ''),
      q AS (SELECT source, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM p) SELECT source, len(x) AS n_lines, md5(array_to_string(x, '|')) AS lines_md5, 0 AS n_errors FROM q""",
    "click_replays": """WITH RECURSIVE e AS (SELECT click_id, arrived_at, row_number() OVER (PARTITION BY click_id ORDER BY arrived_at) AS q FROM clicks WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL),
      r AS (SELECT click_id, q, arrived_at AS last, false AS replayed FROM e WHERE q = 1 UNION ALL SELECT e.click_id, e.q, CASE WHEN e.arrived_at - r.last < INTERVAL 420 SECOND THEN r.last ELSE e.arrived_at END, e.arrived_at - r.last < INTERVAL 420 SECOND FROM r JOIN e ON e.click_id = r.click_id AND e.q = r.q + 1)
      SELECT click_id, count(*) AS n, count(*) FILTER (WHERE replayed) AS n_replayed FROM r GROUP BY click_id""",
    "page_urls": r"""WITH t AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(replace(coalesce(html, ''), chr(92) || '/', '/') || ' HTTP:' || chr(92) || chr(92) || 'h.example http:' || page_id || 'x', '(?i)https?:[\\/]*[\p{L}\p{N}\[%@:][^\s"''<>]*'), lambda u: CASE WHEN contains(u, '[') THEN regexp_replace(u, '[)}.,;!?]+$', '') ELSE regexp_replace(u, '[)\]}.,;!?]+$', '') END)) AS u FROM pages)
      SELECT page_id, len(u)::INT AS n_urls, len(list_filter(u, lambda x: contains(x, chr(92)) OR NOT regexp_matches(x, '(?i)^https?://([^/?#@]*@)?([a-z0-9_-]+[.])*[a-z0-9_-]+[.]?(:[0-9]{1,5})?([/?#]|$)')))::INT AS n_refused FROM t""",
    "hidden_turns": "SELECT conv_id, turn, true AS found FROM conversations WHERE length(text) >= 16",
    "token_buckets": """WITH RECURSIVE e AS (SELECT user_id, epoch(date_trunc('second', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS q FROM events),
      r AS (SELECT user_id, q, t, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE q = 1
        UNION ALL SELECT e.user_id, e.q, e.t, CASE WHEN least(3.0, r.tokens + (e.t - r.t) * 0.001) >= 1 THEN least(3.0, r.tokens + (e.t - r.t) * 0.001) - 1 ELSE least(3.0, r.tokens + (e.t - r.t) * 0.001) END, least(3.0, r.tokens + (e.t - r.t) * 0.001) >= 1 FROM r JOIN e ON e.user_id = r.user_id AND e.q = r.q + 1)
      SELECT user_id, count(*) FILTER (WHERE allowed) AS n_allowed, count(*) AS n FROM r GROUP BY user_id""",
    "replies_restored": r"""SELECT conv_id::VARCHAR AS stream_id, turn::INT AS choice, CASE WHEN role = 'user' THEN 'reasoning' ELSE 'content' END AS channel,
      md5(regexp_replace(text, '(^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_]*)', '\1<\2>', 'g')) AS text_md5, 0 AS n_errors FROM conversations WHERE text <> ''""",
    "click_values": r"""WITH c AS (SELECT click_id::VARCHAR AS stream_id, min(props) AS props FROM clicks WHERE props IS NOT NULL GROUP BY 1),
      t AS (SELECT stream_id, regexp_extract_all(props, '"(?:[^"\\]|\\.)*"\s*:?|[^\s"{}\[\],:]+') AS x FROM c),
      v AS (SELECT stream_id, list_transform(list_filter(x, lambda y: NOT (y[1:1] = '"' AND y[-1:] = ':')), lambda y: CASE WHEN y[1:1] = '"' THEN trim(y)[2:-2] ELSE y END) AS v FROM t)
      SELECT stream_id, len(list_filter(v, lambda y: y <> '')) AS n_values, md5(array_to_string(list_filter(v, lambda y: y <> ''), '|')) AS values_md5 FROM v WHERE len(list_filter(v, lambda y: y <> '')) > 0""",
    "sse_parse": "SELECT item_id, 2 AS n_events, md5(translate(text, chr(13) || chr(10), '  ') || chr(10) || 'x|') AS events_md5 FROM benchmark",
    "usage_windows": "SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 AS window_start, user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
