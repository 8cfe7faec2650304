"""Agent traffic: loop detection, tool names in streams, event translation, request marks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from palimpsest.functions.detect import entropy
from palimpsest.functions.text import hmac_sha256

# Fixed values of the loop test.
SHORTEST, BOUND, NEAR_BITS, NEAR_RATIO, THRESHOLD = 50, 4096, 0.05, 0.95, 3


@F.pandas_udf(BooleanType())
def _alike(before: pd.Series, now: pd.Series) -> pd.Series:
    """Nearly the same text, and not only other numbers in the same one. The quick ratio counts characters wherever they stand, so it
    only bounds: texts of the same characters in another order pass it, and the ratio of what matches in order decides."""
    out = []
    for a, b in zip(before, now):
        if a is None or b is None:
            out.append(False)
            continue
        m = difflib.SequenceMatcher(None, a, b)
        if m.quick_ratio() <= NEAR_RATIO or m.ratio() <= NEAR_RATIO:
            out.append(False)
            continue
        edits = [(a[i:j], b[k:n]) for tag, i, j, k, n in m.get_opcodes() if tag != "equal"]
        only_numbers = bool(edits) and all((not x or x.isdigit()) and (not y or y.isdigit()) for x, y in edits)
        out.append(not only_numbers)
    return pd.Series(out)


def loops(turns: DataFrame, session: str = "session", order: str = "turn", payload: str = "payload", calls: str = "calls", threshold: int = THRESHOLD) -> DataFrame:
    """turns(session, turn, payload, calls array<string> or null): (session, turn, run, tripped).

    A turn repeats the one before it in its session if the tool calls are the
    same as those of the last turn that had some, or if the texts are alike at
    nearly the same entropy. ``run`` counts repeats in a row. Payloads under 50
    characters, and null ones, are left out; texts are compared in their first
    4,096 characters, which is the feature's bound. Python sees only pairs whose
    entropies are near. Ties of ``turn`` are ordered by the payload.
    """
    w = W.partitionBy(session).orderBy(order, "_text")
    t = turns.where(F.length(payload) >= SHORTEST).select(session, order, F.substring(payload, 1, BOUND).alias("_text"), F.when(F.size(calls) > 0, F.sha2(F.array_join(F.sort_array(calls), "|"), 256)).alias("_calls"))
    t = t.withColumn("_bits", F.explode(F.array(entropy(F.col("_text")))))
    t = t.withColumn("_last", F.last("_calls", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_near", F.abs(F.col("_bits") - F.lag("_bits").over(w)) < NEAR_BITS).withColumn("_before", F.lag("_text").over(w))
    same = F.coalesce(F.col("_calls") == F.col("_last"), F.lit(False))
    ask = F.col("_near") & ~same
    t = t.withColumn("_same", same).withColumn("_alike", _alike(F.when(ask, F.col("_before")), F.when(ask, F.col("_text"))))
    t = t.withColumn("_repeat", F.col("_same") | F.col("_alike")).withColumn("_island", F.sum((~F.col("_repeat")).cast("int")).over(w))
    run = F.sum(F.col("_repeat").cast("int")).over(W.partitionBy(session, "_island").orderBy(order, "_text"))
    return t.withColumn("run", run).select(session, order, "run", (F.col("run") >= threshold - 1).alias("tripped"))


def tool_names(chunk: Column) -> Column:
    """Values of ``name`` and ``method`` fields, as they stand in JSON text; names over 256 bytes are not names."""
    names = F.regexp_extract_all(chunk, F.lit(r'"(?:name|method)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.filter(names, lambda n: F.octet_length(n) <= 256)


def until_forbidden(chunks: DataFrame, allowed: Column, stream: str = "stream_id", order: str = "seq") -> DataFrame:
    """chunks up to the first that is not allowed, which is marked as the stream's error; what follows it is not sent on."""
    w = W.partitionBy(stream).orderBy(order)
    before = F.coalesce(F.max(F.col("_bad")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return chunks.withColumn("_bad", ~F.coalesce(allowed, F.lit(False))).withColumn("_before", before).where("not _before").withColumn("is_error", F.col("_bad")).drop("_bad", "_before")


def translated(events: DataFrame, stream: str = "stream_id", order: str = "seq") -> DataFrame:
    """events(stream_id, seq, type, block, kind, name, delta) of one provider as chunks of another's shape.

    Blocks of tools are numbered densely in order of their start; text goes to
    ``content``; other events have no chunk. More than 256 tools are an error.
    """
    w = W.partitionBy(stream).orderBy(order)
    opens = F.when((F.col("type") == "content_block_start") & (F.col("kind") == "tool_use"), 1).otherwise(0)
    e = events.withColumn("_tool", F.when(opens == 1, F.sum(opens).over(w) - 1))
    tool = F.last("_tool", ignorenulls=True).over(W.partitionBy(stream, "block").orderBy(order))
    e = e.withColumn("tool", tool.cast("int"))
    called = F.struct(F.col("tool").alias("index"), F.struct("name", F.col("delta").alias("arguments")).alias("function"))
    is_tool = F.col("tool").isNotNull() & (F.col("kind").isin("tool_use", "input_json_delta"))
    delta = F.when(is_tool, F.to_json(F.struct(F.array(called).alias("tool_calls")))).when(F.col("kind") == "text_delta", F.to_json(F.struct(F.col("delta").alias("content"))))
    return e.select(stream, order, F.when(F.col("tool") >= 256, F.lit('{"error":"too_many_tools"}')).otherwise(delta).alias("chunk")).where("chunk is not null")


def identity(secret: bytes, key_id: Column, header: Column, authorization: Column, address: Column) -> Column:
    """Who asks: the key's id, the header, a digest of the credential, the address, or nobody."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    credential = some(F.replace(authorization, F.lit("Bearer "), F.lit("")))
    known = F.when(~key_id.isin("BYOK", "anonymous") & (key_id != ""), key_id)
    return F.coalesce(known, some(header), F.substring(hmac_sha256(secret, credential), 1, 12), some(address), F.lit("anonymous_client"))


def request_mark(secret: bytes, who: Column, session: Column, minute: Column) -> Column:
    """Sixteen hex digits for a requester, session and minute: what a watermark holds."""
    return F.substring(hmac_sha256(secret, F.concat_ws(":", who, session, minute.cast("string"))), 1, 16)
