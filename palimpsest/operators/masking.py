"""Rewriting of spans, minting of tokens, and restoring.

Spans come from functions.detect: sorted, disjoint. Tags are numbered for each
session and type in order of first use; within a text the last span is first.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from palimpsest.functions.text import hmac_sha256

TOKEN = r"\[([A-Z][A-Z0-9_]*)_(\d+)\]"


def splice(text: Column, spans: Column, token) -> Column:
    """The text with each span replaced by token(span)."""
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), token(s)).alias("out"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def scrub(text: Column, spans: Column) -> Column:
    return splice(text, spans, lambda s: F.lit("[REDACTED]"))


def reply_mask(text: Column, spans: Column) -> Column:
    return splice(text, spans, lambda s: F.concat(F.lit("["), s["entity_type"], F.lit("_REDACTED]")))


def keyed(text: Column, spans: Column, key: bytes) -> Column:
    return splice(text, spans, lambda s: F.concat(F.lit("["), s["entity_type"], F.lit("_"), hmac_sha256(key, s["matched"]), F.lit("]")))


def mint(values: DataFrame, session: str = "session", span: int = 1000) -> DataFrame:
    """values(session, entity_type, original, turn, start): the vault (session, original, entity_type, ordinal, token).

    A value has one token in its session, of the type it was first seen with; a
    turn's last span comes first. One row for each value is left before the
    windows, so a value seen often costs nothing there. Ordinals are counted inside
    runs of ``span`` turns, and the runs' sizes summed up before them, so a session
    of very many turns is spread over tasks; turns that are no numbers are one run. The values are used twice, so they are kept on
    the executors' disks: whatever found them runs once.
    """
    seen = values.withColumn("_at", F.struct("turn", (-F.col("start")).alias("start")))
    first = seen.groupBy(session, "original").agg(F.min("_at").alias("_at"), F.min_by("entity_type", "_at").alias("entity_type")).persist(StorageLevel.DISK_ONLY)
    numbered = isinstance(values.schema["turn"].dataType, NumericType)
    first = first.withColumn("_run", F.floor(F.coalesce(F.col("_at.turn"), F.lit(-1)) / span) if numbered else F.lit(0))
    sizes = first.groupBy(session, "entity_type", "_run").count()
    before = sizes.withColumn("_before", F.sum("count").over(W.partitionBy(session, "entity_type").orderBy("_run")) - F.col("count")).drop("count")
    inside = F.row_number().over(W.partitionBy(session, "entity_type", "_run").orderBy("_at", "original"))
    keys = [session, "entity_type", "_run"]
    both = first.withColumn("_inside", inside).alias("f").join(before.alias("b"), [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]).select(*[F.col(f"f.{c}") for c in (session, "original", "entity_type", "_inside")], "_before")
    counted = both.withColumn("ordinal", (F.col("_inside") + F.col("_before")).cast("int"))
    return counted.select(session, "original", "entity_type", "ordinal", F.format_string("[%s_%d]", "entity_type", "ordinal").alias("token"))


def encrypt(value: Column, key: str, aad: Column) -> Column:
    """[ENC_v2_...]: nonce, cipher text and tag of AES-GCM, URL-safe."""
    raw = F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key).cast("binary"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad.cast("binary")))
    return F.concat(F.lit("[ENC_v2_"), F.rtrim(F.translate(F.replace(raw, F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("=")), F.lit("]"))


def decrypt(token: Column, key: str, aad: Column) -> Column:
    """The value, or the token itself where it does not open."""
    body = F.translate(F.regexp_extract(token, r"^\[ENC_v2_([A-Za-z0-9_-]+)\]$", 1), "-_", "+/")
    plain = F.try_aes_decrypt(F.try_to_binary(body, F.lit("base64")), F.lit(key).cast("binary"), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary"))
    return F.coalesce(plain.cast("string"), token)


def mode_of(enforced: Column, header: Column, allowed: Column, default: str) -> Column:
    """A role's mode wins, then the caller's where allowed, then the default; an unknown enforced mode is SCRUB."""
    modes = ("STRUCTURAL_TAG", "SYNTHETIC", "SCRUB", "HMAC", "STATELESS_CRYPTO")
    return F.when(enforced.isNotNull(), F.when(F.upper(enforced).isin(*modes), F.upper(enforced)).otherwise("SCRUB")).when(allowed & F.upper(header).isin(*modes), F.upper(header)).otherwise(default)


def restore(texts: DataFrame, vault: DataFrame, session: str = "session") -> DataFrame:
    """texts(session, text_id, text): tags that the session's vault knows become their values again.

    Tokens are joined with the vault on (session, token), so neither side is collected or broadcast.
    """
    parts = texts.select(session, "text_id", F.posexplode(F.split("text", TOKEN, -1)).alias("k", "part"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    parts = parts.withColumn("token", F.get("tokens", F.col("k"))).drop("tokens")
    known = parts.join(vault.select(session, "token", "original"), [session, "token"], "left")
    piece = F.concat("part", F.coalesce("original", "token", F.lit("")))
    return known.groupBy(session, "text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("p")))), lambda x: x["p"]), "").alias("text"))
