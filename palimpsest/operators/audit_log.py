"""Audit logs as they are on disk: JSON lines of hash-linked, signed records, checked line by line and chain by chain.

``parsed`` reads each line in an Arrow task: duplicate keys, bad JSON and other
values than objects are findings and not failures, and a record's hash is that
of its own bytes again, keys in the line's order. Links between records are
windows over (source, chain); what a window holds is one row at a time, so long
chains spill and do not grow in memory, though one chain is read by one task.

Reasons of a break, all of which are reported for a line:
duplicate_json_key, invalid_json, non_object_record; missing_hash, hash_mismatch;
missing_chain_id, invalid_chain_id, unanchored_chain_start, chain_discontinuity;
missing_sequence, invalid_sequence, non_initial_sequence_start,
sequence_discontinuity; missing_public_key_fingerprint, missing_signature,
invalid_public_key_fingerprint, public_key_fingerprint_mismatch,
invalid_signature_encoding, invalid_signature, unsigned_record; and of a source
as a whole (line 0) empty_log, multiple_chains_in_one_file. Blank lines are no
records.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64
SIGNED = ("hash", "signature", "public_key_fingerprint")
LINE = "source string, line long, error string, event string, severity string, timestamp string, chain_id string, sequence long, hash string, previous_hash string, anchored boolean, fingerprint string, signed boolean, verified boolean, reasons array<string>"

# Ed25519 (RFC 8032): the field, the order of the base point, the curve's constant.
_P, _Q = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _add(a: tuple, b: tuple) -> tuple:
    """Sum of two points (X, Y, Z, T) of the twisted Edwards curve."""
    (ax, ay, az, at), (bx, by, bz, bt) = a, b
    m, n = (ay - ax) * (by - bx) % _P, (ay + ax) * (by + bx) % _P
    c, d = 2 * at * bt * _D % _P, 2 * az * bz % _P
    e, f, g, h = n - m, d - c, d + c, n + m
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    for bit in bin(k)[2:]:
        out = _add(out, out)
        if bit == "1":
            out = _add(out, point)
    return out


def _point(raw: bytes) -> tuple | None:
    """The point that 32 bytes name; None if there is none."""
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (not x and sign):
        return None
    if x & 1 != sign:
        x = _P - x
    return x, y, 1, x * y % _P


_BASE = _point((4 * pow(5, -1, _P) % _P).to_bytes(32, "little"))


def verify_signature(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether 64 bytes are the Ed25519 signature of a message by the key of 32 bytes."""
    key, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or r is None or s >= _Q or len(signature) != 64:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % _Q
    left, right = _times(s, _BASE), _add(r, _times(k, key))
    return not (left[0] * right[2] - right[0] * left[2]) % _P and not (left[1] * right[2] - right[1] * left[2]) % _P


class _Twice(ValueError):
    pass


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Twice
    return out


def _bytes_of(record: dict, without: tuple[str, ...]) -> bytes:
    """What was hashed or signed: the record again, in its own order of keys."""
    return json.dumps({k: v for k, v in record.items() if k not in without}).encode()


def _signature(text) -> bytes | None:
    try:
        raw = base64.b64decode(text, validate=True)
    except (ValueError, TypeError, binascii.Error):
        return None
    return raw if len(raw) == 64 and base64.b64encode(raw).decode() == text else None


def read_line(text: str, public: bytes | None) -> tuple | None:
    """The columns of LINE after ``line``; None for a blank line."""
    text = text.strip()
    if not text:
        return None
    try:
        record = json.loads(text, object_pairs_hook=_object)
    except _Twice:
        return "duplicate_json_key", *[None] * 12
    except (ValueError, RecursionError):
        return "invalid_json", *[None] * 12
    if not isinstance(record, dict):
        return "non_object_record", *[None] * 12
    reasons = []
    digest, chain, sequence = record.get("hash"), record.get("chain_id"), record.get("sequence")
    if not digest:
        reasons.append("missing_hash")
    elif hashlib.sha256(_bytes_of(record, SIGNED)).hexdigest() != digest:
        reasons.append("hash_mismatch")
    if chain is None:
        reasons.append("missing_chain_id")
    elif not isinstance(chain, str) or not chain:
        reasons.append("invalid_chain_id")
        chain = None
    if sequence is None:
        reasons.append("missing_sequence")
    elif not isinstance(sequence, int) or isinstance(sequence, bool) or not 0 < sequence < 1 << 63:
        reasons.append("invalid_sequence")
        sequence = None
    fingerprint, signature = record.get("public_key_fingerprint"), record.get("signature")
    has_print, signed = fingerprint not in (None, ""), signature not in (None, "")
    if signed and not has_print:
        reasons.append("missing_public_key_fingerprint")
    if has_print and not signed:
        reasons.append("missing_signature")
    if has_print and not (isinstance(fingerprint, str) and re.fullmatch("[0-9a-f]{64}", fingerprint)):
        reasons.append("invalid_public_key_fingerprint")
        fingerprint = None
    elif has_print and public and fingerprint != hashlib.sha256(public).hexdigest():
        reasons.append("public_key_fingerprint_mismatch")
    verified = None
    if signed:
        raw = _signature(signature)
        if raw is None:
            reasons.append("invalid_signature_encoding")
        elif public:
            verified = verify_signature(public, _bytes_of(record, SIGNED[1:]), raw)
            if not verified:
                reasons.append("invalid_signature")
    elif public:
        reasons.append("unsigned_record")
    as_text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    previous = record.get("previous_hash")
    anchored = previous == GENESIS or bool(record.get("initial_hash")) and previous == record["initial_hash"]
    return None, as_text(record.get("event", "UNKNOWN")), as_text(record.get("severity", "INFO")), as_text(record.get("timestamp")) or None, chain, sequence, as_text(digest) or None, as_text(previous), anchored, fingerprint or None, signed, verified, reasons


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, line, value) of log files: the lines of each file in their order, from 1. A file is read as a whole, since only so its lines have numbers."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    numbered = files.select("source", F.posexplode(F.split("value", "\n", -1)).alias("line", "value"))
    return numbered.select("source", (F.col("line") + 1).cast("long").alias("line"), "value")


def parsed(lines: DataFrame, public: bytes | None = None) -> DataFrame:
    """lines(source, line, value) to rows of LINE; blank and null lines go."""

    def run(batches):
        for pdf in batches:
            out = []
            for source, line, value in pdf.itertuples(index=False, name=None):
                row = read_line(value, public) if isinstance(value, str) else None
                if row:
                    out.append((source, line, *row))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINE.split(", ")]).astype({"sequence": "Int64"})

    return lines.select(F.col("source").cast("string"), F.col("line").cast("long"), "value").mapInPandas(run, LINE)


def breaks(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, line, event, reason) of all breaks in ``parsed`` records. ``sources``(source): all that should hold records, so that empty ones are told."""
    good = records.where("error is null").withColumn("_chain", F.coalesce("chain_id", F.concat(F.lit("\x00"), F.col("line").cast("string"))))
    before = W.partitionBy("source", "_chain").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    linked = good.withColumn("_hash", F.last("hash", ignorenulls=True).over(before)).withColumn("_sequence", F.last("sequence", ignorenulls=True).over(before))
    link = F.when(F.col("_hash").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("_hash")), "chain_discontinuity").when(F.col("_hash").isNull() & ~F.col("anchored"), "unanchored_chain_start")
    step = F.when(F.col("_sequence").isNotNull() & (F.col("sequence") != F.col("_sequence") + 1), "sequence_discontinuity").when(F.col("_sequence").isNull() & (F.col("sequence") != 1), "non_initial_sequence_start")
    found = linked.select("source", "line", "event", F.explode(F.array_compact(F.concat("reasons", F.array(link, step)))).alias("reason"))
    bad = records.where("error is not null").select("source", "line", "event", F.col("error").alias("reason"))
    whole = records.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("n"), F.min("chain_id").alias("_a"), F.max("chain_id").alias("_b"))
    if sources is not None:
        whole = sources.select(F.col("source").cast("string").alias("source")).distinct().join(whole, "source", "left")
    of_source = whole.select("source", F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("event"), F.explode(F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) == 0, "empty_log"), F.when(F.col("_a") != F.col("_b"), "multiple_chains_in_one_file")))).alias("reason"))
    return bad.unionByName(found).unionByName(of_source)


def summary(records: DataFrame, found: DataFrame, checked: bool) -> DataFrame:
    """One row for each source: its records, ends, counts, and whether it is continuous and, signatures being ``checked``, authentic."""
    place = lambda c: F.when(F.col(c).isNotNull(), F.col("line"))
    good = F.col("error").isNull()
    s = records.groupBy("source").agg(
        F.count_if(good).alias("total_events"), F.min_by("timestamp", place("timestamp")).alias("first_timestamp"), F.max_by("timestamp", place("timestamp")).alias("last_timestamp"),
        F.min_by("sequence", place("sequence")).alias("first_sequence"), F.max_by("sequence", place("sequence")).alias("last_sequence"), F.max_by("hash", place("hash")).alias("terminal_hash"),
        F.count_if(F.col("verified")).alias("signatures_valid"), F.count_if(good & ~F.col("signed")).alias("unsigned_events"), F.min("chain_id").alias("chain_id"),
    )
    b = found.groupBy("source").agg(F.count(F.lit(1)).alias("n_breaks"), F.count_if(F.col("reason").isin("invalid_signature", "invalid_signature_encoding")).alias("signatures_invalid"))
    s = s.join(b, "source", "full").fillna(0, ["n_breaks", "signatures_invalid", "total_events", "signatures_valid", "unsigned_events"])
    s = s.withColumn("chain_valid", F.col("n_breaks") == 0)
    return s.withColumn("authentic", F.lit(checked) & F.col("chain_valid") & (F.col("signatures_valid") > 0) & (F.col("signatures_invalid") == 0) & (F.col("unsigned_events") == 0))


def checkpoint(summaries: DataFrame) -> DataFrame:
    """One row over all chains: totals, and a hash of the chains' ends in order of their sources; ``refused`` names the first source that is not authentic.

    A chain is one row; the manifest is the concatenation of their digests, so it is of the number of logs, not of records.
    """
    line = F.concat_ws("|", F.coalesce("chain_id", F.lit("")), F.col("first_sequence").cast("string"), F.col("last_sequence").cast("string"), "terminal_hash", F.col("total_events").cast("string"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("source", F.sha2(line, 256).alias("h")))), lambda x: x["h"])
    return summaries.agg(F.count(F.lit(1)).alias("total_chains"), F.sum("total_events").alias("total_events"), F.min(F.when(~F.col("authentic"), F.col("source"))).alias("refused"), F.sha2(F.array_join(digests, ""), 256).alias("manifest_hash"))


def verify_checkpoint(checkpoint_row: DataFrame, summaries: DataFrame) -> DataFrame:
    """The checkpoint with ``valid``: whether the logs still give its totals and its hash."""
    now = checkpoint(summaries)
    same = (F.col("total_chains") == F.col("_n")) & (F.col("total_events") == F.col("_e")) & (F.col("manifest_hash") == F.col("_h")) & F.col("_r").isNull()
    again = now.select(F.col("total_chains").alias("_n"), F.col("total_events").alias("_e"), F.col("manifest_hash").alias("_h"), F.col("refused").alias("_r"), F.lit(1).alias("_k"))
    return checkpoint_row.withColumn("_k", F.lit(1)).join(again, "_k").withColumn("valid", F.coalesce(same, F.lit(False))).drop("_k", "_n", "_e", "_h", "_r")
