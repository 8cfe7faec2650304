"""Stateless rewriting of JSON trees: each value becomes a stand-in, and beside it goes the cipher text that restores it.

A field ``k`` gets a sibling ``_ctx_hash_k``; an element of an array becomes an
object of stand-in and cipher text. Nothing has to be kept for restoring but the
key. Detection, ciphers and stand-ins are expressions; Python only takes trees
apart and puts them together. A tree that is too deep, has too many brackets, is
no JSON or already holds a reserved field gives a null result and an error.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import detect as D
from palimpsest.functions.synthetic import stand_in
from palimpsest.functions.text import hmac_sha256, in_parts
from palimpsest.operators import masking as M

SIDE, HELD, CIPHER = "_ctx_hash_", "_shield_val", "_shield_ctx"
ENVELOPE = frozenset(("jsonrpc", "method", "id"))
MAX_DEPTH, MAX_BRACKETS, VERSION = 40, 2000, 1
Visit = Callable[[str, str], object]


def session_key(secret: bytes, salt: bytes, info: Column) -> Column:
    """HKDF-SHA256 of 32 bytes for each info string; the secret's part is made on the driver."""
    root = hmac.new(salt, secret, hashlib.sha256).digest()
    return F.unhex(hmac_sha256(root, F.concat(info, F.lit("\x01"))))


def seal(value: Column, key: Column, aad: Column) -> Column:
    """Version, nonce, cipher text and tag, URL-safe."""
    raw = F.concat(F.unhex(F.lit(f"{VERSION:04x}")), F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad.cast("binary")))
    return F.rtrim(F.translate(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def unseal(token: Column, key: Column, aad: Column) -> Column:
    """The value; null where version, key or field are not those it was sealed with."""
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    body = F.substring(raw, 3, 1 << 30)
    return F.when(F.hex(F.substring(raw, 1, 2)) == f"{VERSION:04X}", F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string"))


def _mutate(node, visit: Visit, depth: int = 0, in_batch: bool = False):
    if depth >= MAX_DEPTH:
        raise ValueError("too_deep")
    if isinstance(node, dict):
        out, side = {}, {}
        for k, v in node.items():
            if (depth == 0 or depth == 1 and in_batch) and k in ENVELOPE:
                out[k] = v
            elif isinstance(v, (dict, list)):
                out[k] = _mutate(v, visit, depth + 1)
            else:
                edit = visit(v, k) if isinstance(v, str) else None
                out[k] = v if edit is None else edit[0]
                if edit is not None:
                    if SIDE + k in node:
                        raise ValueError("reserved_field")
                    side[SIDE + k] = edit[1]
        return {**out, **side}
    if isinstance(node, list):
        out = []
        for v in node:
            edit = visit(v, "[]") if isinstance(v, str) else None
            out.append(_mutate(v, visit, depth + 1, depth == 0) if isinstance(v, (dict, list)) else v if edit is None else {HELD: edit[0], CIPHER: edit[1]})
        return out
    return node


def _restore(node, visit: Visit, depth: int = 0):
    if depth >= MAX_DEPTH:
        raise ValueError("too_deep")
    if isinstance(node, dict):
        if set(node) == {HELD, CIPHER}:
            plain = visit(node[CIPHER], node[HELD]) if isinstance(node[CIPHER], str) and isinstance(node[HELD], str) else None
            return node if plain is None else plain
        out = {k: _restore(v, visit, depth + 1) for k, v in node.items() if not k.startswith(SIDE)}
        for k, v in node.items():
            if k.startswith(SIDE):
                plain = visit(v, k[len(SIDE) :]) if isinstance(v, str) and k[len(SIDE) :] in node else None
                out[k if plain is None else k[len(SIDE) :]] = v if plain is None else plain
        return out
    return [_restore(v, visit, depth + 1) for v in node] if isinstance(node, list) else node


def _run(walk, text: str | None, visit: Visit) -> tuple[object, str | None]:
    if text is None:
        return None, "null"
    if text.count("{") + text.count("[") > MAX_BRACKETS:
        return None, "too_many_brackets"
    try:
        return walk(json.loads(text), visit), None
    except RecursionError:
        return None, "too_deep"
    except ValueError as e:
        return None, str(e) if str(e) in ("too_deep", "reserved_field") else "bad_json"


def _leaves(walk):
    @F.pandas_udf("struct<leaves:array<struct<n:int,field:string,value:string>>,error:string>")
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for (texts,) in in_parts(batches):
            rows, errors = [], []
            for text in texts:
                found: list = []
                error = _run(walk, text, lambda v, k, found=found: found.append({"n": len(found), "field": k, "value": v}))[1]
                rows.append([] if error else found)
                errors.append(error)
            yield pd.DataFrame({"leaves": rows, "error": errors})

    return take


def _rebuilt(walk):
    @F.pandas_udf("struct<out:string,error:string>")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, edits in in_parts(batches):
            rows = []
            for text, edit in zip(texts, edits):
                new, count = ({e["n"]: e for e in edit} if edit is not None else {}), iter(range(1 << 60))

                def visit(value, field, new=new, count=count):
                    e = new.get(next(count))
                    return None if e is None else e["plain"] if walk is _restore else (e["plain"], e["cipher"])

                tree, error = _run(walk, text, visit)
                rows.append((None if error else json.dumps(tree, ensure_ascii=False), error))
            yield pd.DataFrame(rows, columns=["out", "error"])

    return put


def _assembled(walk, rows: DataFrame, edits: DataFrame, key: str, payload: str, name: str) -> DataFrame:
    grouped = edits.groupBy(key).agg(F.collect_list(F.struct("n", "plain", "cipher")).alias("_e"))
    done = rows.join(grouped, key, "left").withColumn("_o", F.explode(F.array(_rebuilt(walk)(F.col(payload), F.col("_e")))))
    return done.select(*rows.columns, F.col("_o.out").alias(name), F.col("_o.error").alias("error"))


def mutate(payloads: DataFrame, cipher_key: Column, seed: bytes, key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """payloads with ``mutated`` and ``error``. A string that holds a value is sealed as a whole, and shown with a stand-in
    for each of its values. A cipher text opens for its field alone, an array element's for its stand-in. ``cipher_key`` is a column of payloads (see session_key)."""
    taken = payloads.select(key, cipher_key.alias("_key"), F.explode(F.array(_leaves(_mutate)(F.col(payload)))).alias("_l"))
    leaf = D.with_spans(taken.select(key, "_key", F.explode("_l.leaves").alias("x")).select(key, "_key", "x.*"), "value").where(F.size("spans") > 0)
    fake = M.splice(F.col("value"), F.col("spans"), lambda s: stand_in(hmac_sha256(seed, F.concat_ws("\x1f", s["entity_type"], s["matched"])), s["entity_type"]))
    edits = leaf.select(key, "n", fake.alias("plain"), seal(F.col("value"), F.col("_key"), F.when(F.col("field") == "[]", fake).otherwise(F.col("field"))).alias("cipher"))
    return _assembled(_mutate, payloads, edits, key, payload, "mutated")


def unmutate(payloads: DataFrame, cipher_key: Column, key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """payloads with ``restored`` and ``error``; what does not open stays as it is."""
    taken = payloads.select(key, cipher_key.alias("_key"), F.explode(F.array(_leaves(_restore)(F.col(payload)))).alias("_l"))
    leaf = taken.select(key, "_key", F.explode("_l.leaves").alias("x")).select(key, "_key", "x.*")
    edits = leaf.select(key, "n", unseal(F.col("value"), F.col("_key"), F.col("field")).alias("plain"), F.lit("").alias("cipher")).where("plain is not null")
    return _assembled(_restore, payloads, edits, key, payload, "restored")


@F.pandas_udf(StringType())
def mutated_schema(schemas: pd.Series) -> pd.Series:
    """A JSON schema whose string properties each have their sibling, required where the property is; null if it is no JSON."""

    def grow(node):
        if isinstance(node, list):
            return [grow(x) for x in node]
        if not isinstance(node, dict):
            return node
        out = {k: grow(v) for k, v in node.items()}
        props = node.get("properties")
        if isinstance(props, dict):
            sides = [k for k, v in props.items() if isinstance(v, dict) and v.get("type") == "string"]
            out["properties"] = {**out["properties"], **{SIDE + k: {"type": "string"} for k in sides}}
            if isinstance(node.get("required"), list):
                out["required"] = node["required"] + [SIDE + k for k in sides if k in node["required"]]
        return out

    def one(text):
        try:
            return json.dumps(grow(json.loads(text)), ensure_ascii=False)
        except (ValueError, TypeError, RecursionError):
            return None

    return schemas.map(one)
