"""Rewriting of JSON payloads, by their leaves.

A payload is taken apart into leaves by an Arrow function (one pass, no
detection in Python), the leaves are searched by the Catalyst expressions of
``functions.detect``, and a second Arrow pass puts what they became back in
place. Both passes are the same walk, so a leaf's ordinal names its place.

A leaf's kind says how it is searched: ``text`` in full; ``number`` for card
numbers only; ``key`` by the detectors that are trusted on names; ``name`` as
text with underscores for spaces; ``blob`` at its two edges. Nulls and text that
is no JSON object give no leaves and an error, and never a rewritten payload.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from palimpsest.functions import detect as D
from palimpsest.functions import text as T
from palimpsest.operators import masking as M

# Keys by what their values are. ---------------------------------
PROTECTED = frozenset(("model", "type", "role", "format", "object", "index", "finish_reason", "$ref", "$schema", "mime_type", "encoding_format"))
NUMERIC_SETTINGS = frozenset(("seed", "max_tokens", "max_completion_tokens", "max_output_tokens", "budget_tokens", "n", "top_k", "top_logprobs", "dimensions", "created", "logprobs"))
TOKEN_IDS = frozenset(("logit_bias",))
SCHEMA_NUMBERS = frozenset((
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "default", "const", "enum", "examples", "example",
    "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains",
    "parameters", "input_schema", "inputSchema", "parametersJsonSchema", "output_schema", "outputSchema", "response_schema", "responseSchema",
    "responseJsonSchema", "json_schema", "schema", "requestedSchema",
))
SCHEMA_NAMES = frozenset(("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies"))
SCHEMA_DATA = frozenset(("enum", "const", "examples", "default"))
TOOL_PROSE = frozenset(("description", "title"))
TOOLS = frozenset(("tools", "functions"))
END_USER = frozenset(("user", "safety_identifier"))
OPAQUE = frozenset(("id", "tool_call_id", "tool_use_id", "call_id", "name", "signature", "thought_signature", "data", "encrypted_content", "file_id"))
MEDIA = {"image_url": {"url", "detail"}, "input_audio": {"data", "format"}, "file": {"file_data", "file_id", "filename"}, "source": {"type", "media_type", "data", "url", "file_id"}}
PRIVILEGED = frozenset(("system", "developer"))
SHAPES = frozenset(("messages", "prompt", "system", "input", "instructions"))
LOW_CONFIDENCE = ("PHONE", "LONG_DIGIT_RUN", "IP_ADDRESS", "MRN", "SECRET_KEY", "PERSON", "BASE64_OBFUSCATED_PII", "PERCENT_OBFUSCATED_PII", "ENTITY_OBFUSCATED_PII")
BLOB_LENGTH, BLOB_EDGE, MAX_DEPTH, NUMBER_DIGITS = 8192, 256, 20, 9
BLOB_MARK = "[UNMAPPED_BLOB_PII_REDACTED]"
# ------------------------------------------------------------------------------

FIELD_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_\-.$]{0,63}")
LEAVES = StructType([
    StructField("leaves", ArrayType(StructType([
        StructField("n", IntegerType()), StructField("path", StringType()), StructField("kind", StringType()),
        StructField("restorable", BooleanType()), StructField("role", StringType()), StructField("value", StringType()),
    ]))),
    StructField("error", StringType()),
])


class TooDeep(ValueError):
    pass


@dataclass(frozen=True)
class Place:
    """What a walk knows of where it is."""

    path: str = ""
    depth: int = 0
    role: str = ""
    restorable: bool = True
    numbers: bool = True
    protected: frozenset = PROTECTED
    one_way: frozenset = frozenset()
    opaque: frozenset = frozenset()
    names: bool = False
    blobs: bool = False

    def under(self, key: str | int, **changes) -> Place:
        path = f"{self.path}[{key}]" if isinstance(key, int) else f"{self.path}.{key}" if self.path else key
        return replace(self, **{"path": path, "depth": self.depth + 1, "names": False, "opaque": frozenset(), **changes})


Visit = Callable[[str, object, Place], object]


def _is_media(key: str, value: object) -> bool:
    if not isinstance(value, dict) or key not in MEDIA or not set(value) <= MEDIA[key]:
        return False
    held = [v for k, v in value.items() if k in ("url", "data", "file_data")]
    web = all(isinstance(v, str) and (v.startswith(("data:", "http://", "https://")) or re.fullmatch(r"[A-Za-z0-9+/\s]{16,}={0,2}", v)) for v in held)
    return web and (bool(held) or "file_id" in value)


def _field(key: str, value: object, at: Place, visit: Visit) -> object:
    """The value of one field of an object, after what its key says about it."""
    if not at.names:
        if key in at.protected or key in TOKEN_IDS or _is_media(key, value):
            return value
        if key in NUMERIC_SETTINGS and isinstance(value, (int, float)):
            return value
    if key in at.opaque and isinstance(value, str):
        return value
    data = not at.names and key in SCHEMA_DATA
    return walk(value, at.under(
        key, names=not at.names and key in SCHEMA_NAMES, protected=frozenset() if data else at.protected, one_way=frozenset() if data else at.one_way,
        restorable=at.restorable and (at.names or key not in at.one_way), numbers=at.numbers and (at.names or key not in SCHEMA_NUMBERS),
    ), visit)


def walk(node: object, at: Place, visit: Visit) -> object:
    """A copy of a tree in which visit(kind, value, place) stands for each leaf."""
    if at.depth > MAX_DEPTH:
        raise TooDeep(at.path)
    if isinstance(node, str):
        blob = at.blobs and (len(node) > BLOB_LENGTH or node.startswith("data:"))
        return (node if node.startswith("data:") else visit("blob", node, at)) if blob else visit("text", node, at)
    if isinstance(node, list):
        return [walk(x, at.under(k), visit) for k, x in enumerate(node)]
    if isinstance(node, dict):
        out: dict = {}
        for key, value in node.items():
            new = _field(key, value, at, visit)
            named = key
            plain = FIELD_NAME.fullmatch(key) and not re.search(r"\d{4}", key)
            if not plain and (at.names or key not in at.protected):
                named = visit("key", key, at)
                while named != key and (named in out or named in node):
                    named += "_"
            out[named] = new
        return out
    if isinstance(node, (int, float)) and not isinstance(node, bool) and at.numbers and sum(c.isdigit() for c in str(node)) >= NUMBER_DIGITS:
        return visit("number", node, at)
    return node


def _message(message: object, at: Place, visit: Visit) -> object:
    """One turn: text in full, its name, and all other fields but references and media."""
    if not isinstance(message, dict):
        return walk(message, at, visit)
    if "messages" in message:
        return _payload(message, at, visit)
    role = message.get("role")
    role = role if isinstance(role, str) else ""
    here = replace(at, role=role, restorable=role not in PRIVILEGED)
    out = {}
    for key, value in message.items():
        if key == "name" and isinstance(value, str):
            out[key] = visit("name", value, here.under(key))
        elif key == "content" and isinstance(value, list):
            out[key] = [walk(block, here.under(key).under(k, opaque=OPAQUE), visit) for k, block in enumerate(value)]
        elif key in ("tool_calls", "function_call", "content"):
            out[key] = _calls(value, here.under(key, opaque=OPAQUE if key != "tool_calls" else frozenset()), visit)
        else:
            out.update(walk({key: value}, replace(here, opaque=OPAQUE, blobs=True), visit))
    return out


def _calls(value: object, at: Place, visit: Visit) -> object:
    """Tool calls keep the ids and names that link them; their arguments are text."""
    if isinstance(value, list):
        return [_calls(x, at.under(k, opaque=OPAQUE), visit) for k, x in enumerate(value)]
    if isinstance(value, dict):
        out: dict = {}
        for k, v in value.items():
            new = _calls(v, at.under(k, opaque=OPAQUE), visit) if k in ("function", "custom") else None
            out.update({k: new} if new is not None else walk({k: v}, replace(at, protected=at.protected if k != "input" else frozenset()), visit))
        return out
    return walk(value, at, visit)


def _payload(payload: dict, at: Place, visit: Visit) -> dict:
    out: dict = {}
    for key, value in payload.items():
        if key == "messages" and isinstance(value, list):
            out[key] = [_message(m, at.under(key).under(k), visit) for k, m in enumerate(value)]
        elif key == "input" and isinstance(value, list):
            out[key] = [_message(m, at.under(key).under(k), visit) if isinstance(m, dict) else m if isinstance(m, int) else walk(m, at.under(key).under(k), visit) for k, m in enumerate(value)]
        elif key in TOOLS:
            out[key] = walk(value, at.under(key, one_way=TOOL_PROSE, opaque=frozenset()), visit)
        elif key in END_USER:
            out[key] = walk(value, at.under(key, restorable=False), visit)
        elif key in SHAPES:
            ids = key == "prompt" and isinstance(value, list)
            out[key] = [x if isinstance(x, int) else walk(x, at.under(key).under(k), visit) for k, x in enumerate(value)] if ids else walk(value, at.under(key, restorable=key not in ("system", "instructions")), visit)
        else:
            out.update(walk({key: value}, replace(at, blobs=True), visit))
    return out


def _over(text: str | None, visit: Visit, max_brackets: int) -> tuple[object, str | None]:
    """(rewritten tree, error) of one payload."""
    if text is None:
        return None, "null"
    if text.count("{") + text.count("[") > max_brackets:
        return None, "too_many_brackets"
    try:
        tree = json.loads(text)
        if not isinstance(tree, dict):
            return None, "not_an_object"
        return _payload(tree, Place(), visit), None
    except (TooDeep, RecursionError):
        return None, "too_deep"
    except ValueError:
        return None, "bad_json"


def leaves(payload: Column, max_brackets: int = 100_000) -> Column:
    """struct(leaves, error): all leaves that must be searched, in the order of the walk."""

    @F.pandas_udf(LEAVES)
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for (texts,) in T.in_parts(batches):
            rows, errors = [], []
            for text in texts:
                found: list = []

                def visit(kind, value, at, found=found):
                    found.append({"n": len(found), "path": at.path, "kind": kind, "restorable": at.restorable, "role": at.role, "value": value if isinstance(value, str) else json.dumps(value)})
                    return value

                error = _over(text, visit, max_brackets)[1]
                rows.append([] if error else found)
                errors.append(error)
            yield pd.DataFrame({"leaves": rows, "error": errors})

    return take(payload)


def error(payload: Column, max_brackets: int = 100_000) -> Column:
    """What is wrong with a payload, without its leaves."""

    @F.pandas_udf(StringType())
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (texts,) in T.in_parts(batches):
            yield pd.Series([_over(text, lambda kind, value, at: value, max_brackets)[1] for text in texts], dtype=object)

    return check(payload)


def rebuilt(payload: Column, changes: Column, max_brackets: int = 100_000) -> Column:
    """The payload with changes, an array of (n, value), in the places of its leaves."""

    @F.pandas_udf(StringType())
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, edits in T.in_parts(batches):
            out = []
            for text, edit in zip(texts, edits):
                new, count = ({e["n"]: e["value"] for e in edit} if edit is not None else {}), iter(range(1 << 60))
                tree, error = _over(text, lambda kind, value, at: new.get(next(count), value), max_brackets)
                out.append(None if error else json.dumps(tree, ensure_ascii=False))
            yield pd.Series(out, dtype=object)

    return put(payload, changes)


def searched(payloads: DataFrame, key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """payloads(key, payload, ...): one row for each leaf, with its text as searched and its spans."""
    taken = payloads.withColumn("_l", F.explode(F.array(leaves(F.col(payload))))).where("_l.error is null")
    leaf = taken.select(key, F.explode("_l.leaves").alias("_x")).select(key, "_x.*")
    edges = F.concat(F.substring("value", 1, BLOB_EDGE), F.lit("\n"), F.substring(F.col("value"), F.length("value") - BLOB_EDGE - F.length("value") % 4 + 1, F.lit(BLOB_EDGE + 3)))
    whole = T.normalize(T.neutralize(F.col("role"), F.col("value")))
    shown = F.when(F.col("kind") == "blob", edges).when(F.col("kind") == "name", F.translate("value", "_", " ")).otherwise(whole)
    found = D.with_spans(leaf.withColumn("text", F.explode(F.array(shown))), "text")
    card = lambda s: F.length(D.digits(s["matched"])).between(13, 19) & D.is_issuer(D.digits(s["matched"])) & D.luhn(D.digits(s["matched"]))
    trusted = F.filter("spans", lambda s: ~s["entity_type"].isin(*LOW_CONFIDENCE) & ((s["entity_type"] != "CREDIT_CARD") | card(s)))
    whole_number = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("CREDIT_CARD").alias("entity_type"), F.col("text").alias("matched"), F.lit(3).alias("priority")))
    digits = F.regexp_replace("text", "^-|[.]0+$", "")
    number = F.when(digits.rlike("^[0-9]{13,19}$") & D.is_issuer(digits) & D.luhn(digits), whole_number).otherwise(F.array().cast(D.SPAN))
    person = F.when((F.col("kind") == "name") & (F.size("spans") == 0) & F.col("value").rlike(r"^\p{Lu}"), F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("entity_type"), F.col("value").alias("matched"), F.lit(99).alias("priority"))))
    return found.withColumn("spans", F.when(F.col("kind") == "key", trusted).when(F.col("kind") == "number", number).otherwise(F.coalesce(person, F.col("spans"))))


def redact(payloads: DataFrame, token: Callable[[Column], Column], key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """payloads with ``redacted``, ``n_spans`` and ``error``: each span becomes token(span). The changed leaves go back to
    their payload by one join on its key; a payload without any is not moved through Python a second time."""
    found = searched(payloads, key, payload)
    changed = found.where((F.size("spans") > 0) | (F.col("text") != F.col("value")) & F.col("kind").isin("text"))
    return _put_back(payloads, changed.withColumn("new", M.splice(F.col("text"), F.col("spans"), token)), key, payload)


def _put_back(payloads: DataFrame, changed: DataFrame, key: str, payload: str) -> DataFrame:
    new = F.when(F.col("kind") == "blob", BLOB_MARK).when(F.col("kind") == "name", F.translate("new", " ", "_")).otherwise(F.col("new"))
    edits = changed.groupBy(key).agg(F.collect_list(F.struct("n", new.alias("value"))).alias("_edits"), F.sum(F.size("spans")).cast("long").alias("n_spans"))
    joined = payloads.join(edits, key, "left").withColumn("error", error(F.col(payload)))
    done = F.when(F.col("error").isNull(), F.when(F.col("_edits").isNull(), F.col(payload)).otherwise(rebuilt(F.col(payload), F.col("_edits"))))
    return joined.select(*payloads.columns, done.alias("redacted"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "error")


def redact_minted(payloads: DataFrame, session: str = "session", key: str = "payload_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(payloads redacted by numbered tags, vault). Values from one-way places have tags of their own, which the vault
    marks as not restorable; restoring takes the others only. Payloads are searched once: leaves with spans are kept on the executors' disks."""
    hits = searched(payloads, key, payload).where(F.size("spans") > 0).persist(StorageLevel.DISK_ONLY)
    found = hits.join(payloads.select(key, session), key).where(F.col("kind") != "blob")
    one = found.select(session, key, "n", "kind", "restorable", "text", F.explode("spans").alias("s"))
    seen = one.select(session, "restorable", F.col("s.entity_type").alias("entity_type"), F.col("s.matched").alias("original"), F.col(key).alias("turn"), (F.col("n") * F.lit(1 << 24).cast("long") - F.col("s.start")).alias("start"))
    # A tag is one number of its session and type, whichever of the two kinds it is.
    by = F.struct(F.when(F.col("restorable"), F.lit("r")).otherwise("o").alias("way"), F.col("original").alias("value"))
    vault = M.mint(seen.withColumn("original", F.to_json(by)).withColumn("start", -F.col("start")), session)
    value = F.from_json("original", "way string, value string")
    vault = vault.select(session, "token", "entity_type", value["value"].alias("original"), (value["way"] == "r").alias("restorable"))
    tagged = one.withColumn("original", F.col("s.matched")).join(vault.drop("entity_type"), [session, "original", "restorable"])
    spans = F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "token")))
    leaf = tagged.groupBy(key, "n", "kind").agg(F.first("text").alias("text"), spans.alias("spans"))
    blobs = hits.where(F.col("kind") == "blob").select(key, "n", "kind", F.lit(BLOB_MARK).alias("new"), "spans")
    changed = leaf.withColumn("new", M.splice(F.col("text"), F.col("spans"), lambda s: s["token"])).select(key, "n", "kind", "new", F.size("spans").alias("k"))
    changed = changed.unionByName(blobs.select(key, "n", "kind", "new", F.size("spans").alias("k"))).withColumn("spans", F.array_repeat(F.lit(0), F.col("k")))
    return _put_back(payloads, changed, key, payload), vault
