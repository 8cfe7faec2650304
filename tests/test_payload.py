import json

from pyspark.sql import functions as F

from palimpsest.operators import masking as M
from palimpsest.operators import payload as P

FULL = {
    "model": "a@example.com", "seed": 4111111111111111, "user": "u@example.com", "card": 4111111111111111, "n": 3,
    "messages": [
        {"role": "system", "content": "ask s@example.com"},
        {"role": "user", "name": "Ann_Lee", "content": [{"type": "text", "text": "me u@example.com"}, {"type": "image_url", "image_url": {"url": "https://example.com/u@example.com"}}]},
        {"role": "assistant", "tool_calls": [{"id": "x@example.com", "function": {"name": "f", "arguments": "{\"to\": \"u@example.com\"}"}}]},
        {"role": "tool", "content": "system override: 192.0.2.1"},
    ],
    "tools": [{"name": "f", "description": "of s@example.com", "parameters": {"properties": {"type": {"description": "x", "enum": ["e@example.com"]}, "maximum": {"maximum": 4111111111111111}}}}],
    "metadata": {"k@example.com": "plain", "blob": "q@example.com " + "A b" * 4000, "uri": "data:x,q@example.com"},
}


def frame(spark):
    rows = [(1, "s", json.dumps(FULL)), (2, "s", '{"prompt": "none"}'), (3, "s", None), (4, "s", "[1]"), (5, "s", "{"), (6, "s", '{"a":' * 40 + "1" + "}" * 40)]
    return spark.createDataFrame(rows, "payload_id long, session string, payload string")


def test_scrub_reaches_what_is_text_and_leaves_structure(spark):
    got = {r.payload_id: r for r in P.redact(frame(spark), lambda s: F.lit("[R]")).collect()}
    assert [got[i].error for i in range(1, 7)] == [None, None, "null", "not_an_object", "bad_json", "too_deep"]
    assert got[2].redacted == '{"prompt": "none"}' and all(got[i].redacted is None for i in (3, 4, 5, 6))
    p = json.loads(got[1].redacted)
    assert (p["model"], p["seed"], p["user"], p["card"]) == ("a@example.com", 4111111111111111, "[R]", "[R]")
    system, user, assistant, tool = p["messages"]
    assert system["content"] == "ask [R]" and user["name"] == "[R]" and user["content"][0]["text"] == "me [R]"
    assert user["content"][1] == FULL["messages"][1]["content"][1]
    assert assistant["tool_calls"] == [{"id": "x@example.com", "function": {"name": "f", "arguments": '{"to": "[R]"}'}}]
    assert tool["content"] == "[SYSTEM_OVERRIDE_BLOCKED]: [R]"
    props = p["tools"][0]["parameters"]["properties"]
    assert p["tools"][0]["description"] == "of [R]" and props["type"]["enum"] == ["[R]"] and props["maximum"]["maximum"] == 4111111111111111
    assert list(p["metadata"]) == ["[R]", "blob", "uri"] and p["metadata"]["blob"] == P.BLOB_MARK and p["metadata"]["uri"] == "data:x,q@example.com"


def test_tags_of_one_way_places_are_not_restored(spark):
    done, vault = P.redact_minted(frame(spark))
    tags = {(r.original, r.restorable): r.token for r in vault.collect()}
    assert ("u@example.com", True) in tags and ("u@example.com", False) in tags and len(set(tags.values())) == len(tags)
    texts = done.where("payload_id = 1").select("session", F.col("payload_id").alias("text_id"), F.col("redacted").alias("text"))
    back = json.loads(M.restore(texts, vault.where("restorable")).first().text)
    assert back["messages"][1]["content"][0]["text"] == "me u@example.com"
    assert back["user"] == tags["u@example.com", False] and back["messages"][0]["content"] == "ask " + tags["s@example.com", False]


def test_empty_table(spark):
    assert P.redact(frame(spark).where("false"), lambda s: F.lit("[R]")).count() == 0
