"""Images that carry data out, URLs in any form, conversations that begin with the user, cipher texts of array elements."""

import json

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import governance as G
from palimpsest.operators import mutation as M


def test_images(spark):
    rows = [("![a](https://h.example/x.png) ![b c](https://h.example/?q=1)", None), ("x ![](http://h.example/LEAK/y) z", []), ("![n](https://h.example/joe-smith)![m](https://h.example/abc)", ["joe-smith", "abc"]), ("no image ![", ["abcd"]), (None, ["abcd"])]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, o array<string>").select(T.block_images(F.col("t"), F.col("o"))).collect()]
    assert got == ["![a](https://h.example/x.png) ![b c]([IMAGE_EXFILTRATION_BLOCKED])", "x ![]([IMAGE_EXFILTRATION_BLOCKED]) z", "![n]([IMAGE_EXFILTRATION_BLOCKED])![m](https://h.example/abc)", "no image ![", None]
    assert spark.createDataFrame(rows[:1], "t string, o array<string>").select(T.block_images(F.col("t"))).first()[0] == got[0]


def test_urls_of_any_form_are_found_and_refused(spark):
    odd = ["HTTP://h.example/x", "http:h.example", "http:\\\\h.example", "hTTps:/h.example", "https:///h.example", "http:@h", "http:%68", "http:[::1]", "http:0", "http:2130706433", "http://ж.example"]
    rows = spark.createDataFrame([(u,) for u in odd], "u string").select("u", G.find_urls(F.concat(F.lit('say "'), "u", F.lit('" now'))).alias("f"), G.host(F.col("u")).alias("h"))
    got = rows.collect()
    assert all(r.f == [r.u] for r in got)
    assert [r.h for r in got] == ["h.example", *[None] * 10]
    none = spark.createDataFrame([("https:) http: https:443. http:8080) xhttp https://",), ("see (https://a.example/b), and https://[::1]/ or http:\\/\\/c.example.",)], "t string").select(G.find_urls(F.col("t"))).collect()
    assert [r[0] for r in none] == [[], ["https://a.example/b", "https://[::1]/", "http://c.example"]]


def test_conversations_begin_with_the_user(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "b"), (2, 0, "user", "c"), (3, 0, "system", "s"), (3, 1, "assistant", "d"), (4, 0, "tool", "e")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.block, r.role, r.text, r.system) for r in G.user_first(G.collapse_roles(turns)).collect())
    assert got == [(1, 0, "user", "Hello", None), (1, 1, "assistant", "a", None), (1, 2, "user", "b", None), (2, 1, "user", "c", None), (3, 0, "user", "Hello", "s"), (3, 1, "assistant", "d", "s"), (4, 1, "user", "e", None)]


def test_array_elements_open_for_their_own_stand_in_only(spark):
    payload = {"to": ["ann@example.com", "bob@example.org"], "note": "x"}
    df = spark.createDataFrame([(1, json.dumps(payload))], "payload_id long, payload string")
    key = M.session_key(b"secret", b"salt", F.lit("s"))
    mutated = M.mutate(df, key, b"seed").first().mutated
    node = json.loads(mutated)
    back = lambda n: json.loads(M.unmutate(spark.createDataFrame([(1, json.dumps(n))], "payload_id long, payload string"), key).first().restored)
    assert back(node) == payload and "ann@" not in mutated and "bob@" not in mutated
    a, b = node["to"]
    a["_shield_ctx"], b["_shield_ctx"] = b["_shield_ctx"], a["_shield_ctx"]
    assert back(node)["to"] == [a, b]


def test_ordinals_do_not_depend_on_the_runs(spark):
    import random

    from palimpsest.operators import masking

    rng = random.Random(2)
    rows = [("s" if rng.random() < 0.7 else None, rng.choice(["EMAIL", "PHONE"]), f"v{rng.randrange(80)}", rng.choice([None, *range(40)]), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "session string, entity_type string, original string, turn long, start int")
    one, many = (sorted((r.session or "", r.original, r.token) for r in masking.mint(df, span=s).collect()) for s in (10_000, 3))
    assert one == many and len({r[::2] for r in one}) == len(one)
