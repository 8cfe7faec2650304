import json
import random

import pytest

from palimpsest.streaming import json_text as J

TEXTS = [
    '{"a": "x", "b\\"c": ["y", "z\\\\", {"k": null, "e": ""}], "n": -1.5e3, "t":true}',
    '["a","b",["c"],{"d":"e"}]',
    '"lone \\u00e9 string"',
    " 12 ",
    '{"a":{"b":{"c":["\\"}{"]}}}',
    "",
    '{"broken": "never closed \\',
]


def merged(pieces):
    out = {}
    for v, t in pieces:
        out[v] = out.get(v, "") + t
    return {v: t for v, t in out.items() if v >= 0}


def scalars(node):
    if isinstance(node, dict):
        return [x for v in node.values() for x in scalars(v)]
    if isinstance(node, list):
        return [x for v in node for x in scalars(v)]
    return [node]


@pytest.mark.parametrize("text", TEXTS)
def test_every_cut_gives_the_same_values(text):
    whole = J.Lexer().feed(text)
    assert "".join(t for _, t in whole) == text
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            lexer = J.Lexer()
            pieces = [p for part in (text[:a], text[a:b], text[b:]) for p in lexer.feed(part)]
            assert "".join(t for _, t in pieces) == text and merged(pieces) == merged(whole)
    lexer = J.Lexer()
    assert merged([p for c in text for p in lexer.feed(c)]) == merged(whole)


@pytest.mark.parametrize("text", TEXTS[:5])
def test_values_are_those_of_the_parser(text):
    got = merged(J.Lexer().feed(text))
    want = scalars(json.loads(text))
    read = lambda raw, v: json.loads(f'"{raw}"') if isinstance(v, str) else json.loads(raw)
    full = [got.get(i, "") for i in range(len(want))]
    assert [read(r, v) for r, v in zip(full, want)] == want


def test_random_payloads():
    rng = random.Random(1)

    def node(depth):
        kind = rng.randrange(4 if depth < 5 else 2)
        if kind == 0:
            return rng.choice(['q"\\', "é\n", "", "[{:,}]", "plain"])
        if kind == 1:
            return rng.choice([0, -7, 1.25, True, None])
        return [node(depth + 1) for _ in range(rng.randrange(4))] if kind == 2 else {rng.choice('ab"\\{') + str(i): node(depth + 1) for i in range(rng.randrange(4))}

    for _ in range(200):
        payload = [node(0)]
        text = json.dumps(payload, ensure_ascii=rng.random() < 0.5)
        lexer, pieces, at = J.Lexer(), [], 0
        while at < len(text):
            n = rng.randint(1, 9)
            pieces += lexer.feed(text[at : at + n])
            at += n
        got, want = merged(pieces), scalars(payload)
        assert [json.loads(f'"{got.get(i, "")}"') if isinstance(v, str) else json.loads(got[i]) for i, v in enumerate(want)] == want and not lexer.brackets


def test_depth_is_bounded():
    with pytest.raises(J.TooDeep):
        J.Lexer(max_depth=3).feed("[[[[")


def test_stream_and_batch_agree(spark, tmp_path):
    rows = []
    for s, text in enumerate([TEXTS[0], TEXTS[4], "[" * 9 + "1"]):
        parts = [text[i : i + 7] for i in range(0, len(text), 7)]
        rows += [(f"s{s}", k, p, k == len(parts) - 1) for k, p in enumerate(parts)]
    schema = "stream_id string, seq long, delta string, is_final boolean"
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 8):
        spark.createDataFrame(rows[k : k + 8], schema).coalesce(1).write.mode("append").parquet(path)
    batch = J.batch_slices(spark.read.parquet(path), 6)
    want = sorted(batch.collect())
    assert [(r.stream_id, r.error) for r in want if r.error] == [("s2", "too_deep")]
    assert {(r.stream_id, r.value): r.text for r in J.values(batch).collect() if r.stream_id == "s0"} == {("s0", v): t for v, t in merged(J.Lexer().feed(TEXTS[0])).items()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = J.stream_slices(stream, 6).writeStream.format("memory").queryName("slices").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(spark.table("slices").collect()) == want
