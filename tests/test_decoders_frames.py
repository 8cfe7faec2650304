"""Nested decodings, framing of bytes for every chunk size, bodies, and one use of an identifier."""

import base64
import gzip
import json
import random
import zlib
from datetime import datetime, timedelta
from functools import cache
from urllib.parse import quote

import pytest

from palimpsest.functions import decoders
from palimpsest.sources import frames
from palimpsest.streaming import replay

VALUE = "card 4111-1111-1111-1111"
WRAP = {
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "hex": lambda s: s.encode().hex(),
    "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "codes": lambda s: json.dumps([ord(c) for c in s]),
}


@pytest.mark.parametrize("first", WRAP)
@pytest.mark.parametrize("second", WRAP)
def test_nested_decodings_are_found_and_mapped_back(first, second):
    for lead in ("", "x", "xy", "xyz"):
        run = WRAP[second](WRAP[first](VALUE))
        text = f"say «é» {lead}{run} end" if second in ("base64", "urlsafe") else f"say «é» {run} end"
        complete, found = decoders.decodings(text)
        hits = [(a, b) for a, b, _, _, plain in found if VALUE in plain]
        assert complete and hits and all(run in text[a:b] for a, b in hits)


def test_every_decoding_is_found():
    """Against all ways through the decoders, remembered by text and rounds left."""

    @cache
    def plain(text, rounds):
        if not rounds:
            return frozenset()
        once = {x for _, pattern, decode in decoders.DECODERS for m in pattern.finditer(text) for x in decode(m[0]) if x.strip()}
        return frozenset(once.union(*(plain(x, rounds - 1) for x in once)))

    rng = random.Random(3)
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 3)):
            s = "".join(rng.choices("abc %é4", k=rng.randint(4, 20)))
            for _ in range(rng.randint(0, 2)):
                s = WRAP[rng.choice(list(WRAP))](s)
            parts.append(s)
        text = " ".join(parts)
        assert {t for *_, t in decoders.decodings(text)[1]} == plain(text, decoders.ROUNDS) - {text}


def test_hidden_texts_as_a_column(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "plain prose"), (4, quote(WRAP["base64"](VALUE)) + " " + "A" * 300_000)], "k long, t string").repartition(2)
    got = {r.k: r.h for r in rows.select("k", decoders.hidden_texts("t").alias("h")).collect()}
    assert got[1].complete is None and got[2].complete and not got[2].decodings and not got[3].decodings
    assert any(VALUE in d.text for d in got[4].decodings)


TEXT = "a\r\nb\n\nçé日\rlast\r\n\r\n😀 end"


@pytest.mark.parametrize("size", range(1, 9))
def test_lines_for_every_chunk_size(size):
    data, f = TEXT.encode(), frames.Framer()
    got = [line for i in range(0, len(data), size) for line in f.feed(data[i : i + size])] + list(f.end())
    assert got == ["a", "b", "", "çé日", "last", "", "😀 end"]


def test_framed_sources(spark):
    data = TEXT.encode()
    rows = [("a", i, data[i * 3 : i * 3 + 3]) for i in range(len(data) // 3 + 1)] + [("long", 0, b"ok\nxxxx"), ("long", 1, b"yyyyyyyyyyyyyy"), ("long", 2, b"\nlater"), ("bad", 0, b"\xff\n"), ("bad", 1, None), ("none", 0, b"")]
    got = {}
    for r in sorted(frames.framed(spark.createDataFrame(rows, "source string, seq long, bytes binary").repartition(3), 12).collect(), key=lambda r: (r.source, r.line)):
        got.setdefault(r.source, []).append(r.error or r.text)
    assert got == {"a": TEXT.replace("\r\n", "\n").replace("\r", "\n").split("\n"), "long": ["ok", "line_too_long"], "bad": ["�"]}


def test_bodies(spark):
    def chunked(b, size=5):
        return b"".join(b"%x;q=1\r\n%s\r\n" % (len(b[i : i + size]), b[i : i + size]) for i in range(0, len(b), size)) + b"0\r\n\r\n"

    body, raw = b"hello " * 50, zlib.compressobj(9, zlib.DEFLATED, -15)
    cases = [
        (body, None, None, body, None), (chunked(body), "chunked", "", body, None), (gzip.compress(body), None, "gzip", body, None), (zlib.compress(body), None, "deflate", body, None),
        (raw.compress(body) + raw.flush(), None, "deflate", body, None), (chunked(gzip.compress(zlib.compress(body))), "gzip, Chunked", "deflate, GZIP", body, None), (None, None, None, b"", None),
        (b"5\r\nhell", "chunked", None, None, "bad_chunk"), (b"x", None, "br", None, "unknown_encoding"), (b"x", None, "gzip", None, "bad_data"), (gzip.compress(bytes(5000)), None, "gzip", None, "too_long"), (gzip.compress(body)[:-4], None, "gzip", None, "bad_data"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, body binary, transfer string, encoding string")
    got = [(r.plain and bytes(r.plain) if r.plain is None else bytes(r.plain), r.error) for r in frames.bodies(df, 1000).orderBy("i").collect()]
    assert got == [c[3:] for c in cases]


def test_replays(spark, tmp_path):
    start = datetime(2024, 1, 1)
    uses = [("k", "a", 0), ("k", "a", 100), ("k", "b", 110), ("k", "a", 419), ("k", "a", 421), ("j", "a", 425), ("k", "a", 900)]
    rows = [(i, k, j, start + timedelta(seconds=s)) for i, (k, j, s) in enumerate(uses)]
    schema = "id long, jkt string, jti string, ts timestamp"
    got = {r.id: r.replayed for r in replay.replays(spark.createDataFrame(rows, schema), ["jkt", "jti"], "ts", "id").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    path = str(tmp_path / "in")
    # Inside the period a repeat is dropped, also in a later batch; once the watermark has passed the period's end, it is new.
    later = [*rows[:3], (7, "x", "x", start + timedelta(seconds=2000)), (9, "y", "y", start + timedelta(seconds=2001)), (8, "k", "a", start + timedelta(seconds=2002))]
    for part in ([later[0]], later[1:3], [later[3]], [later[4]], [later[5]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = replay.first_uses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["jkt", "jti"], "ts")
    q = stream.writeStream.format("memory").queryName("uses").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(r.id for r in spark.table("uses").collect()) == [0, 2, 7, 8, 9]
