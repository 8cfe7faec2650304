"""Replies that stream, against the whole text, for every split into up to three chunks."""

from itertools import combinations

import pytest

from palimpsest.streaming import replies as R

VAULT = {"[EMAIL_1]": "ann@example.com", "[EMAIL_12]": "bob@example.com", "Maya": "Zoë", "Mayan": "Roman", "x y": "two words", "__": "low", "": "nothing", "née": "born"}
TEXTS = ["hi [EMAIL_1], [EMAIL_12]! Maya, Mayans and Mayan", "Maya", "xMaya [EMAIL_[EMAIL_1]1]", "a x yx y x y_x y", "____ __", "née fiancénée 日née日", "[EMAIL_", "", "Maya Maya"]


def reply(vault=VAULT, **rules):
    rules = R.Rules(**rules)
    return R.Reply(rules, R.Scanner(rules.patterns) if rules.window else None, dict(vault))


def chunked(text, cuts, **rules):
    r = reply(**rules)
    at = [0, *cuts, len(text)]
    return "".join(r.push((0, "content", -1), text[a:b]) for a, b in zip(at, at[1:])) + "".join(t for _, t in r.drain(0))


def splits(text):
    return [c for k in (0, 1, 2) for c in combinations(range(1, len(text)), k)]


@pytest.mark.parametrize("text", TEXTS)
def test_restored_for_every_split(text):
    assert len({chunked(text, c) for c in splits(text)}) == 1


def test_restored_text():
    assert chunked(TEXTS[0], ()) == "hi ann@example.com, bob@example.com! Zoë, Mayans and Roman"
    assert chunked("xMaya Maya_ [EMAIL_[EMAIL_1]1]", ()) == "xMaya Maya_ [EMAIL_ann@example.com1]"
    assert chunked("née fiancénée 日née日", ()) == "born fiancénée 日born日"
    assert chunked("a" * 50, range(1, 50)) == "a" * 50


def test_masked_for_every_split():
    text = "pay 4111 1111 1111 1111 now, mail joe@example.com or [EMAIL_1]; host 192.0.2.77 and  900-55-1234"
    whole = chunked(text, (), window=24)
    assert "4111" not in whole and "joe@" not in whole and "192.0" not in whole and "900-55" not in whole and "ann@example.com" in whole
    assert {chunked(text, c, window=24) for c in splits(text)} == {whole}
    assert chunked(text, range(1, len(text)), window=24) == whole


def test_own_values_are_not_masked():
    vault = {"joe@example.com": "ann@example.org"}
    r = reply(vault, window=24)
    out = r.push((0, "content", -1), "to joe@example.com and eve@example.com.") + "".join(t for _, t in r.drain(None))
    assert out == "to ann@example.org and [EMAIL_REDACTED]."


def test_the_window_is_bounded():
    r = reply({}, window=24)
    for _ in range(100):
        r.push((0, "content", -1), "7")
        assert len(r.windows[(0, "content", -1)][0]) <= 72


def test_order_of_draining_and_failures():
    r = reply(max_windows=4)
    rows = [x for key in ((1, "content", None), (0, "tool", 2), (0, "content", None), (0, "reasoning", None)) for x in r.event(1, key[0], key[1], key[2], "May", False)]
    assert not rows
    assert [x[2:5] for x in r.event(2, 0, None, None, "", True)] == [(0, "reasoning", None), (0, "content", None), (0, "tool", 2)]
    assert [x[2:] for x in r.event(3, None, None, None, "", True)] == [(1, "content", None, "May", None)]
    r = reply(max_windows=2)
    with pytest.raises(R.Closed):
        for k in range(3):
            rows = list(r.event(k, k, "content", None, "May", False))
    r = reply(canary="TRAP")
    assert r.push((0, "content", -1), "ok TR") == "ok "
    with pytest.raises(R.Closed):
        r.push((0, "content", -1), "AP")
    with pytest.raises(R.Closed):
        reply(max_length=10).push((0, "content", -1), "[EMAIL_1]")


def test_stream_and_batch_agree(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    text = TEXTS[0]
    rows = []
    for s in range(2):
        at = 0
        for k, piece in enumerate(text[i : i + 5 + s] for i in range(0, len(text), 5 + s)):
            rows.append((f"s{s}", at, k % 2, "content" if s else "tool", None if s else 4, piece, False))
            at += 1
        rows.append((f"s{s}", at, None, None, None, None, True))
    rows += [("many", k, k, "content", None, "May", False) for k in range(5)] + [("open", 0, 0, "content", None, "Maya", False)]
    vault = spark.createDataFrame([(s, t, o) for s in ("s0", "s1", "many", "open") for t, o in VAULT.items() if t[:1] in "[M" and t], "stream_id string, token string, original string")
    rules = R.Rules(max_windows=4)
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 16):
        spark.createDataFrame(rows[k : k + 16], R.EVENT).coalesce(1).write.mode("append").parquet(path)
    joined = lambda found: {k: "".join(t for *_, t in sorted(v)) for k, v in found.items()}

    def by_channel(out):
        found, errors = {}, {r.stream_id: r.error for r in out if r.error}
        for r in out:
            if not r.error:
                found.setdefault((r.stream_id, r.choice, r.channel, r.tool), []).append((r.seq, r.part, r.text))
        return joined(found), errors

    batch, errors = by_channel(R.batch_replies(spark.read.parquet(path), vault, rules).collect())
    want = {}
    for s, _, c, ch, t, d, _ in rows:
        if s.startswith("s"):
            want[(s, c, ch, t)] = want.get((s, c, ch, t), "") + (d or "")
    want = {k: "".join(chunked(v, ())) for k, v in want.items() if v}
    assert {k: v for k, v in batch.items() if k[0].startswith("s")} == want and batch[("open", 0, "content", None)] == "Zoë" and errors == {"many": "windows"}
    stream = spark.readStream.schema(R.EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    q = R.stream_replies(stream, vault, rules).writeStream.format("memory").queryName("replies").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(900)  # each access to the state is a call of its own: minutes
    got, errors = by_channel(spark.table("replies").collect())
    assert got == {k: v for k, v in batch.items() if k[0].startswith("s")} and errors == {"many": "windows"}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
