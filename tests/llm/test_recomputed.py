"""Scores and predictions of the trained classifiers, computed again from their weights in plain Python, for a whole table."""

import math
import os
import re
import unicodedata

import numpy as np
import pytest

from palimpsest.llm import langid, shared, tokencount, toxicity
from palimpsest.llm.blocks import Block

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
WHOLE = (1 << 64) - 1


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def hash_of(word):
    return int(Block(np.frombuffer(word, np.uint8), np.array([0, len(word)]), 0, np.zeros(1, bool)).hashes(np.array([0]), np.array([len(word)]))[0])


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.where(shared.crc_fold("doc_id", 5) != 0), labels.where(shared.crc_fold("doc_id", 5) != 0))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.op4_toxicity(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and len(weights) > 20
    for r in rows:
        features = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower()):
            features.add(hash_of(word) ^ (0x5851F42D4C957F2D & WHOLE))
            features |= {hash_of(word[:k]) ^ (k * 0x5851F42D4C957F2D & WHOLE) for k in toxicity.PREFIXES if len(word) > k}
        want = sigmoid(model.bias + sum(weights.get(f, 0.0) for f in features))
        assert got[r.doc_id][0] == pytest.approx(want, abs=1e-9) and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)


def folded(text):
    out = []
    for i, b in enumerate(raw := text.encode()):
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            b += 0x20
        elif b < 128:
            c = chr(b).lower()
            b = ord(c) if "a" <= c <= "z" else 0x30 if c.isdigit() else 0x20
        out.append(b)
    return out


def buckets(codes, size, seed):
    for i in range(len(codes) - size + 1):
        g = codes[i]
        for k in range(1, size):
            g = (g * 16777619 + codes[i + k]) & 0xFFFFFFFF
        g = g * seed & 0xFFFFFFFF
        g ^= g >> 15
        yield (g * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - langid.BITS)


def test_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs.where(shared.crc_fold("doc_id", 4) != 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op1_langid(spark, SMALL).collect()}
    rows = docs.collect()
    families = sorted({model.family[x] for x in model.langs})
    assert len(got) == len(rows) and len(model.machines) > 3
    for r in rows:
        text = r.text or ""
        if not any(unicodedata.category(c).startswith("L") for c in text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        codes, n = folded(text), len(text.encode())
        b3, b5 = list(buckets(codes, 3, 0x9E3779B1)), [langid.DIM + b for b in buckets(codes, 5, 0x85EBCA77)]
        votes, pairs, wins = dict.fromkeys(families, 1.0), dict.fromkeys(model.langs, 0.0), dict.fromkeys(model.langs, 0)
        for k, (kind, a, b) in enumerate(model.machines):
            w = model.weights[k].astype(np.float64)
            m = float(w[b3].sum()) / max(1, n - 2) + float(w[b5].sum()) / max(1, n - 4) + model.bias[k] if b3 else model.bias[k]
            p = sigmoid(model.scale[k] * m + model.shift[k])
            if kind == "family":
                votes[a] = p
            else:
                pairs[a], pairs[b] = pairs[a] + p, pairs[b] + 1 - p
                wins[a], wins[b] = wins[a] + (m >= 0), wins[b] + (m < 0)
        family = max(families, key=lambda f: votes[f])
        own = [x for x in model.langs if model.family[x] == family]
        best = max(own, key=lambda x: wins[x] + 1e-3 * pairs[x])
        inner = pairs[best] / (len(own) - 1) if len(own) > 1 else 1.0
        assert got[r.doc_id][0] == best and got[r.doc_id][1] == pytest.approx(votes[family] / sum(votes.values()) * inner, abs=1e-6)


def test_sample_takes_one_row_of_each_key(spark):
    rows = spark.createDataFrame([(i % 40 if i < 400 else 7, f"t{i}") for i in range(3000)] + [(None, "x")], "doc_id long, text string").repartition(5)
    for most, low, high in ((100, 40, 40), (20, 8, 34)):
        got = shared.hash_sample(rows, "doc_id", most).collect()
        assert low <= len(got) <= high and len({r.doc_id for r in got}) == len(got)
        assert all(r.text == min(f"t{i}" for i in range(3000) if (i % 40 if i < 400 else 7) == r.doc_id) for r in got)


def test_token_counts_of_an_empty_table_and_clashing_names(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, N_Tokens int, Over_Limit string")
    count = lambda df: tokencount.count_tokens(df, P.path("piece_bpe_32k.model"), 4096)
    assert count(docs).columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"] and count(docs).first().n_tokens > 0
    assert not count(docs.limit(0)).collect()
