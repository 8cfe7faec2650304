"""The lexical search, the vector search and the band join against brute force, with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import band, innertop, treaps

DOC = "doc_id long, text string, score string, rank int"
ITEM = "item_id long, text string, doc_id int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked, out = {}, {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, ts in asked.items():
        rows = []
        for d, c, n in held:
            m = 10 + 90 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, math.inf if d is None else d))
        out[i] = [(d, -s) for s, d in sorted(rows)[:k]]
    return {i: r for i, r in out.items() if r}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((math.inf if r.doc_id is None else r.doc_id, r.score))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lexical_search_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(treaps, "SHARD_DOCS", 50)
    monkeypatch.setattr(treaps, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(treaps, "OPENED", 4)
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["Ünï", "日本", "ÀÉ", "X9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(500 + i, "w1 W2, w3-w3") for i in range(80)]  # copies: ties by doc_id
    docs += [(7, "w5 w6"), (7, "w5 w6"), (None, "w1 w2 w3 w59"), (900, None), (901, ""), (902, " ,.;"), (903, "w8 " * 20_000), (-5, "w1 w2 w3")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "w1 w2 w3"), (23, "w3 w4"), (None, "w5"), (24, "日本 ÀÉ x9")]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], DOC).repartition(3)
    got = found(treaps.rank_documents(d, spark.createDataFrame([(a, b, 1) for a, b in items], ITEM)))
    assert got == ranked(docs, items)


def test_lexical_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "x", 1)], DOC)
    items = spark.createDataFrame([(1, "a", 1)], ITEM)
    assert found(treaps.rank_documents(none, items)) == {} == found(treaps.rank_documents(one, items.limit(0)))
    assert found(treaps.rank_documents(one, items)) == ranked([(1, "a b")], [(1, "a")])


def test_treap_is_a_heap_in_search_order():
    rng = random.Random(3)
    values = [rng.randrange(20) for _ in range(200)]
    left, right = np.full(210, -1), np.full(210, -1)
    root = treaps.treap(values, 5, left, right)

    def walk(i):
        for j in (left[i], right[i]):
            assert j < 0 or values[j - 5] <= values[i - 5]
        return (walk(left[i]) if left[i] >= 0 else []) + [i] + (walk(right[i]) if right[i] >= 0 else [])

    assert walk(root) == list(range(5, 205))


VEC = "vec_id long, embedding array<float>, label int, score string"


def tops(rows, k=10, every=100):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < math.sqrt(2**62 / len(v)) for x in v)]
    out = {}
    for q, v in {i: v for i, v in sorted(kept)}.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))[:k]
            if best:
                out[q] = [(i, -s) for s, i in best]
    return out


def answered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("size", [1.0, 3e4, 1e6])
def test_vector_search_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(innertop, "CHUNK", 40)
    monkeypatch.setattr(innertop, "QUERIES", 3)
    monkeypatch.setattr(innertop, "SEEDS", 12)
    rng = np.random.default_rng(int(size))
    middle = rng.normal(size=(5, 20))
    rows = [(i, [float(x) for x in (middle[i % 5] + rng.normal(size=20) * 0.3) * size]) for i in range(700)]
    rows += [(2000 + i, rows[100][1]) for i in range(30)] + [(2000, rows[100][1]), (200, rows[200][1])]
    rows += [(3000, None), (3001, []), (3100, [1.0] * 19 + [None]), (3200, [float("nan")] * 20), (3300, [float("inf")] * 20), (3400, [1e30] * 20), (None, rows[5][1])]
    rows += [(4000 + i, [float(i), 1.0, -2.0]) for i in range(5)] + [(5000, [0.0] * 20)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC).repartition(3)
    assert answered(innertop.top_products(df, df.where("vec_id % 100 = 0"), 10, groups=3)) == tops(rows)


def test_vector_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], VEC), spark.createDataFrame([(100, [1.0], 0, "x")], VEC)
    assert not innertop.top_products(none, none, 10, groups=2).collect() and not innertop.top_products(one, one, 10, groups=2).collect()


ITEMS = "item_id long, name string, price double, gap string, bucket int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, u string"


def matched(items, lines, k, absolute, parts, out_of):
    cents = lambda x: math.floor(100 * x + 0.5)
    ready = [(s, n, i, (2 * cents(a) + q) // (2 * q)) for s, n, i, q, a in lines if None not in (s, i, q, a) and q > 0 and math.isfinite(a)]
    out = []
    for item, price in items:
        p = cents(price) if price is not None and math.isfinite(price) else None
        pairs = []
        if p is not None and item is not None:
            for s, n, i, u in ready:
                gap = abs(u - p)
                if i != item and (gap <= absolute or out_of * gap <= parts * max(u, p)):
                    pairs.append((gap, u, s, -1 if n is None else n, i))
        pairs.sort()
        sums = (len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(f"{s},{'' if n < 0 else n},{i}".encode()) for _, _, s, n, i in pairs))
        out += [(item, r + 1, *x, *sums) for r, x in enumerate(pairs[:k])] or [(item, 0, *[None] * 5, 0, 0, 0)]
    return sorted(out, key=repr)


def joined(df):
    rows = [(r.item_id, r["rank"], r.gap, r.u, r.sale_id, -1 if r.line_no is None and r["rank"] else r.line_no, r.line_item_id, r.n_pairs, r.gap_sum, r.lines_crc) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed, k, absolute, parts, out_of", [(1, 2, 100, 1, 1000), (2, 3, 20, 1, 10), (3, 2, 0, 1, 100), (4, 1, 5, 3, 7)])
def test_band_join_equals_brute_force(spark, seed, k, absolute, parts, out_of):
    rng = random.Random(seed)
    price = lambda: round(1.0 * rng.choice([rng.uniform(0, 5), rng.uniform(900, 1100), 10 ** rng.uniform(0, 6), 2000 * rng.randint(1, 5) * rng.choice([1, 0.999, 1.001])]), 2)
    items = [(i, price()) for i in range(120)] + [(5, None), (None, 3.0), (200, float("nan")), (201, float("inf")), (202, 1e9), (9, 12.0), (9, 12.0), (203, -1.0), (204, 0.0)]
    lines = []
    for s in range(900):
        q = rng.randint(1, 6)
        lines.append((s, rng.choice([None, 1, 2, 3]), rng.choice([0, 0, rng.randrange(130)]), q, round(price() * q, 2)))
    lines += lines[:40] + [(1, 1, 0, 1, 12.0)] * 30 + [(None, 1, 2, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 2, None, 3.0), (1, 1, 2, 1, None), (1, 1, 2, 0, 3.0), (1, 1, 2, 1, float("nan")), (2, 1, 3, 2, -1.5), (2, 2, 3, 1, 0.0)]
    i = spark.createDataFrame([(a, "n", b, "x", 1) for a, b in items], ITEMS).repartition(3)
    n = spark.createDataFrame([(s, n, i, 0, q, a, "x") for s, n, i, q, a in lines], LINES).repartition(3)
    assert joined(band.match_prices(i, n, k, absolute, parts, out_of)) == matched(items, lines, k, absolute, parts, out_of)


def test_band_join_of_empty_tables(spark):
    i, n = spark.createDataFrame([(1, "n", 2.0, "x", 1)], ITEMS), spark.createDataFrame([], LINES)
    assert joined(band.match_prices(i, n)) == [(1, 0, None, None, None, None, None, 0, 0, 0)] and not band.match_prices(i.limit(0), n).collect()


def test_band_pairs_come_once(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([None, rng.randint(-50, 50), rng.randint(900, 1100), rng.randint(10_000, 99_999)])) for i in range(150)]
    right = [(i, rng.choice([None, rng.randint(-50, 50), rng.randint(900, 1100), rng.randint(10_000, 99_999)])) for i in range(150)]
    got = band.near_pairs(spark.createDataFrame(left, "a long, x long"), spark.createDataFrame(right, "b long, y long"), "x", "y", 10, 2, 100).collect()
    want = [(a, b, abs(x - y)) for a, x in left for b, y in right if x is not None and y is not None and (abs(x - y) <= 10 or 100 * abs(x - y) <= 2 * max(x, y))]
    assert sorted((r.a, r.b, r["gap"]) for r in got) == sorted(want)
