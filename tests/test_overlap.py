"""Containment, shared runs and splits against plain Python."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from palimpsest.operators import overlap, splits


def fold(s):
    return "".join(c for c in (s or "").lower() if c.isalnum())


def test_containments_equal_brute_force(spark):
    rng = random.Random(1)
    values = [(i, "".join(rng.choices("aB-0 ", k=rng.randint(0, 9)))) for i in range(250)] + [(900, None), (901, "---"), (902, "00000"), (903, "0 0 0 0 0"), (904, "0"), (905, "Éa"), (906, "xéAx")]
    pairs, members = overlap.containments(spark.createDataFrame(values, "id long, v string"), "id", "v")
    classes = {}
    for i, v in sorted(values):
        if fold(v):
            classes.setdefault(fold(v), i)
    want = {(b, a) for x, a in classes.items() for y, b in classes.items() if x != y and x in y}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert {tuple(r) for r in members.collect()} == {(i, classes[fold(v)]) for i, v in values if fold(v)}
    assert "Cartesian" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()


def longest(needle, texts, benign):
    n, best = fold(needle), 0
    for a in range(len(n)):
        for b in range(len(n), a + best, -1):
            part = n[a:b]
            if not any(part in fold(x) for x in benign) and any(part in fold(x) for x in texts):
                best = b - a
                break
    return best


def test_specific_runs_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("ab1-", k=n))
    needles, texts, benign = [], [], []
    for i in range(60):
        needle = word(rng.randint(0, 40))
        needles.append((i, needle))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, len(needle))
            texts.append((i, word(5) + needle[a : a + rng.randint(0, 30)] + word(8)))
            benign.append((i, word(4) + needle[a : a + rng.randint(0, 12)] + word(3)))
    needles += [(90, None), (91, "aaaaaaaaaaaa")]
    texts += [(90, "x"), (91, "a" * 30), (91, None)]
    benign += [(91, "aaaaaaa")]
    make = lambda rows, c: spark.createDataFrame(rows, f"k long, {c} string")
    got = {r.k: r.run for r in overlap.specific_runs(make(needles, "needle"), make(texts, "text"), make(benign, "text"), "k", 5).collect()}
    of = lambda rows, k: [t for i, t in rows if i == k]
    want = {k: longest(n, of(texts, k), of(benign, k)) for k, n in needles}
    assert got == {k: n if n >= 5 else 0 for k, n in want.items()} and sum(n >= 5 for n in want.values()) > 10


def test_verdicts_of_emission(spark):
    rows = spark.createDataFrame([(7, False, 3, False), (7, True, 3, False), (2, False, 0, False), (2, False, 3, True), (4, False, 3, False)], "run int, leaked boolean, tried int, capped boolean")
    got = [r.verdict for r in overlap.emission_report(rows, 5, F.col("leaked"), F.col("tried"), F.col("capped")).collect()]
    assert got == ["partial", "complete", "inconclusive", "inconclusive", "clean"]


def test_all_splits_up_to_k(spark):
    texts = ["", "a", "ab", "abcde", "abcdefgh", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for parts, least in ((1, 1), (2, 1), (3, 1), (4, 2)):
        got = [(r.i, tuple(r.cuts)) for r in splits.all_splits(df, "t", parts, least).collect()]
        want = [(i, c) for i, t in enumerate(texts) if t is not None for p in range(least, parts + 1) for c in combinations(range(1, len(t)), p - 1)]
        assert sorted(got) == sorted(want)


def test_invariance_report_finds_the_faulty_operator(spark):
    texts = [(1, "id 900-55-1234 end"), (2, "nothing here"), (3, "900-55-1234"), (4, "")]
    df = spark.createDataFrame(texts, "k long, t string")
    pattern = r"\d{3}-\d{2}-\d{4}"
    whole = F.regexp_replace("t", pattern, "[X]")
    good = splits.invariance(df, "k", "t", 3, lambda c: splits.bounded_retention(c, pattern, 11), whole, F.lit("900-55-1234")).collect()
    assert all(r.n_failing == 0 and r.first_cuts is None and r["at"] is None for r in good)
    found = splits.invariance(df, "k", "t", 3, lambda c: splits.chunk_local(c, pattern), whole, F.lit("900-55-1234"))
    got = {r.k: r for r in found.collect()}
    for k, t in texts:
        cuts = [c for p in (0, 1, 2) for c in combinations(range(1, len(t)), p)]
        parts = lambda c: [t[a:b] for a, b in zip((0, *c), (*c, len(t)))]
        out = {c: "".join(re.sub(pattern, "[X]", x) for x in parts(c)) for c in cuts}
        right = re.sub(pattern, "[X]", t)
        bad = sorted((len(c), c) for c in cuts if out[c] != right)
        assert got[k].n_splits == len(cuts) and got[k].n_failing == len(bad) and got[k].n_leaked == sum("900-55-1234" in out[c] for c in cuts if out[c] != right)
        assert (tuple(got[k].first_cuts) if bad else None) == (bad[0][1] if bad else None)
        if bad:
            assert right[: got[k]["at"]] + got[k].got + right[got[k]["at"] + len(got[k].expected) :] == out[bad[0][1]]
    lines = [r.line for r in splits.report(found, "k").orderBy("part", "key").collect()]
    assert lines[0].startswith("1: ") and "cuts [4]" in lines[0] and "leak" in lines[0] and lines[-1].startswith("2 of 4 texts differ over ")
