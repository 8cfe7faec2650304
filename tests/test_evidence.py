"""Intervals, covering arrays and look-alikes against numpy and plain Python."""

import random
import unicodedata
from itertools import combinations, product
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import lookalikes
from palimpsest.operators import covering, stats


def bca(values, level, rounds, seed):
    rng, n = np.random.default_rng(seed), len(values)
    v = np.array(values)
    means = np.sort(v[rng.integers(0, n, (rounds, n))].mean(axis=1))
    z0 = NormalDist().inv_cdf((means < v.mean()).mean())
    jack = (v.sum() - v) / (n - 1)
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    ends = [NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in map(NormalDist().inv_cdf, ((1 - level) / 2, (1 + level) / 2))]
    return v.mean(), a, [means[round(q * (rounds - 1))] for q in ends]


def test_bca_intervals(spark):
    rng = np.random.default_rng(5)
    groups = {"skewed": rng.exponential(10, 300), "even": rng.normal(5, 2, 200)}
    rows = [(g, float(x), 1000 * k + i) for k, (g, v) in enumerate(groups.items()) for i, x in enumerate(v)]
    rows += [("flat", 3.0, 5000 + i) for i in range(20)] + [("one", 1.0, 6000), ("flat", None, 7000)]
    got = {r.g: r for r in stats.bca_intervals(spark.createDataFrame(rows, "g string, x double, id long").repartition(3), "g", "x", "id", rounds=3000).collect()}
    for g, v in groups.items():
        point, a, (low, high) = bca(v, 0.95, 20_000, 1)
        width = high - low
        assert got[g].refused is None and got[g].n == len(v) and abs(got[g].point - point) < 1e-9 and abs(got[g].acceleration - a) < 1e-9
        assert abs(got[g].low - low) < 0.12 * width and abs(got[g].high - high) < 0.12 * width
    assert got["flat"].refused == "degenerate" == got["one"].refused and got["flat"].low is None and got["flat"].n == 20


def test_sign_flips(spark):
    rng = random.Random(4)
    groups = {g: [round(rng.uniform(-2, 3), 2) for _ in range(n)] for g, n in (("a", 1), ("b", 7), ("c", 10))}
    got = {r.g: (r.n, r.p_value) for r in stats.sign_flips(spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double"), "g", "x").collect()}
    for g, v in groups.items():
        far = [abs(sum(s * x for s, x in zip(signs, v))) >= abs(sum(v)) - 1e-12 for signs in product((1, -1), repeat=len(v))]
        assert got[g] == (len(v), pytest.approx(sum(far) / len(far)))
    with pytest.raises(Exception, match="at most 22"):
        stats.sign_flips(spark.range(23).selectExpr("1 g", "1.0 x"), "g", "x").collect()


def axes_of(spark, axes):
    return {n: spark.createDataFrame([(v,) for v in values], "v string") for n, values in axes.items()}


def greedy(axes, feasible):
    names = list(axes)
    pairs = lambda c: {(a, c[a], b, c[b]) for a, b in combinations(names, 2)}
    cases = [dict(zip(names, x)) for x in product(*[sorted({v for v in values if v is not None}) for values in axes.values()])]
    cases = [c for c in cases if feasible(c)]
    missing, chosen = set().union(*map(pairs, cases)) if cases else set(), []
    while missing:
        best = max(cases, key=lambda c: len(missing & pairs(c)))
        missing -= pairs(best)
        chosen.append(tuple(best.values()))
    return chosen


def test_covering_array_is_the_greedy_one(spark, monkeypatch):
    axes = {"a": ["x", "y", "z", "x", None], "b": ["0", "1"], "c": ["p", "q", "r", "s"], "d": ["m", "n"]}
    feasible = (F.col("a") != "x") | (F.col("c") != "q")
    got = covering.covering_array(axes_of(spark, axes), feasible)
    assert [tuple(r)[1:] for r in got.orderBy("case").collect()] == greedy(axes, lambda c: c["a"] != "x" or c["c"] != "q")
    cover = covering.coverage(got, axes_of(spark, axes), feasible).collect()
    assert all(r.n_cases > 0 for r in cover) and len(cover) == 6 + 12 + 6 + 8 + 4 + 8 - 1 and got.count() < 24
    monkeypatch.setattr(covering, "EACH_ROUND", 1)
    assert covering.covering_array(axes_of(spark, axes), feasible).collect() == got.collect()
    twins = {tuple(r)[1:] for r in covering.covering_array(axes_of(spark, axes), feasible, "b").collect()}
    assert all((a, x, c, d) in twins for a, _, c, d in twins for x in "01")
    with pytest.raises(ValueError):
        covering.candidates({n: spark.range(200).selectExpr("cast(id as string) v") for n in "abc"})
    assert covering.covering_array(axes_of(spark, {"a": [], "b": ["1"]})).count() == 0


def test_lookalikes_are_the_closure(spark, tmp_path):
    path = tmp_path / "table.txt"
    chars = {"а": "a", "ɑ": "α", "α": "a", "ⅰ": "і", "і": "i", "৪": "8", "ℐ": "I", "ж": "ж", "м": "н", "н": "м", "ο": "O", "Ο": "O", "O": "0", "x": "а"}
    lines = ["﻿# a table", "", "0062 ; 0431 0431 ; MA # two characters"] + [f"{ord(a):04X} ;\t{ord(b):04X} ;\tMA # {a} -> {b}" for a, b in chars.items()]
    path.write_text("\n".join(lines), "utf-8")
    steps = lookalikes.steps(spark, str(path))
    assert {r.source: r.target for r in steps.collect()} == chars
    want = {}
    for source in chars:
        target = source
        for _ in range(16):
            target = chars.get(target, target)
        if not source.isascii() and target.isascii() and target.isalnum() and unicodedata.normalize("NFKD", source) == source and unicodedata.decimal(source, None) is None:
            want[source] = target.lower()
    table = lookalikes.folds(steps)
    assert {r.source: r.target for r in table.collect()} == want and {"а", "ɑ", "α", "і", "ο", "Ο"} == set(want)
    source, target = lookalikes.as_pair(table)
    assert spark.range(1).select(F.translate(F.lit("pаypαl ΟΟ"), source, target)).first()[0] == "paypal 00"


def test_a_table_of_lookalikes_is_used_by_detection(spark):
    from palimpsest.functions import detect

    rows = spark.createDataFrame([("mail jᴑe@example.com now",)], "text string")
    assert [s.matched for s in detect.with_spans(rows, types=("EMAIL",), secrets=False).first().spans] != ["jᴑe@example.com"]
    assert [s.matched for s in detect.with_spans(rows, types=("EMAIL",), secrets=False, table=("ᴑ", "o")).first().spans] == ["jᴑe@example.com"]
