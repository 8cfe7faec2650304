"""Rates, exact tests and intervals over result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Mean of flags to four places; 0 for none."""
    return F.round(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)), 4)


def index_percentiles(df: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, str]], ranges: int = 1024) -> DataFrame:
    """(by, *wanted): percentiles by index, floor(q * n) or round(q * (n - 1)), which are values of the group and not interpolated.

    wanted: name to (q, ``floor`` or ``round``). Values are counted by equal ranges of their group first, with partial sums; only
    the one range that holds a rank is then put in order, by its distinct values. Nulls are left out.
    """
    rows = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    place = lambda d: d.join(ends, "_g").withColumn("_range", F.least(F.lit(ranges - 1), F.floor(F.coalesce(share, F.lit(0.0)) * ranges)))
    index = lambda q, kind: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n"))) if kind == "floor" else F.bround(F.lit(q) * (F.col("_n") - 1), 0).cast("long")
    counts = place(rows).groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    counts = counts.withColumn("_below", F.sum("_c").over(W.partitionBy("_g").orderBy("_range")) - F.col("_c"))
    asked = counts.select("_g", "_range", "_below", "_c", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), index(q, kind).alias("_i")) for name, (q, kind) in wanted.items()]))).where("_i >= _below and _i < _below + _c")
    inside = place(rows).select("_g", "_range", "_v").join(asked.select("_g", "_range").distinct(), ["_g", "_range"], "left_semi").groupBy("_g", "_range", "_v").agg(F.count(F.lit(1)).alias("_m"))
    inside = inside.withColumn("_to", F.sum("_m").over(W.partitionBy("_g", "_range").orderBy("_v")))
    found = asked.join(inside, ["_g", "_range"]).where("_i >= _below + _to - _m and _i < _below + _to")
    return found.groupBy(F.col("_g").alias(by)).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double, by a fold."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - k + i) / i)


def sign_test(plus: Column, minus: Column) -> Column:
    """Exact two-sided sign test; ties are left out by the caller."""
    n, low = plus + minus, F.least(plus, minus)
    tail = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.lit(0.0), lambda a, k: a + choose(n, k))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))).otherwise(F.lit(1.0))


def holm(tests: DataFrame, family: str, p: str = "p") -> DataFrame:
    """Adjusted p values by Holm's step-down."""
    w = W.partitionBy(family).orderBy(p, "test")
    n = F.count(F.lit(1)).over(W.partitionBy(family))
    step = tests.withColumn("_step", F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1)))
    return step.withColumn("p_holm", F.max("_step").over(w)).drop("_step")


def median_interval(n: int, confidence: float = 0.95) -> tuple[int, int] | None:
    """Ranks (from 1) of the order statistics that enclose the median with the confidence; None if no pair does."""
    best = None
    for k in range(1, n // 2 + 1):
        tail = sum(math.comb(n, i) for i in range(k)) / 2**n
        if 1 - 2 * tail >= confidence:
            best = (k, n - k + 1)
    return best


def bca_intervals(df: DataFrame, by: str, value: str, key: str, level: float = 0.95, rounds: int = 2000, seed: int = 20260909) -> DataFrame:
    """A bias-corrected and accelerated bootstrap interval of each group's mean, or why there is none.

    Each row joins each resample with a Poisson(1) weight from a hash of its key, so rows are never collected: what leaves a
    partition is one partial sum for each group and round. The acceleration is the jackknife's, which for a mean is the
    skewness over 6 sqrt(n), from one pass of moments. Ends are order statistics of the resampled means. ``refused``:
    ``degenerate`` where all values are equal (a point mass is no interval), ``one_sided`` where the means lie on one side of the
    observed one. Nulls are left out; rows of one key are weighed alike.
    """
    rows = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v"), F.col(key).alias("_id")).where("_v is not null")
    moments = rows.groupBy("_g").agg(F.count("_v").alias("n"), F.avg("_v").alias("point"), F.skewness("_v").alias("_skew"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    moments = moments.withColumn("acceleration", F.when(F.col("_high") > F.col("_low"), F.col("_skew") / (6 * F.sqrt("n"))).otherwise(0.0))
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_w", poisson(F.xxhash64(F.lit(seed), "round", "_id")))
    means = drawn.where("_w > 0").groupBy("_g", "round").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))
    below = means.join(moments.select("_g", "point"), "_g").groupBy("_g").agg(F.count_if(F.col("mean") < F.col("point")).alias("_below"), F.count(F.lit(1)).alias("_rounds"))
    ends = moments.join(below, "_g").withColumn("_ends", _bca_ends(level)("_below", "_rounds", "acceleration"))
    ranked = means.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("mean", "round")) - 1)
    wanted = ends.select("_g", F.col("_ends.low").alias("_a"), F.col("_ends.high").alias("_b"))
    at = ranked.join(wanted, "_g").groupBy("_g").agg(F.max(F.when(F.col("_r") == F.col("_a"), F.col("mean"))).alias("low"), F.max(F.when(F.col("_r") == F.col("_b"), F.col("mean"))).alias("high"))
    refused = F.when(F.col("_low") == F.col("_high"), "degenerate").when(F.col("_below").isin(0) | (F.col("_below") == F.col("_rounds")), "one_sided")
    out = ends.join(at, "_g").withColumn("refused", refused)
    end = lambda c: F.when(F.col("refused").isNull(), F.col(c)).alias(c)
    return out.select(F.col("_g").alias(by), "n", "point", end("low"), end("high"), F.col("_ends.z0").alias("z0"), "acceleration", "refused")


def poisson(hashed: Column) -> Column:
    """A Poisson(1) draw, 12 at most, from a 64-bit hash."""
    u, total, out = F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40), 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u >= total).cast("int")
    return out


def _bca_ends(level: float):
    """For a group's share of means below the point and its acceleration: z0 and the ranks of both ends."""

    @F.pandas_udf("z0 double, low long, high long")
    def ends(below: pd.Series, rounds: pd.Series, a: pd.Series) -> pd.DataFrame:
        normal, out = NormalDist(), []
        for b, n, accel in zip(below, rounds, a):
            if not 0 < b < n:
                out.append((None, None, None))
                continue
            z0 = normal.inv_cdf(b / n)

            def rank(alpha):
                z = z0 + normal.inv_cdf(alpha)
                return min(n - 1, max(0, round(normal.cdf(z0 + z / (1 - accel * z)) * (n - 1))))

            out.append((z0, rank((1 - level) / 2), rank((1 + level) / 2)))
        return pd.DataFrame(out, columns=["z0", "low", "high"]).astype({"z0": "float64", "low": "Int64", "high": "Int64"})

    return ends


def sign_flips(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p_value): exact, the share of all 2^n sign patterns of a group's differences whose mean is at least as far from 0.

    At most 22 differences a group, else an error; the patterns are rows, made in two steps, and summed up where they are.
    """
    groups = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_x"))
    total = lambda p: F.aggregate(F.transform("_x", lambda x, i: F.when(F.call_function("shiftright", p, i).bitwiseAND(1) == 1, -x).otherwise(x)), F.lit(0.0), lambda acc, x: acc + x)
    n = F.when(F.size("_x") <= 22, F.size("_x")).otherwise(F.raise_error(F.lit("at most 22 differences")).cast("int"))
    half = F.floor(n / 2).cast("int")
    high = groups.withColumn("n", n).withColumn("_high", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), half) - 1)))
    both = high.withColumn("_low", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("n") - half) - 1)))
    both = both.withColumn("_p", F.col("_low") + F.call_function("shiftleft", F.col("_high"), F.col("n") - half))
    far = F.abs(total(F.col("_p"))) >= F.abs(total(F.lit(0))) - 1e-12
    return both.groupBy(by).agg(F.max("n").alias("n"), (F.count_if(far) / F.count(F.lit(1))).alias("p_value"))


def discordance(cases: DataFrame, pair: list[str], arm: str, leaked: str = "leaked") -> DataFrame:
    """2 x 2 counts of twins: cases that differ in ``arm`` (single, adversarial) only."""
    both = cases.groupBy(*pair).agg(F.bool_or(F.when(F.col(arm) == "single", F.col(leaked))).alias("s"), F.bool_or(F.when(F.col(arm) == "adversarial", F.col(leaked))).alias("a")).where("s is not null and a is not null")
    return both.agg(F.count_if(F.col("s") & F.col("a")).alias("both"), F.count_if(F.col("s") & ~F.col("a")).alias("single_only"), F.count_if(~F.col("s") & F.col("a")).alias("adversarial_only"), F.count_if(~F.col("s") & ~F.col("a")).alias("neither"))
