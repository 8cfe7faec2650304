"""Pairwise covering arrays: few cases that hold every pair of values of two axes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases that may be weighed, and cases of one score that one round brings to the driver.
MOST_CASES, EACH_ROUND = 2_000_000, 64


def candidates(axes: dict[str, DataFrame], feasible: Column | None = None) -> DataFrame:
    """All cases: each axis is a DataFrame of one column, its distinct values that are not null taken in order."""
    columns = []
    for name, values in axes.items():
        value = values.select(F.col(values.columns[0]).cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
        columns.append(value.agg(F.array_sort(F.collect_list(name)).alias(name)))
    lists = {name: df.first()[name] for name, df in zip(axes, columns)}
    size = reduce(lambda n, v: n * len(v), lists.values(), 1)
    if size > MOST_CASES:
        raise ValueError(f"{size} cases; at most {MOST_CASES}")
    spark = next(iter(axes.values())).sparkSession
    # A case is its number: the axes are the digits, the first one the highest.
    rows, step = spark.range(size).withColumnRenamed("id", "rank"), size
    for name, values in lists.items():
        step //= max(1, len(values))
        rows = rows.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"rank div {max(1, step)} % {max(1, len(values))}").cast("int")))
    return rows if feasible is None else rows.where(feasible)


def pairs_of(names: list[str]) -> Column:
    """The pairs of a case: for each two axes their names and values."""
    return F.array(*[F.concat_ws("\x1f", F.lit(a), F.col(a), F.lit(b), F.col(b)) for a, b in combinations(names, 2)])


def covering_array(axes: dict[str, DataFrame], feasible: Column | None = None, twins: str | None = None) -> DataFrame:
    """(case, *axes): greedily, the case that holds most pairs still missing, the first in order among equals, until none is missing.

    The candidates are scored in Spark; a round brings the first cases of the highest score, and those that still have it after
    the ones before them are what one case at a time would choose. The driver holds the chosen cases and their pairs, both
    bounded by the axes' values. ``twins``: for each chosen case also those that differ in this axis alone, where feasible.
    """
    names = list(axes)
    rows = candidates(axes, feasible).withColumn("_pairs", pairs_of(names))
    spark, covered, chosen = rows.sparkSession, set(), []
    while True:
        missing = F.size(F.array_except("_pairs", F.array(*[F.lit(p) for p in sorted(covered)]).cast("array<string>")))
        best = rows.withColumn("_gain", missing).where("_gain > 0").orderBy(F.desc("_gain"), "rank").limit(EACH_ROUND).collect()
        if not best:
            break
        for r in best:
            if len(set(r._pairs) - covered) == best[0]._gain:
                covered |= set(r._pairs)
                chosen.append(tuple(r[n] for n in names))
    out = _cases(spark, names, chosen)
    if twins is None:
        return out
    others = out.select(*[n for n in names if n != twins]).distinct().join(candidates(axes, feasible).select(*names), [n for n in names if n != twins])
    more = others.select(*names).join(out, names, "left_anti").distinct().orderBy(*names).collect()
    return _cases(spark, names, chosen + [tuple(r[n] for n in names) for r in more])


def _cases(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    schema = ", ".join(["`case` int", *(f"`{n}` string" for n in names)])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def coverage(cases: DataFrame, axes: dict[str, DataFrame], feasible: Column | None = None) -> DataFrame:
    """(pair, n_cases): each pair that some feasible case holds, and how many of the cases do."""
    names = list(axes)
    explode = lambda df: df.select(F.explode(pairs_of(names)).alias("pair"))
    wanted = explode(candidates(axes, feasible)).distinct()
    return wanted.join(explode(cases).groupBy("pair").agg(F.count(F.lit(1)).alias("n_cases")), "pair", "left").fillna(0, ["n_cases"])
