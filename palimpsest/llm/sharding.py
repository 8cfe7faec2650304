"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The source partitions are those in which the rows arrive. Each orders its rows
at random where they are, without an exchange, and is written with the rows'
places. The matrix of how many rows each partition sends to each shard is drawn
exactly: line by line, a multivariate hypergeometric draw from what the shards
still lack, so that lines and columns both have their exact sums. Each partition
deals out its rows by its line of the matrix; after the one exchange, each shard
orders its rows at random once more, which gives the slots.

The rows go through DataFrame functions only. The driver sees the row counts
of the partitions and the matrix, of at most ``max_partitions`` lines: beyond
that, neighbouring source partitions are taken together, without an exchange,
and their sort spills to disk if it must. A shard is ordered in buckets of a
random key, whose sizes are summed up, so that no task has to hold a whole shard.

Random numbers depend on the partition and the row's place in it alone, and are
written with the rows before anything is counted, so a task that runs again
draws the same ones, and equal rows are spread like all others. Cases: null
texts have size 1 and crc 0. An empty table gives an empty result. Input columns
``shard`` and ``slot`` are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import shared

def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good: inversion outwards from the mode.

    The start value may be off by a factor that all probabilities share; it is taken a little too small, and what is left of the
    unit interval leads to another draw, so the factor plays no part. What remains is the rounding of the ratios' products.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at_mode = 0.999 * math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    while True:
        u = rng.random() - at_mode
        if u <= 0:
            return mode
        down, up, p_down, p_up = mode, mode, at_mode, at_mode
        while down > low or up < high:
            if up < high:
                p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
                up += 1
                u -= p_up
                if u <= 0:
                    return up
            if down > low:
                p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
                down -= 1
                u -= p_down
                if u <= 0:
                    return down
            if p_up < 1e-300 and p_down < 1e-300:
                break  # draw again


def matrix(sent: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """A line for each partition: how many of its rows go to each shard."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in sent:
        rest, line = sum(left), []
        for s, want in enumerate(left):
            rest -= want
            k = hypergeometric(rng, want, rest, n)
            line.append(k)
            left[s] -= k
            n -= k
        out.append(line)
    return out


def shard_rows(df: DataFrame, shards: int, seed: int = 11, rows_each: int = 20_000, max_partitions: int = 16_384) -> DataFrame:
    """Adds ``shard`` and ``slot`` to df. Shard sizes differ by one row at most; slots are gapless from 0."""
    spark = df.sparkSession
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    source, at, order, ends, bucket, before = (shared.unused(n, df) for n in ("_from", "_at", "_order", "_ends", "_bucket", "_before"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    # Where the rows are: a random order, the partition and the place in it.
    local = df.coalesce(max_partitions).withColumn(order, F.rand(seed)).sortWithinPartitions(order)
    local = local.select(*kept, F.spark_partition_id().alias(source), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at), F.rand(seed + 1).alias(order))
    rows = shared.keep(local, "shard-rows")
    sent = {r[source]: r["count"] for r in rows.groupBy(source).count().collect()}
    n = sum(sent.values())
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    lines = matrix([sent[p] for p in sorted(sent)], sizes, seed)
    bounds = [{source: p, ends: [sum(line[: s + 1]) for s in range(shards)]} for p, line in zip(sorted(sent), lines)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(bounds)), f"array<struct<{source}:int,{ends}:array<bigint>>>")))
    dealt = rows.join(table, source).withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(at))))
    buckets = max(1, -(-n // (shards * rows_each)))
    dealt = dealt.withColumn(bucket, F.floor(F.col(order) * buckets).cast("int")).select(*kept, "shard", bucket, order)
    slot = F.row_number().over(W.partitionBy("shard", bucket).orderBy(order)) - 1
    less = dealt.groupBy("shard", bucket).count().withColumn(before, F.sum("count").over(W.partitionBy("shard").orderBy(bucket)) - F.col("count")).drop("count")
    return dealt.withColumn(at, slot).join(less, ["shard", bucket]).select(*kept, "shard", (F.col(before) + F.col(at)).alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(slim, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
