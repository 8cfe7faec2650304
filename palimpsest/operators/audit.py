"""Hash-linked audit logs: building, checking, summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64


def link(records: DataFrame, chain: str, order: str, body: Column) -> DataFrame:
    """Adds sequence, body, previous_hash and hash. A hash covers the hash before it, so each chain is folded in order;
    chains are independent and meant to be of bounded length (one for each worker and day)."""
    rows = records.select(F.col(chain).alias("chain_id"), F.col(order).alias("_order"), body.alias("body"))
    start = F.struct(F.lit(GENESIS).alias("last"), F.array().cast("array<struct<sequence:int,body:string,previous_hash:string,hash:string>>").alias("out"))

    def step(acc, x):
        h = F.sha2(F.concat(acc["last"], x["body"]), 256)
        return F.struct(h.alias("last"), F.concat(acc["out"], F.array(F.struct((F.size(acc["out"]) + 1).alias("sequence"), x["body"].alias("body"), acc["last"].alias("previous_hash"), h.alias("hash")))).alias("out"))

    folded = rows.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("_order", "body"))).alias("r"))
    return folded.select("chain_id", F.inline(F.aggregate("r", start, step, lambda a: a["out"])))


def breaks(log: DataFrame) -> DataFrame:
    """log(chain_id, line, sequence, body, previous_hash, hash): one row for each break, with its reason."""
    w = W.partitionBy("chain_id").orderBy("line")
    before = F.last("hash", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    place = F.row_number().over(w)
    checked = log.withColumn("_hash", before).withColumn("_sequence", F.lag("sequence").over(w)).withColumn("_at", place)
    reasons = F.array(
        F.when(F.col("hash").isNull(), "missing_hash"),
        F.when(F.sha2(F.concat("previous_hash", "body"), 256) != F.col("hash"), "hash_mismatch"),
        F.when((F.col("_at") == 1) & (F.col("previous_hash") != GENESIS), "bad_anchor"),
        F.when((F.col("_at") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("_hash")), "broken_link"),
        F.when((F.col("_at") > 1) & (F.col("sequence") != F.col("_sequence") + 1), "sequence_gap"),
    )
    return checked.select("chain_id", "line", F.explode(F.array_compact(reasons)).alias("reason"))


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_records"), F.min_by("hash", "line").alias("first_hash"), F.max_by("hash", "line").alias("last_hash"), F.max("sequence").alias("last_sequence"))


def merkle_root(hashes: Column, seed: Column) -> Column:
    """Rolling root over an ordered array of hashes."""
    return F.aggregate(hashes, seed, lambda acc, h: F.sha2(F.concat(acc, h), 256))
