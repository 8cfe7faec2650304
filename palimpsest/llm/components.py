"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared

#: Parts into which the links of a node are dealt.
SALTS = 64


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(x, y): node and comp, the smallest node it reaches, for each node but those smallest ones.

    A node with very many links is dealt to SALTS parts, in each step, so that
    no task gets all of its links. Links are in the shared folder between
    steps; the number of steps grows with the logarithm of the size of the
    largest component.
    """
    edges = shared.keep(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
        low = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = parts.select("u", "salt").join(low, "u")
        large = both.where("v > u").join(low, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = shared.keep(small, "links")
        shared.drop(edges)
        edges, after = new, _mark(new)
        if after == before:
            break
        before = after
    shared.release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
