"""Texts inside texts: which values contain others, and the longest run of a needle that others repeat.

Both work by an inverted index of k-grams and equi-joins, never by comparing every two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(text: Column) -> Column:
    """Letters and digits alone, in lower case: the form in which values are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def grams(text: Column, k: Column | int) -> Column:
    """The k-grams of a text by place; none where it is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))


def containments(values: DataFrame, key: str, value: str, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of values(key, value): which folded values are part of others.

    Equal folded values are one class, named by its least key: members(key, class)
    lists them. pairs(container, contained) are of different classes, so a much
    repeated value costs nothing. A value is sought by its rarest k-gram (itself if
    shorter) among the grams of all values; each candidate is then verified. Null
    values and those without letter or digit are in no class.
    """
    v = values.select(F.col(key).alias("_key"), folded(F.col(value)).alias("_v")).where("_v <> ''")
    classes = v.groupBy("_v").agg(F.min("_key").alias("class"))
    members = v.join(classes, "_v").select(F.col("_key").alias(key), "class")
    sizes = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda n: F.array_distinct(grams(F.col("_v"), n)))
    index = classes.select("class", "_v", F.explode(F.flatten(sizes)).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = classes.select("class", "_v", F.explode(F.array_distinct(grams(F.col("_v"), F.least(F.lit(k), F.length("_v"))))).alias("gram"))
    probe = own.join(often, "gram").groupBy("class", "_v").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = probe.select(F.col("class").alias("contained"), F.col("_v").alias("_part"), "gram").join(index.select(F.col("class").alias("container"), F.col("_v").alias("_whole"), "gram"), "gram")
    pairs = found.where((F.length("_whole") > F.length("_part")) & F.contains(F.col("_whole"), F.col("_part"))).select("container", "contained")
    return pairs, members


def shared_runs(needles: DataFrame, texts: DataFrame, by: str, k: int) -> DataFrame:
    """(by, start, end) of the maximal runs of at least k characters that a needle shares with a text of the same ``by``.

    needles(by, needle) has one row for each ``by``, texts(by, text) any number. Shared k-grams on one diagonal of a needle
    and a text that follow each other are one run; of runs that start at one place the longest is kept.
    """
    n = needles.select(by, F.posexplode(grams(F.col("needle"), k)).alias("_i", "_g"))
    t = texts.select(by, F.monotonically_increasing_id().alias("_t"), "text").select(by, "_t", F.posexplode(grams(F.col("text"), k)).alias("_j", "_g"))
    # A gram that a text repeats starts a diagonal of its own each time.
    met = n.join(t, [by, "_g"]).select(by, "_t", (F.col("_j") - F.col("_i")).alias("_d"), "_i")
    island = F.col("_i") - F.row_number().over(W.partitionBy(by, "_t", "_d").orderBy("_i"))
    runs = met.withColumn("_r", island).groupBy(by, "_t", "_d", "_r").agg(F.min("_i").alias("start"), (F.max("_i") + k).alias("end"))
    return runs.groupBy(by, "start").agg(F.max("end").alias("end"))


def specific_runs(needles: DataFrame, texts: DataFrame, benign: DataFrame, by: str, k: int = 5) -> DataFrame:
    """(by, run): the longest run of each needle in its texts that no benign text of the same ``by`` has; 0 below k characters.

    All sides are folded. A run inside a benign one is benign, and so is each part of it: such runs are taken away by an anti
    join with the runs whose benign reach goes as far.
    """
    form = lambda df, c: df.select(by, folded(F.coalesce(c, F.lit(""))).alias(c))
    whole = form(needles, "needle")
    found = shared_runs(whole, form(texts, "text"), by, k).withColumn("_known", F.lit(False))
    known = shared_runs(whole, form(benign, "text"), by, k).withColumn("_known", F.lit(True))
    both = found.unionByName(known)
    reach = F.max(F.when(F.col("_known"), F.col("end"))).over(W.partitionBy(by).orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow))
    covered = both.withColumn("_reach", reach).where("not _known and _reach >= end").select(by, "start")
    left = found.join(covered, [by, "start"], "left_anti").groupBy(by).agg(F.max(F.col("end") - F.col("start")).alias("run"))
    return whole.select(by).join(left, by, "left").select(by, F.coalesce("run", F.lit(0)).cast("int").alias("run"))


def emission_report(runs: DataFrame, threshold: int = 5, leaked: Column | None = None, tried: Column | None = None, capped: Column | None = None) -> DataFrame:
    """runs(..., run) with ``verdict``: ``complete`` where the whole value came out (a stronger finding, and not this one's),
    ``partial`` from the threshold on, ``inconclusive`` where nothing was tried or some splits were left out, else ``clean``."""
    no, some = F.lit(False), F.lit(1)
    verdict = F.when(no if leaked is None else leaked, "complete").when(F.col("run") >= threshold, "partial")
    return runs.withColumn("verdict", verdict.when(((some if tried is None else tried) == 0) | (no if capped is None else capped), "inconclusive").otherwise("clean"))
