"""Partitions of texts into chunks, streaming policies over chunks, and leak scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PARTITIONS = 6000


def two_part(length: Column) -> Column:
    """Cuts of all splits into two parts."""
    return F.when(length > 1, F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.array(i))).otherwise(F.array().cast("array<array<int>>"))


def three_part(length: Column, cap: int = MAX_PARTITIONS) -> Column:
    """Cuts of all splits into three parts; none at all where they would be more than the cap (see capped)."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), length - 2), lambda i: F.transform(F.sequence(i + 1, length - 1), lambda j: F.array(i, j))))
    return F.when((length > 2) & ~capped(length, cap), pairs).otherwise(F.array().cast("array<array<int>>"))


def capped(length: Column, cap: int = MAX_PARTITIONS) -> Column:
    """Whether a text has more three-part splits than the cap: such a case is inconclusive and leaves the denominator."""
    return (length - 1) * (length - 2) / 2 > cap


def chunks(text: Column, cuts: Column) -> Column:
    """The parts of a text between cuts."""
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.length(text)))
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.substring(text, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i)))


def fixed_size(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunk_local(parts: Column, pattern: str, mark: str = "[X]") -> Column:
    """Each chunk by itself: a value cut in two is missed."""
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, pattern, mark)), "")


def bounded_retention(parts: Column, pattern: str, window: int, mark: str = "[X]") -> Column:
    """Holds back the last ``window`` characters until the next chunk, so that a value of at most that length is whole when it is judged."""

    def step(acc, p):
        held = F.regexp_replace(F.concat(acc["held"], p), pattern, mark)
        ready = F.greatest(F.lit(0), F.length(held) - window)
        return F.struct(F.concat(acc["out"], F.substring(held, F.lit(1), ready)).alias("out"), F.substring(held, ready + 1, F.length(held)).alias("held"))

    return F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit("").alias("held")), step, lambda acc: F.concat(acc["out"], F.regexp_replace(acc["held"], pattern, mark)))


def leak_rates(cases: DataFrame, *by: str) -> DataFrame:
    """cases(fragmentation, leaked, capped): rates by arm over the cases that count, and their difference."""
    from palimpsest.operators.stats import rate

    counted = cases.where("not capped")
    arm = lambda a: rate(F.when(F.col("fragmentation") == a, F.col("leaked")))
    out = counted.groupBy(*by).agg(arm("single_chunk").alias("leak_single"), arm("adversarial").alias("leak_adversarial"))
    return out.withColumn("delta_frag", F.round(F.col("leak_adversarial") - F.col("leak_single"), 4))


def all_splits(texts: DataFrame, text: str, parts: int, least: int = 1) -> DataFrame:
    """texts with ``cuts``, one row for each split into ``least`` to ``parts`` parts.

    Each level places the next cut behind the last one, or no more cuts: rows come out one by one, and no array is longer than
    the text. Lengths are in characters; an empty text has its one split into one part.
    """
    n = F.length(text)
    rows = texts.where(F.col(text).isNotNull()).withColumn("cuts", F.array().cast("array<int>")).withColumn("_open", F.lit(True))
    for level in range(parts - 1):
        last = F.coalesce(F.try_element_at("cuts", F.lit(-1)), F.lit(0))
        stop = F.array(F.lit(None).cast("int")) if level + 1 >= least else F.array().cast("array<int>")
        more = F.when(F.col("_open") & (last + 1 < n), F.concat(stop, F.sequence(last + 1, n - 1))).when(F.col("_open"), stop).otherwise(F.array(F.lit(None).cast("int")))
        rows = rows.withColumn("_cut", F.explode(more)).withColumn("cuts", F.when(F.col("_cut").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.col("_cut")))).withColumn("_open", F.col("_cut").isNotNull()).drop("_cut")
    return rows.drop("_open")


def different_part(a: Column, b: Column) -> Column:
    """What two texts have between their common beginning and end: (start, left, right); null if they are equal."""
    shortest = F.least(F.length(a), F.length(b))
    # Halving: the longest common beginning, and the longest common end of what is left.
    steps = F.sequence(F.lit(1), F.lit(32))

    def longest(same, most):
        def halve(acc, _):
            mid = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
            fits = same(mid)
            return F.struct(F.when(fits, mid).otherwise(acc["low"]).alias("low"), F.when(fits, acc["high"]).otherwise(F.greatest(mid - 1, acc["low"])).alias("high"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.cast("int").alias("high")), halve, lambda acc: acc["low"])

    start = longest(lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), shortest)
    end = longest(lambda n: F.right(a, n) == F.right(b, n), shortest - start)
    middle = lambda x: F.substring(x, start + 1, F.length(x) - start - end)
    return F.when(a != b, F.struct(start.alias("start"), middle(a).alias("left"), middle(b).alias("right")))


def invariance(texts: DataFrame, key: str, text: str, parts: int, chunked, whole: Column, secret: Column | None = None) -> DataFrame:
    """Whether an operator over chunks gives what it gives for the whole text, for every split into up to ``parts`` parts.

    ``chunked``: from the column of chunks to a column of text; ``whole``: the right result. For each key: n_splits, n_failing,
    n_leaked (splits whose result holds ``secret`` though the right one does not), first_cuts (of the failing splits, by the
    number of parts and then the cuts) and the different segments there (at, expected, got). Only sums and one least row for
    each key are kept, with partial sums before the exchange.
    """
    s = all_splits(texts.withColumn("_whole", whole), text, parts)
    s = s.withColumn("_got", chunked(chunks(F.col(text), F.col("cuts"))))
    bad = ~F.col("_got").eqNullSafe(F.col("_whole"))
    out = F.lit(False) if secret is None else F.coalesce(F.contains(F.col("_got"), secret) & ~F.contains(F.col("_whole"), secret), F.lit(False))
    first = F.min(F.when(bad, F.struct(F.size("cuts").alias("n"), "cuts", F.col("_got").alias("got"), F.col("_whole").alias("whole")))).alias("_first")
    found = s.groupBy(key).agg(F.count(F.lit(1)).alias("n_splits"), F.count_if(bad).alias("n_failing"), F.count_if(bad & out).alias("n_leaked"), first)
    differs = different_part(F.col("_first.whole"), F.col("_first.got"))
    found = found.withColumn("_d", differs)
    return found.select(key, "n_splits", "n_failing", "n_leaked", F.col("_first.cuts").alias("first_cuts"), F.col("_d.start").alias("at"), F.col("_d.left").alias("expected"), F.col("_d.right").alias("got"))


def report(found: DataFrame, key: str) -> DataFrame:
    """The report's lines: one for each key that fails, and a last one that says how many do."""
    line = F.format_string("%s: %d of %d splits differ, first at cuts [%s]: expected '%s' at %d, got '%s'%s", F.col(key).cast("string"), "n_failing", "n_splits", F.array_join(F.transform("first_cuts", lambda c: c.cast("string")), ", "), "expected", "at", "got", F.when(F.col("n_leaked") > 0, F.format_string("; %d leak", "n_leaked")).otherwise(""))
    lines = found.where("n_failing > 0").select(F.lit(0).alias("part"), F.col(key).cast("string").alias("key"), line.alias("line"))
    total = found.agg(F.format_string("%d of %d texts differ over %d splits", F.count_if(F.col("n_failing") > 0), F.count(F.lit(1)), F.coalesce(F.sum("n_splits"), F.lit(0))).alias("line"))
    return lines.unionByName(total.select(F.lit(1).alias("part"), F.lit("").alias("key"), "line"))
