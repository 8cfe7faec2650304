"""One use of an identifier within a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_uses(events: DataFrame, keys: list[str], ts: str, seconds: int = 420) -> DataFrame:
    """A stream of events without those whose keys were used in the ``seconds`` before: replays. The state of a key goes with the first batch after its
    period; until then a later use is dropped too."""
    return events.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def replays(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int = 420) -> DataFrame:
    """A table of events with ``replayed``. An event is one if another with its keys was let through in the ``seconds`` up to it.

    The uses of one key are folded in order of time; a key is an identifier made for one use, so its uses are few.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    uses = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col(order).alias("id")))).alias("_u"))
    none = F.lit(None).cast("long")
    over: Column = F.lit(seconds * 1_000_000)

    def step(acc, x):
        again = F.coalesce(x["t"] - acc["last"] < over, F.lit(False))
        return F.struct(F.when(again, acc["last"]).otherwise(x["t"]).alias("last"), F.concat(acc["out"], F.array(F.struct(x["id"].alias(order), again.alias("replayed")))).alias("out"))

    kind = dict(events.dtypes)[order]
    folded = F.aggregate("_u", F.struct(none.alias("last"), F.array().cast(f"array<struct<{order}:{kind},replayed:boolean>>").alias("out")), step, lambda acc: acc["out"])
    return uses.select(*keys, F.inline(folded))
