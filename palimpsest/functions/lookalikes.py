"""A table of look-alike characters from a table of single steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def steps(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a public table of look-alikes (``source ; target ; kind # note``, code points in hex): those of one character each side."""
    fields = F.transform(F.split(F.substring_index("value", "#", 1), ";"), lambda x: F.regexp_replace(x, r"^[\s\x{FEFF}]+|\s+$", ""))
    rows = spark.read.text(path).select(fields.alias("f")).where("size(f) >= 2").select(F.element_at("f", 1).alias("a"), F.element_at("f", 2).alias("b"))
    rows = rows.where(r"a rlike '^[0-9A-Fa-f]{1,6}$' and b rlike '^[0-9A-Fa-f]{1,6}$'")
    return rows.select(_char("a").alias("source"), _char("b").alias("target")).groupBy("source").agg(F.max("target").alias("target"))


@F.pandas_udf(StringType())
def _char(hexadecimal: pd.Series) -> pd.Series:
    return hexadecimal.map(lambda x: chr(int(x, 16)))


def prototypes(edges: DataFrame, doublings: int = 4) -> DataFrame:
    """(source, target): each source followed to its end, 2 ** doublings steps at most, as a cycle has none.

    Each round joins the table with itself, so that a step becomes two; a target without a step of its own stays. No rows are
    collected; a round that changes nothing costs one join.
    """
    table = edges.select("source", "target").where("source is not null and target is not null")
    for _ in range(doublings):
        onward = table.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        table = table.join(onward, "target", "left").select("source", F.coalesce("_next", "target").alias("target"))
    return table


def folds(edges: DataFrame) -> DataFrame:
    """(source, target) that a fold of text consults: from a character beyond ASCII that compatibility decomposition keeps and that is
    no decimal digit, to one small ASCII letter or digit."""
    ends = prototypes(edges).where(r"target rlike '^[A-Za-z0-9]$' and not source rlike '^[\\x00-\\x7F]$'")
    return ends.where(_kept("source")).select("source", F.lower("target").alias("target"))


@F.pandas_udf(BooleanType())
def _kept(chars: pd.Series) -> pd.Series:
    return chars.map(lambda c: unicodedata.normalize("NFKD", c) == c and unicodedata.decimal(c, None) is None)


def as_pair(table: DataFrame) -> tuple[str, str]:
    """The table as two strings of equal length, for ``translate``. A table of characters is bounded by Unicode itself."""
    rows = table.orderBy("source").collect()
    return "".join(r.source for r in rows), "".join(r.target for r in rows)
