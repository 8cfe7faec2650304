"""Record and event-stream sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (record variant, error). A bare string counts as {"input": string}; other scalars and bad JSON are
    errors of their line, and go on as rows."""
    line = F.trim("value")
    text = F.when(line.startswith('"'), F.concat(F.lit('{"input":'), line, F.lit("}"))).otherwise(line)
    parsed = spark.read.text(path).where(line != "").select(F.try_parse_json(text).alias("record"), text.alias("raw"))
    bad = F.when(F.col("record").isNull(), "bad_json").when(~F.col("raw").rlike(r"^[{\[]"), "not_an_object")
    return parsed.select(F.when(bad.isNull(), F.col("record")).alias("record"), bad.alias("error"))


def sse_events(body: Column) -> Column:
    """Dispatched events of a server-sent stream, as an array of their data. Lines end in CR, LF or both; comments and
    other fields are left out; one space after the colon goes; what no blank line ends is residue and not an event."""
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "[\r\n]", -1)
    start = F.struct(F.array().cast("array<string>").alias("data"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        value = F.regexp_replace(line, "^data(?:: ?)?", "")
        more = F.concat(acc["data"], F.array(value))
        none = F.array().cast("array<string>")
        done = F.concat(acc["out"], F.array(F.array_join(acc["data"], "\n")))
        return F.struct(F.when(line == "", none).when(line.rlike("^data(?::|$)"), more).otherwise(acc["data"]).alias("data"), F.when((line == "") & (F.size(acc["data"]) > 0), done).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def flatten_paths(json: Column) -> Column:
    """Not for nesting: the top-level (key, value) pairs of a JSON object of scalars, in order of key."""
    return F.array_sort(F.map_entries(F.from_json(json, "map<string,string>")))
