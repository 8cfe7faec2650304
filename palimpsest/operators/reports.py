"""Reports over runs, logs and texts: summaries, comparisons, leak tiers, verdicts, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def assessment(found: DataFrame, record: str, text: str, spans: str = "spans") -> DataFrame:
    """One row: records with and without findings, their bytes, and distinct values (each counted once in its record)."""
    values = F.size(F.array_distinct(F.transform(spans, lambda s: s["matched"])))
    has = F.size(spans) > 0
    return found.select(F.count(F.lit(1)).alias("n_records"), F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"), F.sum(F.octet_length(text)).alias("n_bytes"), F.sum(values).alias("n_values"))


def one_per_seed(observations: DataFrame, by: list[str], values: list[str], path: str = "path") -> DataFrame:
    """(by..., path, n_rows, conflict): the first path of each group, and whether its rows disagree in their values."""
    seen = F.count_distinct(F.struct(*values))
    return observations.groupBy(*by).agg(F.min(path).alias(path), F.count(F.lit(1)).alias("n_rows"), (seen > 1).alias("conflict"))


def compared(baseline: DataFrame, current: DataFrame, key: str, state: str) -> DataFrame:
    """(key, before, after, change): a key that only one run has is ``coverage``, which makes the comparison void."""
    b, c = baseline.select(key, F.col(state).alias("before")), current.select(key, F.col(state).alias("after"))
    change = F.when(F.col("before").isNull() | F.col("after").isNull(), "coverage").when((F.col("before") == "contained") & (F.col("after") == "leak"), "regression").when((F.col("before") == "leak") & (F.col("after") == "contained"), "improvement").otherwise("same")
    return b.join(c, key, "full").withColumn("change", change)


def folded(text: Column) -> Column:
    """What a reader sees as the same: compatibility forms, look-alikes and case folded, all but letters and digits gone."""
    return F.regexp_replace(F.lower(T.fold_look_alikes(T.normalize(text))), "[^0-9a-z]", "")


def longest_run(needle: Column, text: Column) -> Column:
    """Length of the longest part of a needle that a text holds. Needles are short: their parts are tried from each start."""
    n = F.length(needle)
    best = lambda i: F.aggregate(F.sequence(F.lit(1), n - i + 1), F.lit(0), lambda a, k: F.when(text.contains(F.substring(needle, i, k)), F.greatest(a, k)).otherwise(a))
    return F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(1), n), best))).otherwise(0)


def leak_tier(value: Column, raw: Column, fields: Column) -> Column:
    """How a value can be read from a reply: ``literal``, in one field, in fields of one path, or across fields; null if it cannot.

    ``fields`` is an array of (path, value), in order; values are compared folded.
    """
    target = folded(value)
    by_path = F.transform(F.array_distinct(F.transform(fields, lambda f: f["path"])), lambda p: F.array_join(F.transform(F.filter(fields, lambda f: f["path"] == p), lambda f: f["value"]), ""))
    # The value is normalised in full, the reply's fields by look-alikes only, in the JVM; the separator is none of a folded value's characters.
    plain = lambda c: F.regexp_replace(F.lower(T.fold_look_alikes(c)), "[^0-9a-z]", "")
    holds = lambda texts: F.array_join(F.transform(texts, plain), "|").contains(target)
    return (
        F.when(target == "", F.lit(None).cast("string")).when(raw.contains(value), "literal").when(holds(F.transform(fields, lambda f: f["value"])), "single_field")
        .when(holds(by_path), "same_path").when(holds(F.array(F.array_join(F.transform(fields, lambda f: f["value"]), ""))), "cross_field")
    )


def verdict(measured: Column, failed: Column, leaks: Column) -> Column:
    """The order matters: what was not measured is not clean, and a failed check is not either."""
    return F.when(~F.coalesce(measured, F.lit(False)), "NOT MEASURED").when(leaks > 0, "LEAK").when(failed > 0, "CHECK FAILED").otherwise("CLEAN")


def line_census(text: Column) -> Column:
    """struct(code, comment, blank) of a Python source; docstrings count as comments."""
    fences = lambda s: F.size(F.split(s, "\"\"\"|'''", -1)) - 1
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))

    def step(a, line):
        s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        blank, fenced = s == "", a["open"] | s.rlike("^(?:\"\"\"|''')")
        comment = ~blank & (fenced | s.startswith("#"))
        odd = fenced & ~blank & (fences(s) % 2 == 1)
        return F.struct((a["open"] != odd).alias("open"), (a["code"] + (~blank & ~comment).cast("int")).alias("code"), (a["comment"] + comment.cast("int")).alias("comment"), (a["blank"] + blank.cast("int")).alias("blank"))

    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r\n|\n|\r", -1)
    return F.when(text == "", F.struct(F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))).when(text.isNotNull(), F.aggregate(lines, start, step, lambda a: F.struct(a["code"].alias("code"), a["comment"].alias("comment"), a["blank"].alias("blank"))))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based identifier: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8, 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def observations(counts: DataFrame, namespace: str, run: str = "run", entity: str = "entity_type", n: str = "n_values") -> DataFrame:
    """(run, document): an assessment document as JSON, with one observation for each type, in order of type."""
    one = F.struct(uuid5(namespace, F.concat_ws("/", run, entity)).alias("uuid"), F.concat(F.col(entity), F.lit(": "), F.col(n).cast("string")).alias("description"), F.array(F.lit("EXAMINE")).alias("methods"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(entity).alias("k"), one.alias("o")))), lambda x: x["o"])
    return counts.groupBy(run).agg(F.to_json(F.struct(F.first(uuid5(namespace, F.col(run).cast("string"))).alias("uuid"), body.alias("observations"))).alias("document"))


def stable(repeats: DataFrame, condition: str, outcome: str, value: str) -> DataFrame:
    """(condition, n, median, is_stable): repeats of a measurement, stable if all came out alike."""
    return repeats.groupBy(condition).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), (F.count_distinct(outcome) == 1).alias("is_stable"))


def cases_digest(cases: DataFrame, by: str, case: Column) -> DataFrame:
    """(by, n_cases, digest): SHA-256 over the sorted digests of a group's cases, whatever order they come in."""
    h = cases.select(by, F.sha2(case, 256).alias("h"))
    return h.groupBy(by).agg(F.count(F.lit(1)).alias("n_cases"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))
