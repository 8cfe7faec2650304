"""Submissions and result pages: fields of a submitted text, labels and numbers of a page, tables as Markdown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an empty answer reads as, folded to lower case.
EMPTY = ("", "_no response_", "n/a", "none")


def fields(body: Column, headings: Mapping[str, str], empty: tuple[str, ...] = EMPTY) -> Column:
    """struct of one string for each field of ``headings`` (heading in lower case to field).

    A field is what stands under its heading (of level 2 to 4) up to the next heading, known or not; of two sections of
    one field the last counts. An answer in ``empty`` is an empty string, a field without its heading is null.
    """
    lines = F.regexp_replace(F.translate(body, "\x01\x02", ""), "\r\n?", "\n")
    marked = F.regexp_replace(lines, r"(?m)^[ \t]{0,3}#{2,4}[ \t]+(\S(?:.*?\S)?)[ \t]*$", "\x01$1\x02")
    parts = F.slice(F.split(marked, "\x01", -1), 2, 1 << 20)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    sections = F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, "\x02", 1)).alias("heading"), strip(F.substring_index(p, "\x02", -1)).alias("value")))

    def one(name: str) -> Column:
        own = F.filter(sections, lambda s: s["heading"].isin(*[h for h, f in headings.items() if f == name]))
        value = F.try_element_at(own, F.lit(-1))["value"]
        return F.when(F.lower(value).isin(*empty), "").otherwise(value).alias(name)

    return F.struct(*[one(name) for name in dict.fromkeys(headings.values())])


def request_path(measured: Column, claim: Column, leaked: Column, is_policy: Column) -> Column:
    """What a result page says of the request side. leaked: types seen there; a claim that is missing is not a clean one."""
    n = F.size(F.coalesce(leaked, F.array().cast("array<string>")))
    seen = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(" types seen)"))).otherwise("")
    return (
        F.when(~F.coalesce(measured, F.lit(False)), "not measured").when(claim == "not-configured", F.concat(F.lit("not configured"), seen))
        .when((claim == "configured") & (n > 0), F.concat(F.lit("configured, leaked: "), F.array_join(leaked, ", "))).when(claim == "configured", "configured, clean")
        .when(F.coalesce(is_policy, F.lit(False)), F.concat(F.lit("not applicable"), seen)).otherwise(F.concat(F.lit("claim not recorded"), seen))
    )


def number(value: Column, places: int = 4) -> Column:
    """A number without trailing zeros, ``n/a`` for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", value.cast("double")), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.when(value.isNull(), "n/a").when(text.isin("", "-0"), "0").otherwise(text)


def markdown(rows: DataFrame, by: str, order: str, columns: Mapping[str, str]) -> DataFrame:
    """(by, n_rows, table): a Markdown table for each group, rows by ``order``; columns: column to title.

    One group is one report. Bars in cells are escaped, line ends are spaces, nulls are empty cells.
    """
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns.values()) + " |\n|" + " :--- |" * len(columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")).alias("table"))
