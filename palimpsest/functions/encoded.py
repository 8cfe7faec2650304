"""Values hidden by encodings: base64, percent escapes and HTML entities.

Each function gives spans of whole encoded runs whose decoding holds a value
that the built-in patterns find. Runs over LIMIT characters are decoded at both
edges only. Null text gives no spans.
"""

from __future__ import annotations

import html
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.functions import detect as D
from palimpsest.functions import patterns as P
from palimpsest.functions import text as T

# Candidates and bounds.
LIMIT, EDGE, ROUNDS, SHORTEST = 8192, 256, 3, 6
BASE64 = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{8,}={0,2}(?![A-Za-z0-9+/=_-])"
#: Those of BASE64 that can be UTF-8: one whose first character is none of these begins with a byte that begins no character, and
#: only of a run over LIMIT another part is decoded too.
BASE64_TEXT = r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-fw-z0-9][A-Za-z0-9+/_-]{7,}|[A-Za-z0-9+/_-]{8191,})={0,2}(?![A-Za-z0-9+/=_-])"
# Both begin at a run's beginning only, or a long run without an escape would be read once for each of its characters.
PERCENT = r"(?<![^\s\"'<>{}\[\],;()])[^\s\"'<>{}\[\],;()]*?%[0-9A-Fa-f]{2}[^\s\"'<>{}\[\],;()]*"
ENTITY = "(?<![^ \\t\\r\\n\\f\\x0B\"'<>{}\\[\\](),])[^ \\t\\r\\n\\f\\x0B\"'<>{}\\[\\](),]*?&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});[^ \\t\\r\\n\\f\\x0B\"'<>{}\\[\\](),]*"


def holds_value(text: Column) -> Column:
    """Whether any built-in pattern is found in a text."""
    return (F.length(text) >= SHORTEST) & reduce(or_, [text.rlike(p) for _, p in P.BUILT_IN])


def edges(token: Column) -> Column:
    """A run as a whole, or its two edges; the tail begins at a multiple of four."""
    n = F.length(token)
    tail = n - EDGE - (n - EDGE) % 4
    return F.when(n > LIMIT, F.array(F.substring(token, F.lit(1), F.lit(EDGE)), F.substring(token, tail + 1, n))).otherwise(F.array(token))


def _nested(token: Column) -> Column:
    """Base64 in base64: the decodings of up to ROUNDS rounds, each of the one before."""
    start = F.struct(token.alias("next"), F.array().cast("array<string>").alias("out"))

    def step(acc, _):
        plain = T.base64_decode(acc["next"])
        again = F.when(F.trim(plain).rlike(f"^(?:{BASE64})$"), F.trim(plain))
        return F.struct(again.alias("next"), F.concat(acc["out"], F.array(plain)).alias("out"))

    return F.array_compact(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["out"]))


def base64_spans(text: Column) -> Column:
    # Most words decode to nothing: they are asked no more.
    may = lambda m: (F.length(m) > LIMIT) | T.base64_decode(m).isNotNull()
    holds = lambda m: may(m) & F.exists(edges(m), lambda e: F.exists(_nested(e), holds_value))
    return D.pattern_spans(text, "BASE64_OBFUSCATED_PII", BASE64_TEXT, len(P.BUILT_IN) + 1, keep=holds)


def percent_spans(text: Column) -> Column:
    holds = lambda m: F.exists(edges(m), lambda e: holds_value(T.percent_decode(e)) & (T.percent_decode(e) != e))
    return D.pattern_spans(text, "PERCENT_OBFUSCATED_PII", PERCENT, len(P.BUILT_IN) + 2, keep=holds)


@F.pandas_udf(ArrayType(StringType()))
def unescape_all(tokens: pd.Series) -> pd.Series:
    """HTML entities of each string of an array."""
    return tokens.map(lambda row: [html.unescape(t) for t in row], na_action="ignore")


def with_entity_spans(df: DataFrame, text: str = "text", out: str = "entity_spans") -> DataFrame:
    """df with a column of spans. Only texts with a candidate cross to Python, and of them the candidates only."""
    once = lambda c: F.explode(F.array(c))
    candidates = D.pattern_spans(F.col(text), "ENTITY_OBFUSCATED_PII", ENTITY, len(P.BUILT_IN) + 3)
    probes = F.flatten(F.transform(candidates, lambda s: F.transform(edges(s["matched"]), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    d = df.withColumn("_probes", once(probes)).withColumn("_plain", unescape_all(F.when(F.size("_probes") > 0, F.transform("_probes", lambda p: p["e"]))))
    d = d.withColumn("_plain", F.coalesce("_plain", F.array().cast("array<string>")))
    hits = F.filter(F.zip_with("_probes", "_plain", lambda p, x: F.struct(p["s"].alias("s"), (holds_value(x) & (x != p["e"])).alias("hit"))), lambda x: x["hit"])
    return d.withColumn(out, F.array_distinct(F.transform(hits, lambda x: x["s"]))).drop("_probes", "_plain")


def unescape(text: Column) -> Column:
    """A text without HTML entities."""
    return F.when(text.contains("&"), F.get(unescape_all(F.when(text.contains("&"), F.array(text))), 0)).otherwise(text)
