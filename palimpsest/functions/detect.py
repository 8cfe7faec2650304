"""Detection as Catalyst expressions: typed spans with code-point offsets, entropy, validators, resolution.

A span is a struct (start, end, entity_type, matched, priority). Nothing here
crosses to Python; null text gives no spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P

SPAN = "array<struct<start:int,end:int,entity_type:string,matched:string,priority:int>>"


def pattern_spans(text: Column, name: str, pattern: str, priority: int, wanted: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of one pattern, where it is wanted: lengths of what lies between the matches give the offsets, in code points. With ``keep``,
    a condition on what matched, the others are left out as they are met: each span that is added copies those before it, so a
    pattern that most words match would cost the square of their number."""
    # Zipped before the fold, so that each side is computed once for each text.
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))
    start = lambda acc, x: acc["at"] + x["gap"]
    added = lambda acc, x: F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + F.length(x["hit"])).alias("end"), F.lit(name).alias("entity_type"), x["hit"].alias("matched"), F.lit(priority).alias("priority"))))
    step = lambda acc, x: F.struct(
        (start(acc, x) + F.length(x["hit"])).alias("at"),
        (added(acc, x) if keep is None else F.when(keep(x["hit"]), added(acc, x)).otherwise(acc["out"])).alias("out"),
    )
    folded = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    gate = P.GATES.get(name)
    maybe = text.isNotNull() if wanted is None else text.isNotNull() & wanted
    if isinstance(gate, str):
        maybe &= text.rlike(gate)
    elif gate:
        maybe &= reduce(or_, [text.contains(g) for g in gate])
    return F.when(maybe, folded).otherwise(F.array().cast(SPAN))


def entropy(token: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(token, "")
    n = F.length(token).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def is_secret(token: Column) -> Column:
    h = entropy(token)
    return (h >= P.SECRET_BITS) | (token.rlike(f"^[0-9a-fA-F]{{{P.HEX_LENGTH},}}$") & (h >= P.HEX_BITS))


def secret_spans(text: Column) -> Column:
    return pattern_spans(text, "SECRET_KEY", P.SECRET, len(P.BUILT_IN), keep=is_secret)


def resolve(spans: Column) -> Column:
    """Disjoint spans: by start, the longer first, then by priority; each is kept if it begins where the last kept one ends or later."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["priority"] - b["priority"]))
    fold = lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).when(s["start"] >= F.element_at(acc, -1)["end"], F.concat(acc, F.array(s))).otherwise(acc)
    return F.aggregate(ordered, F.array().cast(SPAN), fold)


def complete_digit_runs(text: Column, spans: Column) -> Column:
    """A span that ends in a digit grows over the digits that go on, single separators between, up to the next span."""
    grown = lambda s, i: F.length(F.coalesce(F.regexp_substr(F.substring(text, s["end"] + 1, F.coalesce(F.get(spans, i + 1)["start"], F.length(text)) - s["end"]), F.lit(r"^(?:\p{Nd}|[-. ]\p{Nd})+")), F.lit("")))

    def grow(s, i):
        more = F.when(s["matched"].rlike(r"\p{Nd}$"), grown(s, i)).otherwise(F.lit(0))
        return F.struct(s["start"].alias("start"), (s["end"] + more).alias("end"), s["entity_type"].alias("entity_type"), F.substring(text, s["start"] + 1, s["end"] + more - s["start"]).alias("matched"), s["priority"].alias("priority"))

    return F.transform(spans, grow)


def tier1(text: Column, types: tuple[str, ...] | None = None, custom: tuple[tuple[str, str], ...] = (), allowed: Column | None = None) -> Column:
    """All spans of the chosen built-in patterns (all by default) and of custom (name, pattern) rules, which come last. ``allowed``
    is each row's array of types, null for all; a rule takes the place of the built-in pattern of its name there."""
    chosen = [(n, p, P.PRIORITY[n]) for n, p in P.BUILT_IN if types is None or n in types] + [(n, p, 100 + k) for k, (n, p) in enumerate(custom)]
    own = {n for n, _ in custom}

    def wanted(name: str, priority: int) -> Column | None:
        if allowed is None:
            return None
        return allowed.isNull() if name in own and priority < 100 else allowed.isNull() | F.array_contains(allowed, name)

    return F.flatten(F.array(*[pattern_spans(text, n, p, k, wanted(n, k)) for n, p, k in chosen]))


def spans_of_both(text: Column, folded: Column, types: tuple[str, ...] | None = None, custom: tuple[tuple[str, str], ...] = (), allowed: Column | None = None) -> Column:
    """Spans that the patterns find in a text and, where it differs, in its copy with look-alikes folded, one character for one; all
    name the text's own. The patterns stand in the plan once, for both."""
    own = lambda s: F.struct(s["start"], s["end"], s["entity_type"], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("matched"), s["priority"])
    both = F.array_compact(F.array(text, F.when(folded != text, folded)))
    return F.transform(F.flatten(F.transform(both, lambda t: tier1(t, types, custom, allowed))), own)


def with_spans(df: DataFrame, text: str = "text", types: tuple[str, ...] | None = None, secrets: bool = True, custom: tuple[tuple[str, str], ...] = (), out: str = "spans", encoded: bool | None = None, table: tuple[str, str] | None = None, allowed: str | None = None) -> DataFrame:
    """df with its resolved, completed spans in a column. The text is normalised first and is so in the result, which the spans
    count in; patterns are tried on it and on its copy with look-alikes folded (by a table, if given). With encoded (so if
    no types are chosen), runs whose decoding holds a value are spans too. ``allowed`` names a column of each row's types (null: all);
    secrets and encoded runs are not subject to it. Each step is exploded from an array of one, or the optimizer would copy the whole of
    it into every place that uses it."""
    from palimpsest.functions import encoded as E
    from palimpsest.functions import text as T

    once = lambda c: F.explode(F.array(c))
    columns = df.columns
    t = F.col(text)
    d = df.withColumn(text, once(T.normalize(t)))
    found = spans_of_both(t, T.fold_look_alikes(t, table), types, custom, F.col(allowed) if allowed else None)
    if secrets:
        found = F.concat(found, secret_spans(t))
    if types is None if encoded is None else encoded:
        d = E.with_entity_spans(d.withColumn("_encoded", once(F.concat(E.base64_spans(t), E.percent_spans(t)))), text, "_entities")
        found = F.concat(found, F.col("_encoded"), F.col("_entities"))
    resolved = d.withColumn("_resolved", once(resolve(found)))
    return resolved.withColumn(out, once(complete_digit_runs(t, F.col("_resolved")))).select(*[c for c in columns if c != out], out)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_issuer(number: Column) -> Column:
    """Whether digits begin like a payment card's."""
    return number.rlike("^(?:" + "|".join(P.IIN_PREFIXES) + ")") | F.substring(number, 1, 6).cast("int").between(*P.IIN_SERIES)


def luhn(number: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def mod97(iban: Column) -> Column:
    """The check sum of an account number: letters count from 10, the first four characters go last."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))


def confidence(entity_type: Column, matched: Column) -> Column:
    d = digits(matched)
    card = F.length(d).between(*P.CARD_DIGITS) & is_issuer(d) & luhn(d)
    return F.when((entity_type == "IBAN") & (mod97(matched) == 1), "high").when((entity_type == "CREDIT_CARD") & card, "high").otherwise("medium")
