"""Detection by tenant: rules of one's own, the types a tenant's profile asks for, and who expects names to be found.

Three tables set it: rules (position, name, pattern), profiles (profile, tier,
entity_type) and tenants (tenant, profile). A profile of no types is one row with
a null type. A tenant that is null, not named, named with several profiles or
with one that does not exist gets ``STRICT``: every type, built in or of a rule.
A type that nobody knows is passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P

STRICT = "global_strict"
#: Rules become part of the plan; more than this is an error, never a cut.
MAX_RULES = 500
#: Tenants up to which their scopes are broadcast, some hundred bytes each; beyond they are joined by an exchange.
FEW_TENANTS = 100_000
#: Fixed value: what only a model of names finds.
NER_TYPES = ("PERSON",)

_CLASS = re.compile(r"\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]", re.S)
_REFUSED = {
    "looks around": re.compile(r"\(\?<?[=!]"),
    "holds what it matched": re.compile(r"\(\?>|(?<!\\)(?:[*+?]|\})\+"),
    "asks for an earlier group": re.compile(r"\\(?:[1-9]|k[<{'])|\(\?P=|\(\?\("),
    "has an escape of backtracking engines": re.compile(r"\\[GZRXhHK]"),
}
_TIMES = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_MOST_TIMES = 1000


def linear_pattern(pattern: str) -> str:
    """The pattern as Spark takes it, or ValueError where an engine that runs in linear time has no such construct, or where it
    matches the empty text: such a rule would find something everywhere."""
    bare = re.sub(r"\\\\", "__", _CLASS.sub("_", re.sub(r"\\[\[\]]", "__", pattern)))
    for why, shape in _REFUSED.items():
        if shape.search(bare):
            raise ValueError(f"the rule {pattern!r} {why}")
    if any(int(n or 0) > _MOST_TIMES for m in _TIMES.finditer(bare) for n in m.groups()):
        raise ValueError(f"the rule {pattern!r} repeats more than {_MOST_TIMES} times")
    return pattern.replace("(?P<", "(?<")


def rules_of(rules: DataFrame) -> tuple[tuple[str, str], ...]:
    """The (name, pattern) of a table of rules, in the order of position and name. Rows without a name or a pattern are an error."""
    spark, rows = rules.sparkSession, rules.select("position", "name", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in sorted(rows, key=lambda r: (r.position is None, r.position, r.name or "")):
        if not r.name or not r.pattern:
            raise ValueError("a rule without a name or a pattern")
        pattern = linear_pattern(r.pattern)
        try:
            empty = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").find()
        except Exception as e:  # the JVM's own complaint
            raise ValueError(f"the rule {r.pattern!r} is no pattern") from e
        if empty:
            raise ValueError(f"the rule {r.pattern!r} matches the empty text")
        out.append((r.name, pattern))
    return tuple(out)


def scopes(tenants: DataFrame, profiles: DataFrame, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(tenant, profile, allowed): the known types of each tenant that has one profile, which exists."""
    known = list(dict.fromkeys([n for n, _ in P.BUILT_IN] + [n for n, _ in rules]))
    one = tenants.where("tenant is not null").groupBy("tenant").agg(F.min("profile").alias("profile"), F.max("profile").alias("_other")).where("profile = _other").drop("_other")
    asked = F.when((F.col("tier") == 1) & F.col("entity_type").isin(known), F.col("entity_type"))
    types = profiles.groupBy("profile").agg(F.array_sort(F.collect_set(asked)).alias("allowed"))
    return one.join(types, "profile").select("tenant", "profile", "allowed")


def scoped(df: DataFrame, tenant: str, tenants: DataFrame, profiles: DataFrame, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """df with ``profile``, the name of the profile in force, and ``allowed``, its types (null: all); columns of these names are
    replaced. ``with_spans(scoped(...), custom=rules, allowed="allowed")`` finds what is allowed before overlaps are resolved."""
    scope = scopes(tenants, profiles, rules).select(F.col("tenant").alias("_tenant"), F.col("profile").alias("_profile"), F.col("allowed").alias("_allowed"))
    if scope.limit(FEW_TENANTS + 1).count() <= FEW_TENANTS:
        scope = F.broadcast(scope)
    rows = df.select(*[c for c in df.columns if c.lower() not in ("profile", "allowed")])
    joined = rows.join(scope, F.col(tenant) == F.col("_tenant"), "left")
    return joined.select(*rows.columns, F.coalesce("_profile", F.lit(STRICT)).alias("profile"), F.col("_allowed").alias("allowed"))


def coverage(profiles: DataFrame, tenants: DataFrame, model_loaded: bool = False) -> DataFrame:
    """A row for each profile and for STRICT: the types it expects of a model of names, whether one is there, whether it expects in
    vain, and how many tenants are named with it (STRICT: those named with several profiles or one that does not exist)."""
    ner = F.when(F.col("tier") != 1, F.col("entity_type"))
    own = profiles.where("profile is not null").groupBy("profile").agg(F.array_sort(F.collect_set(ner)).alias("expected"))
    strict = profiles.sparkSession.range(1).select(F.lit(STRICT).alias("profile"), F.array(*map(F.lit, NER_TYPES)).alias("expected"))
    named = tenants.where("tenant is not null").select("tenant").distinct().join(scopes(tenants, profiles).select("tenant", "profile"), "tenant", "left")
    used = named.groupBy(F.coalesce("profile", F.lit(STRICT)).alias("profile")).agg(F.count(F.lit(1)).alias("n_tenants"))
    rows = own.where(F.col("profile") != STRICT).unionByName(strict).join(used, "profile", "left")
    expects = F.size("expected") > 0
    return rows.select("profile", F.array_join("expected", ",").alias("expected"), expects.alias("expects_names"), F.lit(model_loaded).alias("model_loaded"), (expects & F.lit(not model_loaded)).alias("unbacked"), F.coalesce("n_tenants", F.lit(0)).alias("n_tenants"))
