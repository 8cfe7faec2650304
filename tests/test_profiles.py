import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import detect as D
from palimpsest.operators import profiles as R
from palimpsest.plans import detection

SMALL = "/root/testdata/sf0.001"
PROFILES = [("mail", 1, "EMAIL"), ("mail", 3, "PERSON"), ("own", 1, "IP_ADDRESS"), ("own", 1, "CODE"), ("own", 1, "NOBODY"), ("bare", 1, None)]
TENANTS = [("a", "mail"), ("b", "own"), ("c", "bare"), ("d", "gone"), ("e", "mail"), ("e", "own"), (None, "mail"), ("a", "mail")]
TEXT = "write to jo@example.org from 10.1.2.3 about AB-1234@example.org"


def tables(spark):
    return spark.createDataFrame(TENANTS, "tenant string, profile string"), spark.createDataFrame(PROFILES, "profile string, tier int, entity_type string")


def test_scope_comes_before_overlaps(spark):
    rules = R.rules_of(spark.createDataFrame([(2, "EMAIL", "jo@[a-z]+"), (1, "CODE", "[A-Z]{2}-[0-9]{4}")], "position int, name string, pattern string"))
    assert rules == (("CODE", "[A-Z]{2}-[0-9]{4}"), ("EMAIL", "jo@[a-z]+"))
    df = spark.createDataFrame([(t, TEXT, "x", 1) for t in ("a", "b", "c", "d", "e", "f", None)] + [("a", None, "x", 1), ("a", "", "x", 1)], "tenant string, text string, Profile string, allowed int")
    rows = R.scoped(df, "tenant", *tables(spark), rules)
    assert rows.columns == ["tenant", "text", "profile", "allowed"]
    found = D.with_spans(rows, secrets=False, custom=rules, encoded=False, allowed="allowed").collect()
    got = {(r.tenant, r.profile): [(s.entity_type, s.matched) for s in r.spans] for r in found if r.text}
    every = [("EMAIL", "jo@example.org"), ("IP_ADDRESS", "10.1.2.3"), ("EMAIL", "AB-1234@example.org")]
    # A rule of a built-in's name takes its place in a profile; the code is hidden by the longer address only where that is asked for.
    assert got[("a", "mail")] == [("EMAIL", "jo@example")]
    assert got[("b", "own")] == [("IP_ADDRESS", "10.1.2.3"), ("CODE", "AB-1234")]
    assert got[("c", "bare")] == []
    assert all(got[(t, R.STRICT)] == every for t in ("d", "e", "f", None))
    assert [r.spans for r in found if not r.text] == [[], []]


def test_each_profile_equals_detection_with_its_types_alone(spark):
    tenants, profiles, rules = detection.profile_tables(spark, SMALL)
    got = {tuple(r) for r in detection.profile_spans(spark, SMALL).drop("value_sha256").collect()}
    rows = R.scoped(detection.docs(spark, SMALL).select("doc_id", "source", "text"), "source", tenants, profiles, rules).cache()
    want = set()
    for profile, types, custom in (("mail", ("EMAIL",), ()), ("net", ("IP_ADDRESS", "PHONE", "CREDIT_CARD"), rules), (R.STRICT, None, rules)):
        alone = D.with_spans(rows.where(F.col("profile") == profile).drop("allowed"), types=types, secrets=False, custom=custom, encoded=False)
        want |= {(r.doc_id, r.profile, s.start, s.end, s.entity_type) for r in alone.collect() for s in r.spans}
    assert got == want and {x[1] for x in want} == {"mail", "net", R.STRICT}


@pytest.mark.parametrize("name", ["profile_docs", "profile_coverage"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = con.sql(detection.ORACLES[name])
    got = detection.QUERIES[name](spark, SMALL).select(*sql.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_coverage_counts_tenants_of_the_profile_in_force(spark):
    tenants, profiles = tables(spark)
    got = {r.profile: (r.expected, r.unbacked, r.n_tenants) for r in R.coverage(profiles, tenants).collect()}
    assert got == {"mail": ("PERSON", True, 1), "own": ("", False, 1), "bare": ("", False, 1), R.STRICT: ("PERSON", True, 2)}
    assert not any(r.unbacked for r in R.coverage(profiles, tenants, True).collect())
    none = R.coverage(profiles.limit(0), tenants.limit(0)).collect()
    assert [(r.profile, r.n_tenants) for r in none] == [(R.STRICT, 0)]


@pytest.mark.parametrize("pattern", ["(?=a)b", "(?<!a)b", r"(a)\1", "a++b", "a{2}+b", "(?>a)b", r"(?P<x>a)(?P=x)", "a{1001}", r"b\Z"])
def test_rules_of_backtracking_engines_are_refused(pattern):
    with pytest.raises(ValueError):
        R.linear_pattern(pattern)


def test_rules_that_run_in_linear_time_pass(spark):
    for pattern in (r"\++b", r"a\\+b", "[+*]+x", r"[\]=]+\[", "(?P<x>a)b{2,1000}", "(?i:a)|b", r"\\1x", "[(?=]a"):
        assert R.linear_pattern(pattern) == pattern.replace("?P<", "?<")
    rule = lambda p, n="x": spark.createDataFrame([(1, n, p)], "position int, name string, pattern string")
    for bad in (rule("a*"), rule("(a"), rule(None), rule("a", None), spark.range(R.MAX_RULES + 1).selectExpr("id AS position", "'x' AS name", "'a' AS pattern")):
        with pytest.raises(ValueError):
            R.rules_of(bad)
