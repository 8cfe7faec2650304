"""Normalised and folded scans, encoded spans, the IBAN table, and addresses by the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from palimpsest.functions import detect as D
from palimpsest.functions import patterns as P
from palimpsest.functions import text as T
from palimpsest.operators import governance as G


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r.i: r for r in D.with_spans(df, "text", **options).collect()}
    return [[(s.entity_type, s.matched) for s in rows[i].spans] for i in range(len(texts))]


def test_hidden_addresses_are_found(spark):
    texts = ["to jоhn@example.com now", "to jo​hn@exam­ple.com now", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "é john@example.com é", "жук и рак", None, ""]
    got = found(spark, texts)
    assert got[0] == [("EMAIL", "jоhn@example.com")]
    assert got[1:4] == [[("EMAIL", "john@example.com")]] * 3 and got[4:] == [[]] * 3


def test_table_of_look_alikes_from_public_lines(spark):
    table = T.confusables(["﻿# a comment", "0561 ;\t0077 ;\tMA\t# name", "0430 ; 0061 ; MA", "1D41A ; 0041 ; MA", "0430 0430 ; 0061 ; MA", "0391 ; 0391 ; MA", "006D ; 0072 006E ; MA"])
    assert table == ("աа\U0001d41a", "waa")
    assert found(spark, ["jոhա@example.com", "x աw@example.com"], table=table)[1] == [("EMAIL", "աw@example.com")]


def test_encoded_values_are_spans_of_the_text(spark):
    texts = ["see am9obkBleGFtcGxlLmNvbQ== there", "see john%40example.com there", "see john&#64;example.com there", "plain words only"]
    got = found(spark, texts, encoded=True)
    assert [x[0][0] for x in got[:3]] == ["BASE64_OBFUSCATED_PII", "PERCENT_OBFUSCATED_PII", "ENTITY_OBFUSCATED_PII"] and got[3] == []


def test_every_country_of_the_table_is_found(spark):
    rng = random.Random(7)
    countries = P.iban_countries()
    assert len(countries) == 105 and {c: n for c, n, _ in countries}["BA"] == 20 and ("GR", 27, True) in countries
    texts = []
    for code, length, letters in countries:
        body = "".join(rng.choice("ABCDEFGH" if letters and k % 3 == 0 else "1357") for k in range(length - 4))
        plain = f"{code}42{body}"
        texts += [f"iban {plain}.", "iban " + " ".join(plain[k : k + 4] for k in range(0, length, 4)) + " end", f"iban {plain}7Z."]
    got = found(spark, texts, types=("IBAN",), secrets=False)
    for k, text in enumerate(texts):
        assert got[k] == ([("IBAN", text[5:-1] if k % 3 == 0 else text[5:-4])] if k % 3 < 2 else []), text


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(3)
    texts = ["::", "::1", "fe80::1%eth0", "FD00::8", "2001:db8::", "64:ff9b::10.0.0.1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8", "1:2:3", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7:8:9", "256.1.1.1", "10.1.2.3", "8.8.8.8", "255.255.255.255", "", None, "host"]
    for _ in range(200):
        groups = [rng.choice(["0", "1", "fc00", "fe80", "ff02", "2001", "db8", "64", "ff9b", "100"]) for _ in range(8)]
        texts.append(str(ipaddress.ip_address(":".join(groups))))
    nets = list(map(ipaddress.ip_network, G.DENIED_NETS))
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", G.denied_address(F.col("a")).alias("denied"), G.ipv6(F.col("a")).alias("h")).collect()
    for r in rows:
        try:
            x = ipaddress.ip_address(r.a)
        except (ValueError, TypeError):
            assert r.denied and r.h is None, r
            continue
        x = getattr(x, "ipv4_mapped", None) or x
        assert r.denied == any(x.version == n.version and x in n for n in nets), r
        if x.version == 6:
            assert r.h == f"{int(x):032X}"


def test_modes_hosts_and_providers(spark):
    row = spark.range(1).select(
        *[G.egress_mode(F.lit(m).cast("string")).alias(n) for n, m in (("a", None), ("b", " default_block"), ("c", "allowlist_only"), ("d", "typo"), ("e", ""))],
        *[G.host(F.lit(u)).alias(n) for n, u in (("f", "HTTPS://u:p@A.Example.com.:8443/x"), ("g", "http://[2001:DB8::1]:80"), ("h", "http:\\\\a.com"), ("i", "ht\ntp://b.org"), ("j", "ftp://b.org"), ("k", "http://[::1"))],
        G.provider_of(F.lit(None).cast("string"), F.lit("claude-9"), F.lit("resold.example"), "openai").alias("l"),
    ).first()
    assert list(row) == ["DEFAULT_BLOCK", "DEFAULT_BLOCK", "ALLOWLIST_ONLY", "ALLOWLIST_ONLY", "ALLOWLIST_ONLY", "a.example.com", "[2001:db8::1]", None, "b.org", None, None, "openai"]


def test_ranges_that_are_no_prefixes(spark):
    rng = random.Random(5)
    addresses = [(i, str(ipaddress.ip_address(rng.randrange(1 << 12)))) for i in range(300)]
    nets = [(k, low := rng.randrange(1 << 12), low + rng.choice([0, 1, 2, 5, 100, 700])) for k in range(40)] + [(99, 10, 5)]
    got = {(r.i, r.net) for r in G.in_networks(spark.createDataFrame(addresses, "i int, ip string"), spark.createDataFrame(nets, "net int, low long, high long")).collect()}
    assert got == {(i, k) for i, a in addresses for k, low, high in nets if low <= int(ipaddress.ip_address(a)) <= high}
