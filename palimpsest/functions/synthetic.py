"""Stand-ins that keep a value's shape, from a keyed digest.

A stand-in depends on the key, the session, the type and the value; it cannot
be computed without the key and differs between sessions. Ranges are those that
are never issued: 9xx areas, 555-01xx numbers, documentation networks and
example domains. A null value has a null stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import hmac_sha256

RETRIES = 7
GIVEN = tuple("Ada Ben Cleo Dario Elif Finn Greta Hugo Ines Jonas Kira Liam Mona Nils Olga Pavel".split())


def _number(digest: Column, at: int, below: int) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % below


def _digits(digest: Column, at: int, n: int) -> Column:
    return F.lpad(_number(digest, at, 10**n).cast("string"), n, "0")


def _card(digest: Column) -> Column:
    """Sixteen digits in a test range, with a right check digit."""
    body = F.concat(F.lit("400000"), _digits(digest, 1, 5), _digits(digest, 9, 4))
    return F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda n: F.call_function("luhn_check", n)), 1)


def stand_in(digest: Column, entity_type: Column) -> Column:
    """The stand-in of a type for a digest in hex."""
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    is_in = lambda *names: entity_type.rlike("|".join(names))
    hidden = of("ref_", F.substring(digest, 1, 12))
    return (
        F.when(is_in("OBFUSCATED"), hidden)
        .when(is_in("PERSON", "NAME"), F.element_at(F.array(*map(F.lit, GIVEN)), (_number(digest, 1, len(GIVEN)) + 1).cast("int")))
        .when(is_in("EMAIL"), of("user.", F.substring(digest, 1, 10), "@example.com"))
        .when(is_in("SSN"), of("9", _digits(digest, 1, 2), "-", _digits(digest, 9, 2), "-", _digits(digest, 17, 4)))
        .when(is_in("PHONE"), of("(", (_number(digest, 1, 700) + 200).cast("string"), ") 555-01", _digits(digest, 9, 2)))
        .when(is_in("^IP"), of("198.", (_number(digest, 1, 2) + 18).cast("string"), ".", _number(digest, 9, 256).cast("string"), ".", _number(digest, 17, 256).cast("string")))
        .when(is_in("CREDIT_CARD"), _card(digest))
        .when(is_in("IBAN"), of("XX00", _digits(digest, 1, 8), _digits(digest, 9, 8)))
        .when(is_in("NINO"), of("QQ", _digits(digest, 1, 6), F.substring(F.lit("ABCD"), (_number(digest, 9, 4) + 1).cast("int"), F.lit(1))))
        .when(is_in("DIGIT", "MRN"), of("9", _digits(digest, 1, 8), _digits(digest, 9, 3)))
        .when(is_in("KEY", "SECRET", "TOKEN", "PAT"), of("AKIA", F.upper(F.substring(digest, 1, 16))))
        .otherwise(hidden)
    )


def synthesize(vault: DataFrame, key: bytes, session: str = "session") -> DataFrame:
    """vault(session, original, entity_type, ordinal, token) with ``synthetic``: distinct in its session.

    Each value has its candidates of RETRIES further seeds; in each round the
    value that comes first by ordinal takes a candidate that several want, and
    the others go on. Who is left takes the tag. Rounds are one window each over
    (session, candidate), so no session is gathered in one task.
    """
    seed = lambda k: hmac_sha256(key, F.concat_ws("\x1f", session, "entity_type", "original", F.lit(str(k))))
    out = vault.withColumn("synthetic", stand_in(seed(0), F.col("entity_type")))
    for k in range(1, RETRIES + 1):
        rank = F.row_number().over(W.partitionBy(session, "synthetic").orderBy("_kept", "entity_type", "ordinal"))
        out = out.withColumn("_kept", F.lit(0)) if k == 1 else out
        out = out.withColumn("_rank", rank).withColumn("_kept", F.when(F.col("_rank") == 1, 0).otherwise(1))
        out = out.withColumn("synthetic", F.when(F.col("_rank") == 1, F.col("synthetic")).otherwise(stand_in(seed(k), F.col("entity_type")))).drop("_rank")
    last = F.row_number().over(W.partitionBy(session, "synthetic").orderBy("_kept", "entity_type", "ordinal"))
    return out.withColumn("_rank", last).withColumn("synthetic", F.when(F.col("_rank") == 1, F.col("synthetic")).otherwise(F.col("token"))).drop("_rank", "_kept")
