"""Text functions: normalisation, bounded decoding, markers, keyed digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import patterns as P


#: Rows that a Python function takes apart before it gives them out: trees of a whole Arrow batch are many times its texts.
AT_ONCE = 256


def in_parts(batches: Iterator) -> Iterator[tuple]:
    """Batches of one or several series, as tuples of series of at most AT_ONCE rows; an empty batch stays one."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, max(len(columns[0]), 1), AT_ONCE):
            yield tuple(c.iloc[at : at + AT_ONCE] for c in columns)


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, P.INVISIBLE, "")


def normalize(text: Column) -> Column:
    """NFKC, then without invisible characters; texts of settled characters are the same already and stay in the JVM."""
    plain = text.rlike(P.SETTLED)
    return F.when(plain, text).otherwise(strip_invisible(_nfkc(F.when(~plain, text))))


#: Look-alikes of Latin letters: full-width forms by rule, and the usual Cyrillic and Greek ones.
_LOOK_ALIKE = ("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhqwABEKMHOPCTXIJSABEZHIKMNOPTYXo")


def confusables(lines: list[str]) -> tuple[str, str]:
    """Look-alikes and their ASCII letters or digits in lower case, of lines of the public confusables table (code points as hex:
    ``source ; prototype ; type``). Only single characters beyond ASCII with a single ASCII letter or digit as prototype count."""
    found = {}
    for line in lines:
        fields = [x.split() for x in line.lstrip("\ufeff").split("#")[0].split(";")]
        if len(fields) < 2 or len(fields[0]) != 1 or len(fields[1]) != 1:
            continue
        look, plain = (chr(int(x[0], 16)) for x in fields[:2])
        if not look.isascii() and plain.isascii() and plain.isalnum():
            found[look] = plain.lower()
    return "".join(found), "".join(found.values())


def fold_look_alikes(text: Column, table: tuple[str, str] | None = None) -> Column:
    """One character for one, so that offsets hold."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F))
    a, b = table or _LOOK_ALIKE
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, a + wide[0], b + wide[1])).otherwise(text)


def percent_decode(text: Column) -> Column:
    """Percent escapes as UTF-8; a plus sign stays one, a stray percent sign too."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(kept), text)).otherwise(text)


def base64_decode(token: Column) -> Column:
    """Standard or URL-safe alphabet, padded or not; null where it is no UTF-8 text."""
    raw = F.try_to_binary(F.rtrim(F.translate(token, "-_", "+/"), F.lit("=")), F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


#: Fixed value: instructions that pretend to come from the system.
INJECTION = r"(?i)\b(?:system\s+override|ignore\s+all\s+previous\s+instructions|<\|im_start\|>system|<\|im_end\|>)\b"


def neutralize(role: Column, text: Column) -> Column:
    """Only what tools and functions say is searched for injected instructions."""
    return F.when(role.isin("tool", "function"), F.regexp_replace(text, INJECTION, "[SYSTEM_OVERRIDE_BLOCKED]")).otherwise(text)


def block_images(text: Column, originals: Column | None = None) -> Column:
    """Markdown images whose address could carry data out: with a query, with ``leak`` in it, or with one of a session's ``originals`` (an
    array) of at least four characters. The address goes, the image's description stays."""
    image = r"!\[(.*?)\]\((https?://[^\s)]+)\)"
    found = F.regexp_extract_all(text, F.lit(image), F.lit(2))
    known = F.filter(F.coalesce(originals if originals is not None else F.lit(None), F.array().cast("array<string>")), lambda o: F.length(o) >= 4)
    carries = lambda u: u.contains("?") | F.contains(F.lower(u), F.lit("leak")) | F.exists(known, lambda o: F.contains(u, o))
    between, names = F.split(text, image, -1), F.regexp_extract_all(text, F.lit(image), F.lit(1))
    rewritten = F.transform(F.arrays_zip(names.alias("name"), found.alias("url")), lambda x: F.concat(F.lit("!["), x["name"], F.lit("]("), F.when(carries(x["url"]), F.lit("[IMAGE_EXFILTRATION_BLOCKED]")).otherwise(x["url"]), F.lit(")")))
    joined = F.array_join(F.flatten(F.zip_with(between, rewritten, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    return F.when(text.contains("!["), joined).otherwise(text)


def json_body(text: Column) -> Column:
    """A string as it stands between the quotes of JSON."""
    quoted = F.to_json(F.struct(text.alias("x")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def simple_tokens(text: Column) -> Column:
    """Words with the space before them, digits by three, runs of punctuation, and white space."""
    return F.regexp_extract_all(text, F.lit(r" ?[A-Za-z]+|\d{1,3}| ?[^\sA-Za-z\d]+|\s+"), F.lit(0))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a string column under a constant key, as lower-case hex."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def watermark(hex_text: Column) -> Column:
    """Hex digits as bits of two invisible characters between two marks."""
    bits = F.array_join(F.transform(F.split(hex_text, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    return F.concat(F.lit("‍"), F.translate(bits, "01", "​‌"), F.lit("‍"))


def read_watermark(text: Column) -> Column:
    bits = F.translate(F.regexp_extract(text, "‍([​‌]+)‍", 1), "​‌", "01")
    nibbles = F.regexp_extract_all(bits, F.lit("[01]{4}"), F.lit(0))
    return F.array_join(F.transform(nibbles, lambda b: F.lower(F.conv(b, 2, 16))), "")
