"""What a text may hide in encodings: a breadth-first search over decoders, each decoding with the run of the text it came from.

A round tries, on every text found in the round before: runs of base64 at each
of four alignments, cut and padded to whole groups, in both alphabets; runs of
at least eight hex bytes; percent escapes with plus for space; and lists of
character codes. A text is decoded once, whatever leads to it. ``ROUNDS`` rounds
are run; a text whose decodings come to more than ``MOST`` times its own length
is marked as not searched to the end, which a reader must not take for clean.
Spans are of code points in the text itself. Null gives null.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# What counts as a run, and how often decodings are decoded.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2}){8,}")
# Begins at a run's beginning only, or a long run without an escape would be read once for each of its characters.
PERCENT_RUN = re.compile(r"(?<![^\s\"'<>])[^\s\"'<>]*?%[0-9A-Fa-f]{2}[^\s\"'<>]*")
CODES_RUN = re.compile(r"\[\s*\d{1,7}(?:\s*,\s*\d{1,7})*\s*\]")
ROUNDS, MOST, FLOOR = 3, 64, 65_536
AT_ONCE = 1 << 20

FOUND = StructType([StructField("complete", BooleanType()), StructField("decodings", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("round", IntegerType()), StructField("kind", StringType()), StructField("text", StringType())])))])


def _base64(run: str) -> Iterator[str]:
    run = run.translate(str.maketrans("-_", "+/")).rstrip("=")
    for skip in range(4):
        part = run[skip:]
        whole = len(part) // 4 * 4
        # A rest of one character is no group.
        for piece in {part[:whole], part + "=" * (-len(part) % 4) if len(part) % 4 != 1 else part[:whole]}:
            try:
                yield base64.b64decode(piece).decode("utf-8", "ignore")
            except (binascii.Error, ValueError):
                continue


def _codes(run: str) -> Iterator[str]:
    codes = [int(x) for x in run.strip("[]").split(",")]
    if all(0 < c < 0x110000 and not 0xD800 <= c < 0xE000 for c in codes):
        yield "".join(map(chr, codes))


DECODERS = (
    ("base64", BASE64_RUN, _base64),
    ("hex", HEX_RUN, lambda run: iter([bytes.fromhex(run).decode("utf-8", "ignore")])),
    ("percent", PERCENT_RUN, lambda run: iter([unquote_plus(run)])),
    ("codes", CODES_RUN, _codes),
)


def decodings(text: str) -> tuple[bool, list[tuple[int, int, int, str, str]]]:
    """(complete, [(start, end, round, kind, decoded)]): of each distinct decoding the first way to it."""
    out, seen, level, room = [], {text}, [(None, text)], MOST * max(len(text), FLOOR)
    for round_ in range(1, ROUNDS + 1):
        following = []
        for span, source in level:
            for kind, pattern, decode in DECODERS:
                for m in pattern.finditer(source):
                    at = span or m.span()
                    for plain in decode(m[0]):
                        if plain.strip() and plain not in seen:
                            room -= len(plain)
                            if room < 0:
                                return False, out
                            seen.add(plain)
                            out.append((*at, round_, kind, plain))
                            following.append((at, plain))
        level = following
    return True, out


@pandas_udf(FOUND)
def hidden_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The decodings of each text; for a text that holds no run there is nothing to do but four searches. What is found is given out
    whenever it comes to AT_ONCE characters, since the decodings of a batch may be many times its texts."""
    for texts in batches:
        rows, size = [], 0
        for t in texts:
            rows.append((None, None) if t is None else decodings(t))
            size += sum(len(x[-1]) for x in rows[-1][1] or ()) + 256
            if size >= AT_ONCE:
                yield pd.DataFrame(rows, columns=["complete", "decodings"])
                rows, size = [], 0
        if rows or not len(texts):
            yield pd.DataFrame(rows, columns=["complete", "decodings"])
