"""Byte streams cut anywhere: lines of text, and bodies under transfer and content encodings.

Chunks of a source are walked in order with what is not yet a line in hand:
bytes of an unfinished character, characters of an unfinished line. Memory is
one chunk and one line, and a line longer than the cap ends its source with an
error row (nothing after it is read). Lines end in LF, CR or CRLF, also when a
cut lies between the two; what no line end closes is the last line. Bytes that
are no UTF-8 become U+FFFD. Null chunks are empty.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

LINES = "source string, line long, text string, error string"


class Framer:
    """Lines out of chunks; ``end`` gives the last one."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.decode = most, codecs.getincrementaldecoder("utf-8")("replace").decode
        self.held, self.length, self.after_cr = [], 0, False

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[str]:
        text = self.decode(chunk, last)
        if self.after_cr and text:
            text, self.after_cr = text.removeprefix("\n"), False
        if text.endswith("\r"):
            self.after_cr = True
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for piece in lines[:-1]:
            yield self._line(piece)
        self._hold(lines[-1])

    def _hold(self, piece: str) -> None:
        self.length += len(piece)
        if self.length > self.most:
            raise ValueError("line_too_long")
        self.held.append(piece)

    def _line(self, piece: str) -> str:
        self._hold(piece)
        out = "".join(self.held)
        self.held, self.length = [], 0
        return out

    def end(self) -> Iterator[str]:
        yield from self.feed(b"", True)
        if self.length:
            yield self._line("")


def framed(chunks: DataFrame, most: int = 1 << 20) -> DataFrame:
    """chunks(source, seq, bytes) to rows of LINES. A partition's sources come one after another, each in order of seq."""
    rows = chunks.select(F.col("source").cast("string"), "seq", F.col("bytes").cast("binary")).repartition("source").sortWithinPartitions("source", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, framer, line = object(), None, 0

        def take(lines: Iterator[str]) -> list[tuple]:
            nonlocal line, framer
            out = []
            try:
                for text in lines:
                    line += 1
                    out.append((name, line, text, None))
            except ValueError as why:
                framer = None
                out.append((name, line + 1, None, str(why)))
            return out

        for pdf in batches:
            out = []
            for source, _, data in pdf.itertuples(index=False, name=None):
                source = source if isinstance(source, str) else None
                if source != name:
                    if framer:
                        out += take(framer.end())
                    name, framer, line = source, Framer(most), 0
                if framer and data:
                    out += take(framer.feed(bytes(data)))
            yield pd.DataFrame(out, columns=["source", "line", "text", "error"])
        if framer:
            yield pd.DataFrame(take(framer.end()), columns=["source", "line", "text", "error"])

    return rows.mapInPandas(run, LINES)


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer framing; ValueError where that is broken or not ended."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("bad_chunk")
        digits = body[at:end].split(b";")[0].strip()
        if not digits or any(c not in b"0123456789abcdefABCDEF" for c in digits) or len(digits) > 15:
            raise ValueError("bad_chunk")
        size, at = int(digits, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("bad_chunk")
        out.append(body[at : at + size])
        at += size + 2


def inflated(body: bytes, encoding: str, most: int) -> bytes:
    """A body without its content encodings, the last one first; ValueError for an unknown one, bad data, or more than ``most`` bytes."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            raise ValueError("unknown_encoding")
        # Deflate comes with and without its zlib frame.
        for wbits in (31,) if name != "deflate" else (15, -15):
            unpack = zlib.decompressobj(wbits)
            try:
                plain = unpack.decompress(body, most + 1)
            except zlib.error:
                continue
            if len(plain) > most:
                raise ValueError("too_long")
            if unpack.eof:
                body = plain
                break
        else:
            raise ValueError("bad_data")
    return body


def bodies(captured: DataFrame, most: int = 64 << 20) -> DataFrame:
    """captured(..., body, transfer, encoding) with ``plain`` and ``error``: bodies as they were before both kinds of encoding."""

    @F.pandas_udf(StructType([StructField("plain", BinaryType()), StructField("error", StringType())]))
    def opened(body: pd.Series, transfer: pd.Series, encoding: pd.Series) -> pd.DataFrame:
        out = []
        for b, t, e in zip(body, transfer, encoding):
            try:
                raw = b"" if b is None else bytes(b)
                raw = unchunked(raw) if isinstance(t, str) and t.lower().strip().endswith("chunked") else raw
                out.append((inflated(raw, e if isinstance(e, str) else "", most), None))
            except ValueError as why:
                out.append((None, str(why)))
        return pd.DataFrame(out, columns=["plain", "error"])

    return captured.withColumn("_o", F.explode(F.array(opened("body", "transfer", "encoding")))).select("*", "_o.plain", "_o.error").drop("_o")
