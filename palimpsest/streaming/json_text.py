"""JSON that arrives in chunks: which slices of it are values, whatever the cuts.

A resumable state machine reads each chunk once. Its state between chunks is a
mode, the open brackets and a count: bounded by ``max_depth``, not by the text.
A slice is (value, text): the number of the value it belongs to (string content
as written, escapes included, or a bare scalar), or -1 for keys, quotes,
brackets and white space. Slices put together are the text; the slices of one
number put together are the value. Inside an array every element is a value.
Text that is no JSON is read on by the same rules and raises nothing; brackets
nested deeper than ``max_depth`` end the lexing, and what follows is an ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLICES = "stream_id string, seq long, n int, value long, text string, error string"
BETWEEN, KEY, STRING, SCALAR = "between", "key", "string", "scalar"
_SPECIAL = re.compile(r'["{}\[\],:]|[^\s"{}\[\],:]')
_STRING_END = re.compile(r'["\\]')
_SCALAR_END = re.compile(r'[\s"{}\[\],:]')


class TooDeep(Exception):
    pass


@dataclass
class Lexer:
    """mode; brackets still open; whether a backslash waits for its character; whether a value follows; values begun so far."""

    mode: str = BETWEEN
    brackets: str = ""
    escaped: bool = False
    after_colon: bool = False
    values: int = 0
    max_depth: int = 256

    def feed(self, chunk: str) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        at, plain = 0, 0

        def emit(value: int, a: int, b: int) -> None:
            if a < b:
                out.append((value, chunk[a:b]))

        while at < len(chunk):
            if self.mode in (KEY, STRING):
                begin = at
                if self.escaped:
                    self.escaped, at = False, at + 1
                while (found := _STRING_END.search(chunk, at)) and found[0] == "\\":
                    at = found.end() + 1
                    if at > len(chunk):
                        self.escaped = True
                end = found.start() if found else len(chunk)
                if self.mode == STRING:
                    emit(-1, plain, begin)
                    emit(self.values - 1, begin, end)
                    plain = end
                at = end
                if found:
                    self.mode, at = BETWEEN, end + 1
            elif self.mode == SCALAR:
                found = _SCALAR_END.search(chunk, at)
                end = found.start() if found else len(chunk)
                emit(-1, plain, at)
                emit(self.values - 1, at, end)
                plain = at = end
                if found:
                    self.mode = BETWEEN
            else:
                found = _SPECIAL.search(chunk, at)
                if not found:
                    break
                self._between(found[0])
                at = found.start() if self.mode == SCALAR else found.end()
        emit(-1, plain, len(chunk))
        return out

    def _between(self, c: str) -> None:
        if c == ":":
            self.after_colon = True
        elif c == ",":
            self.after_colon = False
        elif c in "{[":
            if len(self.brackets) >= self.max_depth:
                raise TooDeep
            self.brackets, self.after_colon = self.brackets + c, False
        elif c in "}]":
            self.brackets, self.after_colon = self.brackets[:-1], False
        elif c == '"' and self.brackets.endswith("{") and not self.after_colon:
            self.mode = KEY
        else:
            self.mode, self.values = STRING if c == '"' else SCALAR, self.values + 1


def _rows(lexer: Lexer | None, stream, seq: int, delta) -> tuple[Lexer | None, list[tuple]]:
    """The lexer after a chunk, None once it has failed, and the rows of the chunk."""
    if lexer is None:
        return None, []
    try:
        return lexer, [(stream, seq, n, v, t, None) for n, (v, t) in enumerate(lexer.feed(delta if isinstance(delta, str) else ""))]
    except TooDeep:
        return None, [(stream, seq, 0, None, None, "too_deep")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "seq", "n", "value", "text", "error"]).astype({"value": "Int64"})


def _sorted(chunks: DataFrame, partitions: int | None) -> DataFrame:
    """Chunks of a stream together and in order, in a number of partitions, or as many as Spark takes."""
    rows = chunks.select("stream_id", "seq", "delta")
    return (rows.repartition(partitions, "stream_id") if partitions else rows.repartition("stream_id")).sortWithinPartitions("stream_id", "seq", "delta")


def batch_slices(chunks: DataFrame, max_depth: int = 256, partitions: int | None = None) -> DataFrame:
    """chunks(stream_id, seq, delta), a table, to rows of SLICES. Sorted chunks are walked with one lexer's state in hand.

    Chunks that were cut out of a grouped table lie in partitions that Spark sized before the cut; ``partitions`` keeps their number in
    proportion to the chunks (a table already in so many partitions by ``stream_id`` is not moved again).
    """
    rows = _sorted(chunks, partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, lexer = object(), None
        for pdf in batches:
            out = []
            for stream, seq, delta in pdf.itertuples(index=False, name=None):
                stream = stream if isinstance(stream, str) else None
                if stream != name:
                    name, lexer = stream, Lexer(max_depth=max_depth)
                lexer, new = _rows(lexer, stream, seq, delta)
                out += new
            yield _frame(out)

    return rows.mapInPandas(run, SLICES)


def batch_values(chunks: DataFrame, max_depth: int = 256, partitions: int | None = None) -> DataFrame:
    """values(batch_slices(chunks)), put together in the walk: one row leaves for each value, and at most one value is open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, lexer, number, text = object(), None, -1, []
        for pdf in batches:
            out = []
            for stream, seq, delta in pdf.itertuples(index=False, name=None):
                stream = stream if isinstance(stream, str) else None
                if stream != name:
                    if text:
                        out.append((name, number, "".join(text)))
                    name, lexer, number, text = stream, Lexer(max_depth=max_depth), -1, []
                lexer, new = _rows(lexer, stream, seq, delta)
                for _, _, _, value, piece, _ in new:
                    if value is None or value < 0:
                        continue
                    if value != number and text:
                        out.append((name, number, "".join(text)))
                        text = []
                    number = value
                    text.append(piece)
            yield pd.DataFrame(out, columns=["stream_id", "value", "text"])
        if text:
            yield pd.DataFrame([(name, number, "".join(text))], columns=["stream_id", "value", "text"])

    return _sorted(chunks, partitions).mapInPandas(run, "stream_id string, value long, text string")


def stream_slices(chunks: DataFrame, max_depth: int = 256) -> DataFrame:
    """The same over a stream of (stream_id, seq, delta, is_final); a stream's state goes with its final chunk."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lexer = Lexer(*state.get) if state.exists else Lexer(max_depth=max_depth)
        if lexer.max_depth < 0:  # it has failed
            return
        chunks_ = pd.concat(list(pdfs), ignore_index=True).sort_values("seq")
        out = []
        for seq, delta in chunks_[["seq", "delta"]].itertuples(index=False, name=None):
            lexer, new = _rows(lexer, key[0], seq, delta)
            out += new
        if chunks_["is_final"].fillna(False).any():
            state.remove()
        else:
            state.update(tuple(asdict(lexer or Lexer(max_depth=-1)).values()))
        yield _frame(out)

    return chunks.groupBy("stream_id").applyInPandasWithState(run, SLICES, "mode string, brackets string, escaped boolean, after_colon boolean, values int, max_depth int", "append", GroupStateTimeout.NoTimeout)


def values(slices: DataFrame) -> DataFrame:
    """(stream_id, value, text): the values of a table of slices, put together."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "n", "text")))
    return slices.where("value >= 0").groupBy("stream_id", "value").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
