"""Replies restored and masked while they stream, whatever the chunks.

A reply comes as events (stream_id, seq, choice, channel, tool, delta, final).
Each channel of a choice (its reasoning, its content, the arguments of each tool
call) is a text of its own with a window of its own. What leaves a window is
decided for good, so the pieces put together are the same for every way to cut
the text:

* Masking holds the last ``window`` characters at least. The cut is moved forward to a word's end inside the next ``window``
  characters, then back to the start of a value it would divide. Values of up to ``window`` characters are masked whole, longer
  ones piece by piece; the session's own tokens are left alone.
* Restoring walks a trie of the vault's tokens from left to right, the longest
  token first, at word boundaries only. It stops where the text may still grow
  into a token, or a token into a longer word.
* A canary stops the stream before any of it is given out.

A choice's windows are drained when it is final: reasoning, content, then tools
by index; all windows when an event without a choice is final, in order of the
choices. A stream fails closed, with an error row and nothing after it, when it
opens more than ``max_windows`` windows at a time, when a window or what is
restored from one delta passes ``max_length`` characters, or on the canary.

``stream_replies`` keeps the windows and the vault as map states of a stream
with a timer for streams that stop without an end; ``batch_replies`` walks the
sorted events of each partition with the windows of one stream in hand. Cases:
null deltas are empty; a null stream_id is a stream; events of one seq come in
order of their channel; without a final event, a batch drains all windows at the
stream's end; a null token, or an empty one, restores nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions import patterns as P

EVENT = "stream_id string, seq long, choice int, channel string, tool int, delta string, final boolean"
OUT = "stream_id string, seq long, part int, choice int, channel string, tool int, text string, error string"
#: The order in which the windows of a choice are drained.
DRAINED = {"reasoning": 0, "content": 1, "tool": 2}
# Scripts without spaces between words.
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x2A6DF))


class Closed(Exception):
    """The stream ends here; the message is the error of its row."""


def is_word(char: str) -> bool:
    """Whether a character is part of a word that boundaries enclose."""
    c = unicodedata.normalize("NFKC", char)[:1]
    return bool(c) and (c.isalnum() or c == "_") and not any(a <= ord(c) <= b for a, b in UNSPACED)


class Trie:
    """The vault's tokens by their characters. A node's value under "" is what its token stands for."""

    def __init__(self, vault: dict[str, str], canary: str = ""):
        self.root: dict = {}
        for token, original in vault.items():
            if token and original is not None:
                node = self.root
                for c in token:
                    node = node.setdefault(c, {})
                node[""] = original
        self.canary = canary
        firsts = {*self.root, *canary[:1]}
        self.starts = regex.compile("[" + "".join(regex.escape(c) for c in sorted(firsts)) + "]") if firsts else None

    def restore(self, text: str, before: str, last: bool) -> tuple[str, int]:
        """The restored text of a decided beginning, and how many characters that is. ``before``: the character in front."""
        out, at, taken = [], 0, 0
        while self.starts and (found := self.starts.search(text, at)):
            at = found.start()
            rest = text[at : at + len(self.canary)]
            if self.canary and self.canary.startswith(rest):
                if rest == self.canary:
                    raise Closed("canary")
                if not last:
                    break
            token = self._at(text, at, text[at - 1] if at else before, last)
            if token is None:
                break
            end, original = token
            if end == at:
                at += 1
            else:
                out += [text[taken:at], original]
                at = taken = end
        else:
            at = len(text)
        return "".join(out) + text[taken:at], at

    def _at(self, text: str, at: int, before: str, last: bool) -> tuple[int, str] | None:
        """(end, original) of the longest token that begins here, (at, "") of none, None while that is open."""
        if is_word(text[at]) and before and is_word(before):
            return at, ""
        node, end, ends = self.root, at, []
        while end < len(text) and text[end] in node:
            node = node[text[end]]
            end += 1
            if "" in node:
                ends.append((end, node[""]))
        if end == len(text) and not last and len(node) > ("" in node):
            return None
        for stop, original in reversed(ends):
            if not is_word(text[stop - 1]) or stop < len(text) and not is_word(text[stop]):
                return stop, original
            if stop == len(text):
                return (stop, original) if last else None
        return at, ""


@dataclass
class Scanner:
    """Patterns of values in text, by priority."""

    rules: tuple[tuple[str, str], ...] = P.BUILT_IN
    compiled: list = field(init=False)

    def __post_init__(self):
        self.compiled = [(name, regex.compile(p)) for name, p in self.rules]

    def spans(self, text: str, start: int) -> list[tuple[int, int, str]]:
        """Disjoint values from a place on, what stands before it being seen by the patterns: by start, the longer, the priority."""
        found = sorted((m.start(), -m.end(), k) for k, (_, rx) in enumerate(self.compiled) for m in rx.finditer(text, start))
        out, reach = [], start
        for a, b, k in found:
            if a >= reach:
                out.append((a, -b, self.compiled[k][0]))
                reach = -b
        return out

    def mask(self, text: str, before: str, window: int, known, last: bool) -> tuple[str, int]:
        """The masked text of a decided beginning, and how many characters that is."""
        cut = len(text) if last else max(0, len(text) - window)
        spans = []
        if cut:
            whole = before + text
            spans = [(a - len(before), b - len(before), name) for a, b, name in self.spans(whole, len(before))]
            if not last:
                low = max(0, len(text) - 2 * window)
                # Just after a word, if one ends there.
                cut = next((i for i in range(low + 1, cut + 1) if text[i].isspace() and not text[i - 1].isspace()), cut)
                floor = max(0, len(text) - 3 * window)  # a match that goes on growing cannot hold the stream back
                cut = min([cut, *(a for a, b, _ in spans if floor <= a < cut < b)])
        out, at = [], 0
        for a, b, name in spans:
            if a < cut and text[a:b] not in known:
                out += [text[at:a], f"[{name}_REDACTED]"]
                at = min(b, cut)
        return "".join(out) + text[at:cut], cut


@dataclass
class Rules:
    """window: characters held for masking, 0 to mask nothing. Lengths are in characters."""

    window: int = 0
    canary: str = ""
    max_windows: int = 256
    max_length: int = 64 * 1024
    patterns: tuple[tuple[str, str], ...] = P.BUILT_IN


class Reply:
    """The windows of one stream: (pending, its character before, held, its character before) by (choice, channel, tool)."""

    def __init__(self, rules: Rules, scanner: Scanner | None, vault: dict[str, str], windows: dict | None = None):
        self.rules, self.scanner, self.vault, self.windows = rules, scanner, vault, windows if windows is not None else {}
        self.trie = Trie(vault, rules.canary)

    def learn(self, token: str, original: str) -> None:
        self.vault[token] = original
        self.trie = Trie(self.vault, self.rules.canary)

    def push(self, key: tuple, delta: str, last: bool = False) -> str:
        """What a window gives out once delta is appended."""
        if key not in self.windows and len(self.windows) >= self.rules.max_windows:
            raise Closed("windows")
        pending, seen, held, left = self.windows.get(key, ("", "", "", ""))
        pending += delta
        if self.scanner:
            ready, n = self.scanner.mask(pending, seen, self.rules.window, self.vault, last)
            pending, seen = pending[n:], pending[n - 1] if n else seen
        else:
            ready, pending = pending, ""
        held += ready
        text, n = self.trie.restore(held, left, last)
        held, left = held[n:], held[n - 1] if n else left
        if max(len(pending) + len(held), len(text)) > self.rules.max_length:
            raise Closed("length")
        if last:
            self.windows.pop(key, None)
        else:
            self.windows[key] = (pending, seen, held, left)
        return text

    def drain(self, choice: int | None) -> Iterator[tuple[tuple, str]]:
        """(window, text) of a choice's windows, or of all, emptied in their order."""
        of = [k for k in self.windows if choice is None or k[0] == choice]
        for key in sorted(of, key=lambda k: (k[0], DRAINED.get(k[1], len(DRAINED)), k[1], k[2])):
            text = self.push(key, "", last=True)
            if text:
                yield key, text

    def event(self, seq: int, choice, channel, tool, delta: str, final: bool) -> Iterator[tuple]:
        """Rows (seq, part, choice, channel, tool, text, error) that an event gives out."""
        part = 0
        missing = lambda v: v is None or v != v
        number = lambda v: -1 if missing(v) else int(v)
        try:
            if delta and not missing(choice):
                key = (int(choice), "content" if missing(channel) else channel, number(tool))
                text = self.push(key, delta)
                if text:
                    yield seq, part, *self.named(key), text, None
                    part += 1
            if final:
                for key, text in self.drain(None if missing(choice) else int(choice)):
                    yield seq, part, *self.named(key), text, None
                    part += 1
        except Closed as why:
            self.windows.clear()
            yield seq, part, None, None, None, None, str(why)
            raise

    @staticmethod
    def named(key: tuple) -> tuple:
        return key[0], key[1], None if key[2] < 0 else key[2]


def _sorted_events(pdf: pd.DataFrame) -> Iterator[tuple]:
    rows = pdf[["seq", "choice", "channel", "tool", "delta", "final"]].itertuples(index=False, name=None)
    for seq, choice, channel, tool, delta, final in sorted(rows, key=lambda r: r[0]):
        yield int(seq), choice, channel, tool, delta if isinstance(delta, str) else "", final is not None and final == final and bool(final)


class Replies(StatefulProcessor):
    """The state of each stream: its windows, its vault, and why it was closed."""

    def __init__(self, rules: Rules, idle_ms: int):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "choice int, channel string, tool int", "pending string, seen string, held string, before string")
        self.vault = handle.getMapState("vault", "token string", "original string")
        self.closed = handle.getValueState("closed", "error string")
        self.scanner = Scanner(self.rules.patterns) if self.rules.window else None

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        for token, original in initialState[["token", "original"]].itertuples(index=False, name=None):
            self.vault.updateValue((token,), (original,))

    def _reply(self) -> Reply:
        held = {tuple(k): tuple(v) for k, v in self.windows.iterator()}
        return Reply(self.rules, self.scanner, {k[0]: v[0] for k, v in self.vault.iterator()}, held)

    def _save(self, before: set, reply: Reply) -> None:
        for key in before - set(reply.windows):
            self.windows.removeKey(key)
        for key, value in reply.windows.items():
            self.windows.updateValue(key, value)

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["stream_id", "seq", "part", "choice", "channel", "tool", "text", "error"]).astype({"choice": "Int32", "tool": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        batch = pd.concat(list(rows), ignore_index=True)
        if self.closed.exists():
            return
        reply, out = self._reply(), []
        before = set(reply.windows)
        try:
            for event in _sorted_events(batch):
                out_of = reply.event(*event)
                for row in out_of:
                    out.append(row)
        except Closed as why:
            self.closed.update((str(why),))
        self._save(before, reply)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if reply.windows:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        reply = self._reply()
        before = set(reply.windows)
        rows = [r for r in reply.event(-1, None, None, None, "", True)]
        self._save(before, reply)
        if rows:
            yield self._out(key, rows)

    def close(self) -> None:
        pass


def stream_replies(events: DataFrame, vault: DataFrame, rules: Rules = Rules(), idle_ms: int = 600_000) -> DataFrame:
    """A stream of EVENT rows to OUT rows. vault(stream_id, token, original), a table, is each stream's state from its start on.

    Needs the RocksDB state store. Rows that a timer drains have seq -1.
    """
    grouped = vault.select(F.col("stream_id"), "token", "original").groupBy("stream_id")
    return events.groupBy("stream_id").transformWithStateInPandas(Replies(rules, idle_ms), OUT, "Append", "ProcessingTime", grouped)


def batch_replies(events: DataFrame, vault: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over tables: a partition's streams one after another, each with its vault first; nothing but one stream's windows and vault is held."""
    v = vault.where("token is not null").select("stream_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("choice"), F.col("token").alias("channel"), F.lit(None).cast("int").alias("tool"), F.col("original").alias("delta"), F.lit(False).alias("final"))
    rows = v.withColumn("kind", F.lit(0)).unionByName(events.select("stream_id", "seq", "choice", "channel", "tool", "delta", "final").withColumn("kind", F.lit(1)))
    rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "kind", "seq", "choice", "channel", "tool")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules.patterns) if rules.window else None
        name, reply, seen, dead, tokens = object(), None, 0, False, {}

        def rows_of(call: Callable) -> list[tuple]:
            nonlocal dead
            out = []
            try:
                for row in call():
                    out.append((name, *row))
            except Closed:
                dead = True
            return out

        for pdf in batches:
            out = []
            columns = pdf[["stream_id", "kind", "seq", "choice", "channel", "tool", "delta", "final"]]
            for stream, kind, seq, choice, channel, tool, delta, final in columns.itertuples(index=False, name=None):
                stream = stream if isinstance(stream, str) else None
                if stream != name:
                    if reply is not None and not dead:
                        out += rows_of(lambda: reply.event(seen, None, None, None, "", True))
                    name, reply, dead, tokens, seen = stream, None, False, {}, -1
                if kind == 0:
                    tokens[channel] = delta
                    continue
                reply = reply or Reply(rules, scanner, tokens)
                seen = seen if seq is None or seq != seq else int(seq)
                if not dead:
                    out += rows_of(lambda: reply.event(seen, choice, channel, tool, delta if isinstance(delta, str) else "", final is not None and final == final and bool(final)))
            if out:
                yield _frame(out)
        if reply is not None and not dead and (out := rows_of(lambda: reply.event(seen, None, None, None, "", True))):
            yield _frame(out)

    return rows.mapInPandas(run, OUT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "seq", "part", "choice", "channel", "tool", "text", "error"]).astype({"choice": "Int32", "tool": "Int32"})
