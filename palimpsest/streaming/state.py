"""Keyed stream operators: bounded retention of text, token buckets, usage totals."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def retain(stream: DataFrame, pattern: str, window: int = 64, mark: str = "[X]") -> DataFrame:
    """stream(stream_id, seq, delta, is_final): masks values of up to ``window`` characters that chunks cut apart.

    Each stream keeps its last ``window`` characters; nothing is given out before it has passed the window or the final
    chunk has come. State is bounded by the window for each open stream, and goes with the final chunk.
    """
    rx = re.compile(pattern)

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        held = state.get[0] if state.exists else ""
        rows, final = [], False
        for pdf in chunks:
            rows += list(zip(pdf["seq"], pdf["delta"].fillna(""), pdf["is_final"]))
        out = []
        for seq, delta, last in sorted(rows):
            held = rx.sub(mark, held + delta)
            ready = len(held) if last else max(0, len(held) - window)
            out.append((key[0], int(seq), held[:ready]))
            held, final = held[ready:], final or bool(last)
        if final:
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return stream.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def join_masked(tail: str, fragment: str, rx: re.Pattern, mark: str, window: int) -> str:
    """The fragment without what it completes of a value that began in the tail, which has been given out already."""
    head, probe = tail[-window:], tail[-window:] + fragment[:window]
    reach = max((m.end() for m in rx.finditer(probe) if m.start() < len(head) < m.end()), default=-1)
    return fragment if reach < 0 else mark + fragment[reach - len(head) :]


def sibling_paths(stream: DataFrame, pattern: str, window: int = 64, max_paths: int = 64, mark: str = "[X]") -> DataFrame:
    """stream(stream_id, seq, path, fragment, is_final): masks values that later fragments of one path complete.

    Nothing is held back: of a value cut apart, the part that completes it is masked. Values inside one fragment are
    the scan of single events' concern. State: the last ``window`` characters of each of the ``max_paths`` paths seen
    last; ``evictions`` counts the paths forgotten so far. An empty or null fragment changes no memory.
    """
    rx = re.compile(pattern)

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        tails, evicted = json.loads(state.get[0]) if state.exists else ({}, 0)
        rows, out, final = [], [], False
        for pdf in chunks:
            rows += list(zip(pdf["seq"], pdf["path"].fillna(""), pdf["fragment"].fillna(""), pdf["is_final"].fillna(False)))
        for seq, path, fragment, last in sorted(rows, key=lambda r: r[0]):
            if fragment:
                tail = tails.pop(path, "")
                fragment = join_masked(tail, fragment, rx, mark, window)
                tails[path] = (tail + fragment)[-window:]
                if len(tails) > max_paths:
                    del tails[next(iter(tails))]
                    evicted += 1
            out.append((key[0], int(seq), path, fragment, evicted))
            final = final or bool(last)
        if final:
            state.remove()
        else:
            state.update((json.dumps([tails, evicted]),))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "path", "text", "evictions"])

    return stream.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, path string, text string, evictions long", "held string", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, key: str, ts: str, rate: float, burst: float, cost: str | None = None) -> DataFrame:
    """Batch: (key, event_id, allowed) of a bucket refilled by ``rate`` a second up to ``burst``; an event takes one token or
    its cost. The clamp makes each key a fold over its events in order; keys are independent."""
    item = F.struct(F.col(ts).cast("double").alias("t"), "event_id", (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("cost"))
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<event_id:bigint,allowed:boolean>>").alias("out"))

    def step(acc, e):
        full = F.least(F.lit(float(burst)), acc["tokens"] + F.coalesce(e["t"] - acc["last"], F.lit(0.0)) * rate)
        ok = full >= e["cost"]
        return F.struct(F.when(ok, full - e["cost"]).otherwise(full).alias("tokens"), e["t"].alias("last"), F.concat(acc["out"], F.array(F.struct(e["event_id"].alias("event_id"), ok.alias("allowed")))).alias("out"))

    folded = events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("e"))
    return folded.select(key, F.inline(F.aggregate("e", start, step, lambda a: a["out"])))


def usage(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming or batch: requests and value of each user and event type in each window of event time."""
    marked = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    return marked.groupBy(F.window("ts", width).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
