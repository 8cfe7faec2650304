"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of whole documents, as numbers of its words with a break
after each document. Its suffix array gives the Burrows-Wheeler transform, kept
as a wavelet matrix of bit vectors with counted ranks; all windows of the
benchmark whose words the shard has are searched backwards at once through
these ranks; occurrences are located by walking to sampled suffix positions;
and the spans they cover are merged.

The benchmark is read in blocks of bounded size. If it is no more than one
block, that is broadcast and one pass does all. Otherwise each block is
broadcast by itself, its finds are written to the shared folder, and the block
is let go before the next is read; a last pass merges what was found. Words are
compared by 64-bit hashes.

Cases: null, empty and wordless documents have no words and no hits; such
items have no windows. An item shorter than a window is one window by itself.
Items of one id are one item; the windows of an item without id hit, but it is
neither counted nor named. Each row of the documents has its row of the result.
Overlapping occurrences merge. Input columns with the names of added ones are
replaced by them (``names`` gives others). Empty tables: no hits, or no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import ALNUM_OR_HIGH, blocks

SHARD_BYTES = 4_000_000
BENCHMARK_BLOCK_BYTES = 4_000_000
SAMPLE = 16


class BitVector:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 - len(packed) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))

    def rank(self, position: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = position >> 6
        below = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, position: np.ndarray) -> np.ndarray:
        return (self.words[position >> 6] >> (position & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many (symbol, position) at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            self.ones.append(BitVector(bit))
            self.zeros.append(len(seq) - int(np.count_nonzero(bit)))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        begin, end = np.zeros_like(position), position
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k].rank(begin), self.ones[k].rank(end)
            begin = np.where(one, self.zeros[k] + a, begin - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling over what is tied still. Each 0 is a break, smaller than all words and different from every other; the last symbol is one."""
    breaks = np.flatnonzero(seq == 0)
    symbol = seq.astype(np.int64) + len(breaks)
    symbol[breaks] = np.arange(len(breaks))
    order = np.argsort(symbol, kind="stable")

    def firsts(new: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each element the place of the first one of its group."""
        return np.maximum.accumulate(np.where(new, at, 0))

    sorted_ = symbol[order]
    rank = np.empty(len(seq), np.int64)
    rank[order] = firsts(np.concatenate(([True], sorted_[1:] != sorted_[:-1])), np.arange(len(seq)))
    k = 1
    while True:
        own = rank[order]
        alone = np.concatenate(([True], own[1:] != own[:-1]))
        tied = np.flatnonzero(~(alone & np.concatenate((alone[1:], [True]))))
        if not len(tied):
            return order
        while len(tied):  # ties hold no break, so k symbols on there is a suffix still
            group, after = rank[order[tied]], rank[order[tied] + k]
            by = np.lexsort((after, group))
            order[tied] = order[tied][by]
            group, after = group[by], after[by]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
            rank[order[tied]] = firsts(new, tied)
            tied = tied[~(new & np.concatenate((new[1:], [True])))]
            k *= 2


class FMIndex:
    """Over word numbers in which 0 is a break; the sequence must end with a break."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1].astype(np.int32)  # sa 0 gives the last symbol, a break
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols + 1))))
        kept = np.zeros(len(seq), bool)
        kept[::sample] = True
        kept[np.flatnonzero(seq == 0) + 1 - len(seq)] = True  # so that no walk crosses a break
        sampled = kept[sa]
        self.sampled, self.positions = BitVector(sampled), sa[sampled].astype(np.int32)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (one a row, all of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live], high[live] = self._step(c, low[live]), self._step(c, high[live])
            live = live[high[live] > low[live]]
        high[high < low] = low[high < low]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.full(len(rows), -1, np.int64)
        at, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            done = self.sampled.get(row)
            out[at[done]] = self.positions[self.sampled.rank(row[done])] + steps
            at, row = at[~done], row[~done]
            row = self._step(self.bwt[row].astype(np.int64), row)
            steps += 1
        return out


@dataclass
class Windows:
    """The windows of some benchmark items. items: their ids; by_length: distinct windows of word hashes, and (window, item) pairs in order."""

    items: list[str | None]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list, texts: list[str | None], size: int) -> "Windows":
        own: list[np.ndarray] = []
        for block in blocks(pa.array(texts, pa.large_string())):
            low = block.lowered()
            s, e = low.spans(ALNUM_OR_HIGH)
            h, first = low.hashes(s, e), low.first_of_row(s)
            own += [h[a:b] for a, b in zip(first[:-1], first[1:])]
        found: dict[int, list] = {}
        for k, h in enumerate(own):
            if len(h):
                m = min(size, len(h))
                w = np.lib.stride_tricks.sliding_window_view(h, m)
                found.setdefault(m, []).append((w, np.full(len(w), k)))
        by_length = {}
        for m, parts in found.items():
            w, which = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.reshape(-1), np.concatenate([p[1] for p in parts])), 1), axis=0)
            by_length[m] = (w, pairs)
        return Windows([None if i is None else str(i) for i in ids], by_length)

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In a shard of words with first[i] the first word of row i: (word position, length, window number within its length) arrays."""
        n, rows = len(hashes), len(first) - 1
        none = np.zeros(0, np.int64)
        if not n:
            return none, none, none
        words, number = np.unique(hashes, return_inverse=True)
        wanted = []
        for m, (windows, _) in self.by_length.items():
            i = np.searchsorted(words, windows)
            i[i == len(words)] = 0
            there = np.flatnonzero((words[i] == windows).all(1))
            if len(there):
                wanted.append((m, there, i[there] + 1))
        if not wanted:
            return none, none, none
        seq = np.insert(number.astype(np.int64) + 1, first[1:], 0)
        row = np.repeat(np.arange(rows), np.diff(first) + 1)
        index = FMIndex(seq, len(words))
        pos, length, window = [none], [none], [none]
        for m, there, patterns in wanted:
            low, high = index.search(patterns)
            count = high - low
            found = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            at = index.locate(found)
            pos.append(at - row[at])  # without the breaks
            length.append(np.full(len(at), m))
            window.append(np.repeat(there, count))
        return np.concatenate(pos), np.concatenate(length), np.concatenate(window)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie inside an occurrence, and the ids of the items found in each row that has some."""
        pos, length, window = self.occurrences(hashes, first)
        hit = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + length, -1)
        row = np.searchsorted(first[1:], pos, side="right")
        items: dict[int, set[str]] = {}
        for m, (_, pairs) in self.by_length.items():
            own = length == m
            seen = np.unique(np.stack((row[own], window[own]), 1), axis=0)
            a, b = np.searchsorted(pairs[:, 0], seen[:, 1]), np.searchsorted(pairs[:, 0], seen[:, 1], side="right")
            for r, x, y in zip(seen[:, 0].tolist(), a.tolist(), b.tolist()):
                items.setdefault(r, set()).update(self.items[k] for k in pairs[x:y, 1].tolist() if self.items[k] is not None)
        return np.cumsum(hit[:-1]) > 0, items


def read_benchmark(benchmark: DataFrame, size: int, block_bytes: int):
    """Windows of the benchmark, block by block, each of at most ``block_bytes`` of item texts (one item at least)."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        more = len((row["text"] or "").encode())
        if texts and held + more > block_bytes:
            yield Windows.of(ids, texts, size)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += more
    yield Windows.of(ids, texts, size)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("removal_spans", SPANS), ("clean_text", T.StringType())]
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _shards(column):
    """(block, starts, ends, first, hashes) of the words of each shard of a text column."""
    for block in blocks(column, SHARD_BYTES):
        low = block.lowered()
        starts, ends = low.spans(ALNUM_OR_HIGH)
        yield block, starts, ends, low.first_of_row(starts), low.hashes(starts, ends)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _described(block, starts, ends, first, inside, items, column: pa.Array) -> list[pa.Array]:
    """The columns FOUND of a shard."""
    total = np.concatenate(([0], np.cumsum(inside)))
    n_hit = (total[first[1:]] - total[first[:-1]]).astype(np.int64)
    spans: list = [[]] * block.rows
    clean = column.cast(pa.string())
    if n_hit.any():
        clean = column.to_pylist()
        for r in np.flatnonzero(n_hit).tolist():
            a = first[r]
            at = [(int(starts[a + x] - block.offsets[r]), int(ends[a + y - 1] - block.offsets[r])) for x, y in zip(*_runs(inside[a : first[r + 1]]))]
            spans[r] = [{"start": x, "end": y} for x, y in at]
            raw, left, parts = clean[r].encode(), 0, []
            for x, y in at:
                parts.append(raw[left:x])
                left = y
            clean[r] = b"".join([*parts, raw[left:]]).decode()
        clean = pa.array(clean, pa.string())
    digests = [hashlib.sha256(",".join(sorted(items[r])).encode()).hexdigest() if r in items else _EMPTY for r in range(block.rows)]
    return [pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit), pa.array([len(items.get(r, ())) for r in range(block.rows)], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0), pa.array(spans, _SPAN_TYPE), clean]


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, names: dict | None = None, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """docs' columns and FOUND (under other names by ``names``): removal_spans are merged byte spans of the text, clean_text the text without them."""
    sc = docs.sparkSession.sparkContext
    added = [(names or {}).get(n, n) for n, _ in FOUND]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in added}]
    docs = docs.select(*kept)
    text_at = kept.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, (_, t) in zip(added, FOUND))])
    parts = read_benchmark(benchmark, size, block_bytes)
    windows, more = next(parts), next(parts, None)
    if more is None:
        sent = sc.broadcast(windows)

        def run(batches):
            for batch in batches:
                for block, starts, ends, first, hashes in _shards(batch.column(text_at)):
                    part = batch.slice(block.first, block.rows)
                    yield pa.RecordBatch.from_arrays([*part.columns, *_described(block, starts, ends, first, *sent.value.find(hashes, first), part.column(text_at))], names=[*kept, *added])

        return docs.mapInArrow(run, schema)
    row = shared.unused("row", docs)
    docs = shared.keep(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    hits = None
    for windows in itertools.chain((windows, more), parts):
        sent = sc.broadcast(windows)
        made = shared.keep(docs.select(row, "text").mapInArrow(_hits(sent), "row long, starts array<long>, ends array<long>, items array<string>"), "decontaminate-hits")
        sent.destroy()
        hits = made if hits is None else hits.unionByName(made)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    merged = hits.groupBy("row").agg(flat("starts"), flat("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = docs.join(merged.select(F.col("row").alias(row), F.struct("starts", "ends", "items").alias(row + "hits")), row, "left").select(*kept, row + "hits")

    def finish(batches):
        for batch in batches:
            for block, starts, ends, first, hashes in _shards(batch.column(text_at)):
                part = batch.slice(block.first, block.rows)
                hit, items = np.zeros(len(hashes) + 1, np.int64), {}
                for r, found in enumerate(part.column(len(kept)).to_pylist()):
                    if found:
                        np.add.at(hit, first[r] + np.array(found["starts"]), 1)
                        np.add.at(hit, first[r] + np.array(found["ends"]), -1)
                        items[r] = set(found["items"])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *_described(block, starts, ends, first, np.cumsum(hit[:-1]) > 0, items, part.column(text_at))], names=[*kept, *added])

    return joined.mapInArrow(finish, schema)


def _hits(sent):
    """Rows (row, text) to (row, starts, ends, items) of those with hits, in words of the row."""

    def run(batches):
        for batch in batches:
            for block, _, _, first, hashes in _shards(batch.column(1)):
                inside, items = sent.value.find(hashes, first)
                rows, starts, ends = [], [], []
                for r in np.unique(np.searchsorted(first[1:], np.flatnonzero(inside), side="right")).tolist():
                    a, b = _runs(inside[first[r] : first[r + 1]])
                    rows.append(r)
                    starts.append(a)
                    ends.append(b)
                ids = batch.column(0).slice(block.first, block.rows).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string()))], names=["row", "starts", "ends", "items"])

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, shared.table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts; a document of which no word is left goes."""
    shared.prepare(spark)
    own = {n: shared.unused("found_" + n, docs) for n, _ in FOUND}
    found = find(docs, shared.table(spark, sf_dir, "benchmark"), names=own)
    hit = F.col(own["contaminated"])
    left = found.where(~hit | (F.col(own["n_hit"]) < F.col(own["n_words"])))
    new = {"text": F.when(hit, F.col(own["clean_text"])).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(own["clean_text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
