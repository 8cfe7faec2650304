"""Token counts by byte-pair merging with a heap and a linked list.

The count of a text is its number of initial symbols minus its number of
merges; no identifiers are made. Two neighbours that stand side by side in no
vocabulary piece (checked when the model is read; a letter and the space after
it, say) are never merged: texts are cut between them, and a bounded cache
keeps the counts of the distinct cuttings, which repeat a lot.

Cases: null and empty texts have no tokens. Characters that the vocabulary
lacks count one symbol for each UTF-8 byte. Repeated rows are counted each.
Long texts without spaces are merged whole, in n log n steps.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import Block, SpanCache, blocks, segment_sums

SPACE_MARK = "▁"
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def proto_fields(data: bytes):
    """(field number, value) of a serialised protocol buffer message, one level."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_pieces(path: str) -> dict[str, float]:
    """Piece to score of a sentencepiece BPE model: the pieces that text can give."""
    out = {}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in proto_fields(data):
        if number == 1:
            piece = dict(proto_fields(value))
            if piece.get(3, NORMAL) in (NORMAL, USER_DEFINED, UNUSED):
                out[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
    return out


class Merger:
    """ranks: piece to rank, the lowest merges first; equal ranks merge from the left."""

    def __init__(self, scores: dict[str, float]):
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items()}
        #: Whether two bytes stand side by side in any piece, the space mark written as a space.
        self.beside = np.zeros((256, 256), bool)
        for p in scores:
            b = np.frombuffer(p.replace(SPACE_MARK, " ").encode(), np.uint8)
            self.beside[b[:-1], b[1:]] = True
        self.beside[:, 0x80:0xC0] = True  # inside a character
        self.beside[:, 0xE2] = self.beside[0x81, :] = True  # a literal space mark is a space

    def count(self, text: str) -> int:
        """Tokens of one cutting, in which spaces are written as the space mark."""
        ranks = self.ranks
        n = len(text)
        if text in ranks and n == 1:
            return 1
        total = n
        for ch in text:
            if ch not in ranks:
                total += len(ch.encode("utf-8", "surrogatepass")) - 1
        heap = []
        for i in range(n - 1):
            r = ranks.get(text[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        if not heap:
            return total
        heapq.heapify(heap)
        end = list(range(1, n + 1))  # end[i]: where the symbol that begins at i ends; 0: merged away
        back = list(range(-1, n - 1))  # where the symbol before begins
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, to = pop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue  # one of the two symbols has changed since
            end[i], end[j] = to, 0
            total -= 1
            if to < n:
                back[to] = i
                r = ranks.get(text[i : end[to]])
                if r is not None:
                    push(heap, (r, i, end[to]))
            k = back[i]
            if k >= 0:
                r = ranks.get(text[k:to])
                if r is not None:
                    push(heap, (r, k, to))
        return total


class Counter:
    """Counts the tokens of blocks; holds the cache of one Python worker."""

    def __init__(self, path: str):
        self.merger = Merger(read_pieces(path))
        self.cache = SpanCache(self._count_spans)

    def _count_spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        count = self.merger.count
        return np.ones(len(spans), np.int64), np.fromiter((count(s.decode().replace(" ", SPACE_MARK)) for s in spans), np.int32, len(spans))

    def counts(self, block: Block) -> np.ndarray:
        """Tokens of each row."""
        n = np.diff(block.offsets)
        full = n > 0
        # The model puts one space before every text that is not empty.
        data = np.insert(block.data, block.offsets[:-1][full], 0x20)
        offsets = np.concatenate(([0], np.cumsum(n + full)))
        marked = Block(data, offsets, block.first, block.nulls)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.merger.beside[data[:-1], data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        if len(at) < 2:
            return np.zeros(block.rows, np.int64)
        begin, _, values = self.cache.look_up(data, at)
        return segment_sums(values[begin].astype(np.int64), marked.first_of_row(at[:-1]))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to the columns of docs, which must hold ``text``; no shuffle."""
    added = ("n_bytes", "n_tokens", "over_limit")
    names = [c for c in docs.columns if c.lower() not in added]
    docs = docs.select(*names)
    text_at = names.index("text")

    def run(batches):
        c = counter(model_path)
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                n = c.counts(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(block.offsets)), pa.array(n), pa.array(n > limit)], names=[*names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))


def op8_tokencount(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
