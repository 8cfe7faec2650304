"""Sum-of-squares online packing of token sequences.

A level array counts the open windows at each fill level. Each remainder of a
document goes to the level, or to a new window, that leaves the sum of the
squared counts smallest (ties: to the fullest); whole windows of a long document
are windows of their own. A window that a remainder fills exactly is closed.

What is open when the input of a task ends stays as the level array placed it
and is filled up: documents may be cut, so the fullest window takes what it
lacks from the emptiest one, until one is left, which becomes sequences whose
lengths are powers of two. So no padding is left. The column ``placed`` tells
which windows the level array closed. However many windows are open, the level array goes on.

Every task packs its own rows, in one pass and without a shuffle; a sequence
never holds rows of two tasks, and its id is the task's number and a counter.

Cases: a null or empty text is its end token alone. Repeated rows, and rows
with equal or null doc_ids, are packed each for itself. An empty table gives
no pieces; other columns are ignored. Memory: one block of text (or the longest
text), its ids, and the open windows: ids of the task's own input, of two bytes each for a vocabulary below 65,536.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import Block, SpanCache, blocks, gathered

PIECE_COLUMNS = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("placed", T.StringType())]


#: Bytes of text that are looked up at once.
ENCODE_BYTES = 8_000_000


class ByteLevelIds:
    """Identifiers of texts by a byte-level BPE of the tokenizers library, from those of distinct cuttings.

    The library's pre-tokeniser begins a new token at a space before a character
    that is not white space, and between two neighbours of different classes
    among ASCII letters, ASCII digits and other ASCII characters that are not
    white space, unless the first is an apostrophe; what it does after such a
    place does not depend on what stands before. Texts are cut there, and the
    library encodes each distinct cutting. A text that may hold a special token
    (``<|``) is not cut.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel workers
        library = Tokenizer.from_file(json_path)
        self.encode = library.encode_batch_fast
        vocabulary = library.get_vocab()
        (space,) = library.encode(" ", add_special_tokens=False).tokens  # how the vocabulary writes a space
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.cache = SpanCache(self._encode_spans, limit=800_000)
        kind = np.zeros(256, np.uint8)  # 0: white space, control characters and all beyond ASCII
        kind[0x21:0x7F] = 3
        kind[0x30:0x3A] = 2
        kind[0x41:0x5B] = kind[0x61:0x7B] = 1
        self.kind = kind
        self.after_space = kind > 0  # a byte that surely begins no white space
        self.after_space[0xC3:0xE0] = True
        self.after_space[0xE4:0xF5] = True

    def _encode_spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A space and ASCII letters: such words are encoded as one text, in which the tokens that begin with a space begin a word.
        word = np.fromiter((s[0] == 0x20 and s[1:].isalpha() for s in spans), bool, len(spans))
        sizes, flat = np.zeros(len(spans), np.int64), np.zeros(0, np.int32)
        if word.any():
            text = b"".join(itertools.compress(spans, word)).decode()
            flat = np.array(self.encode([text], add_special_tokens=False)[0].ids, np.int32)
            sizes[word] = np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))
        got = [e.ids for e in self.encode([s.decode() for s in itertools.compress(spans, ~word)], add_special_tokens=False)]
        sizes[~word] = np.fromiter(map(len, got), np.int64, len(got))
        out, of_word = np.empty(int(sizes.sum()), np.int32), np.repeat(word, sizes)
        out[of_word] = flat
        out[~of_word] = np.fromiter(itertools.chain.from_iterable(got), np.int32, len(out) - len(flat))
        return sizes, out

    def ids(self, block: Block, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, an end id after each row, and the offsets of the rows."""
        d = block.data
        cut = np.zeros(len(d) + 1, bool)
        if len(d) > 2:
            kind = self.kind[d]
            a, b = kind[:-1], kind[1:]
            cut[1:-1] = (a != b) & (a > 0) & (b > 0) & (d[:-1] != 0x27)
            cut[1:-2] |= (d[1:-1] == 0x20) & self.after_space[d[2:]]
            for r in np.unique(block.row_of(np.flatnonzero((d[:-1] == 0x3C) & (d[1:] == 0x7C)))).tolist():
                cut[block.offsets[r] : block.offsets[r + 1]] = False
        cut[block.offsets] = True
        at = np.flatnonzero(cut)
        if len(at) > 1:
            begin, size, values = self.cache.look_up(d, at)
        else:
            begin, size, values = (np.zeros(0, np.int64),) * 3
        first = block.first_of_row(at[:-1])
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        lengths = np.diff(total[first]) + 1
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.full(int(offsets[-1]), end_id, np.uint32)
        if len(size):
            flat = np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))
            row = np.repeat(np.arange(block.rows), np.diff(total[first]))
            ids[np.arange(int(total[-1])) + row] = values[flat].astype(np.uint32)
        return ids, offsets


#: Of ``placed``: a window of one document, one that the level array closed, one that was open at the end.
WHOLE, LEVEL, END = "whole", "level", "end"


class Packer:
    """The windows of one task. Pieces are (document, start, ids, tokens of the document)."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.out: list[tuple] = []

    def _close(self, pieces: list, placed: str) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) & 0xFFFFFFFF, tokens, self.next, offset, placed))
            offset += len(ids)
        self.next += 1

    def level_for(self, rest: int) -> int:
        """The level of the window that a remainder goes to, 0 for a new one."""
        w, c = self.window, self.counts
        # Change of the sum of squares: a new window, or one at level h.
        grow = 2 * c[rest : w + 1] + 1  # what a window more at level h + rest adds
        grow[-1] = 0  # a full window is closed and not counted
        cost = np.where(c[: w - rest + 1] > 0, 1 - 2 * c[: w - rest + 1], np.int64(1) << 40) + grow
        cost[0] = grow[0]
        return len(cost) - 1 - int(cost[::-1].argmin())

    def add(self, doc: int, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        rest = n % w
        for start in range(0, n - rest, w):
            self._close([(doc, start, ids[start : start + w], n)], WHOLE)
        if not rest:
            return
        h = self.level_for(rest)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
        tail = ids[n - rest :]
        pieces.append((doc, n - rest, tail.astype(np.uint16 if tail.max() < 1 << 16 else np.uint32), n))
        if h + rest == w:
            self._close(pieces, LEVEL)
            return
        self.open[h + rest].append(pieces)
        self.counts[h + rest] += 1

    def fill_up(self) -> None:
        """Closes the open windows: the fullest one takes what it lacks from the emptiest. The last one is cut by powers of two."""
        waiting = [pieces for windows in reversed(self.open) for pieces in windows]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        end = len(waiting)
        for k in range(end):
            pieces = waiting[k]
            room = self.window - sum(len(p[2]) for p in pieces)
            while room and end > k + 1:
                donor = waiting[end - 1]
                doc, start, ids, tokens = donor.pop()
                if len(ids) > room:
                    donor.append((doc, start + room, ids[room:], tokens))
                    ids = ids[:room]
                pieces.append((doc, start, ids, tokens))
                room -= len(ids)
                if not donor:
                    end -= 1
            if k + 1 >= end:
                level = self.window - room
                if not room:
                    self._close(pieces, END)
                else:
                    self._powers_of_two(pieces, level)
                return
            self._close(pieces, END)

    def _powers_of_two(self, held: list, level: int) -> None:
        group, room = [], 1 << level.bit_length() - 1
        for doc, start, ids, tokens in held:
            while len(ids):
                take = min(len(ids), room)
                group.append((doc, start, ids[:take], tokens))
                start, ids, level, room = start + take, ids[take:], level - take, room - take
                if not room:
                    self._close(group, END)
                    group, room = [], 1 << level.bit_length() - 1 if level else 0


_IDS: dict[str, ByteLevelIds] = {}


def pack(docs: DataFrame, json_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id and PIECE_COLUMNS."""

    def run(batches):
        if json_path not in _IDS:
            _IDS[json_path] = ByteLevelIds(json_path)
        encoder = _IDS[json_path]
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        schema = None

        def emit():
            columns = list(zip(*packer.out)) if packer.out else [[] for _ in range(8)]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(x, pa.int64()) for x in columns[1:7]), pa.array(columns[7], pa.string())], names=["doc_id", *(n for n, _ in PIECE_COLUMNS)])

        for batch in gathered(batches, ENCODE_BYTES):
            schema = batch.schema.field(0).type
            for block in blocks(batch.column(1), ENCODE_BYTES):
                docs_ = batch.column(0).slice(block.first, block.rows).to_pylist()
                ids, offsets = encoder.ids(block, end_id)
                for doc, a, b in zip(docs_, offsets[:-1].tolist(), offsets[1:].tolist()):
                    packer.add(doc, ids[a:b])
                yield emit()
        if schema is not None:
            packer.fill_up()
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in PIECE_COLUMNS)]))


def _public(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return _public(shared.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of the documents."""
    shared.prepare(spark)
    return _public(docs)
