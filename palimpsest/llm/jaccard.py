"""Near-duplicate join by the Jaccard similarity of word n-gram sets.

A rule gives the words of a shingle and the least similarity t: op5 links
3-word sets from 90 per cent on, the pipeline's stage 5-word sets from 80. Every
pair of different sets that is at least so similar is linked, whatever the sizes
of groups:

1. Equal sets are one node. A node's size falls into a band. Two linked sets of
   sizes a <= b differ in at most (a + b)(1 - t) / (1 + t) shingles, and b <= a / t,
   so in at most a(1 - t) / t (a / 9 at 90 per cent, a / 4 at 80). At the band of
   the smaller, shingles are dealt by hash to so many parts that more parts than
   that are in use: one in use agrees. A tile is (band, part, content of the
   part): the nodes of a tile are the only candidates. Tiles of the same nodes
   are one tile.
2. Tiles are gone through in blocks of bounded size. Hashed bitmaps of the sets
   bound each overlap from above by their bit counts: bits that only one side
   has are shingles that the other lacks. Nodes with a partner that passes go on
   with their sets to the same block once more, where the sorted arrays are
   intersected exactly.

What leaves a block is never a row for each pair: ``join_near`` sums up how many
links each node has (a pair counts in the first tile that both share) and hands
on a spanning forest of the links it saw. ``near_components`` asks for the
components alone: hubs of tiles link most groups first, in rows as many as
nodes, and pairs whose nodes are joined already are passed over, so that its
work does not grow with the square of a group of linked texts.

Components are found by alternating large-star and small-star steps, on tables.

Shingles are 64-bit hashes of the words' 64-bit hashes. Cases: texts without
words (null, empty, blank) have no shingles and are linked with nothing; fewer
words than n are one shingle; repeated rows are copies, each with a row of the
result, linked with each other. A null doc_id is no name: a component is named
by its smallest doc_id that is not null, and by null if it has none. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import NOT_SPACE, Block, blocks, mix64
from palimpsest.llm.components import components

#: Each band's smallest size is at least so many times that of the one before.
BAND_RATIO = 1.4
#: Nodes of a tile that are compared in one block, on each side; fewer if their sets hold more than BLOCK_SHINGLES in all.
TILE_BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
#: Bits of a bitmap for each shingle, rounded up to a power of two; at least 64 bits.
BITS_PER_SHINGLE = 2
#: A bitmap has no more bits than this: it goes with every tile of its set, and a long text has many. The bound of a full
#: bitmap is weaker, and right.
MAX_BITS = 1 << 14
#: A node carries its so many smallest tiles to the bitmaps, to tell which tile is the first that a pair shares.
FIRST_TILES = 32
#: Nodes whose counts and links a task holds before it hands them on.
HELD_NODES = 200_000
#: Rows, of 48 bytes at most, up to which one side of a join is broadcast.
FEW = 500_000
#: Parts into which the partners of a hub are dealt.
HUB_SALTS = 256
#: Deals of a set that has too few parts in use; after the last one its empty parts are tiles too.
_DEALS = 8


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, the per cent of similarity from which sets are linked, and what follows from them."""

    words: int = 3
    percent: int = 90
    #: Smallest sizes of the bands; a linked smaller set is in the band of the larger one or the one below.
    bands: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        bands = [1, 9]
        while bands[-1] < 1 << 31:
            bands.append(int(np.ceil(bands[-1] * max(BAND_RATIO, 100 / self.percent))))
        object.__setattr__(self, "bands", np.array(bands))

    def differ(self, n: int) -> int:
        """Shingles that a set of n and a set linked with it can differ by."""
        return n * (100 - self.percent) // self.percent

    @lru_cache(maxsize=None)  # noqa: B019
    def parts_of(self, band: int) -> int:
        """Parts at a band: so many that of the largest sets nearly all have more parts in use than differ() allows to change."""
        n = int(self.bands[band + 1]) - 1
        m = self.differ(n) + 1
        while m > 1:
            load = n / m
            used, spread = m * -np.expm1(-load), np.sqrt(m * np.exp(-load) * (1 - (1 + load) * np.exp(-load)))
            if used - 3 * spread > self.differ(n):
                break
            m += 1 + m // 64
        return m

    def may_link(self, small, large):
        """Whether sizes allow a link."""
        return 100 * small >= self.percent * large

    def linked(self, common, a, b):
        """Whether sets of a and b shingles are linked, or can be where common is a bound from above."""
        return (100 + self.percent) * common >= self.percent * (a + b)


OP5 = Rule(3, 90)
STAGE = Rule(5, 80)


def shingles(block: Block, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows of a block: (row, hash), both ascending."""
    low = block.lowered()
    s, e = low.spans(NOT_SPACE)
    h, first = low.hashes(s, e), low.first_of_row(s)
    count = np.diff(first)
    row = np.repeat(np.arange(block.rows), count)
    place = np.arange(len(h)) - first[row]
    with np.errstate(over="ignore"):
        total = h.copy()
        for k in range(1, n):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total[: len(h) - k] += mix64(h[k:] + np.uint64(k))
        whole = count >= n
        at = np.flatnonzero(whole[row] & (place <= count[row] - n))
        values, rows = [mix64(total[at])], [row[at]]
        for size in range(1, n):  # short texts: all their words
            own = np.flatnonzero(count == size)
            if len(own):
                t = np.full(len(own), np.uint64(size))
                for k in range(size):
                    t = mix64(t * np.uint64(0x9E3779B97F4A7C15) + h[first[own] + k])
                values.append(t)
                rows.append(own)
    v, r = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))) if len(v) else np.zeros(0, bool)
    return r[new], v[new]


def _salt(*numbers: int) -> np.uint64:
    x = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for k in numbers:
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return x[0]


def _part_keys(values: np.ndarray, rule: Rule, band: int) -> list[np.ndarray]:
    """Tile keys of one set at a band: those of its parts in use. Where these are no more than what linked sets can differ by, all
    that agrees may be empty: the set is dealt anew under another hash, as is any set linked with it for which the same holds."""
    m, out = rule.parts_of(band), []
    most = rule.differ(min(len(values), int(rule.bands[band + 1]) - 1))  # the smaller set of a link is in the band
    for deal in range(_DEALS):
        with np.errstate(over="ignore"):
            x = mix64(values ^ _salt(77, deal))
            part = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, part, mix64(x))
            size = np.bincount(part, minlength=m)
            keys = mix64(total + size.astype(np.uint64) + _salt(band, deal) + np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        out.append(keys[size > 0])
        if len(out[-1]) > most:
            return out
    return [*out, keys[size == 0]]  # what agrees in the last deal may be empty


def tile_keys(values: np.ndarray, rule: Rule) -> np.ndarray:
    """All tile keys of a set: at its band, and at the band below where a linked smaller set may be."""
    n = len(values)
    band = int(np.searchsorted(rule.bands, n, side="right")) - 1
    out = _part_keys(values, rule, band)
    if band and rule.percent * n < 100 * int(rule.bands[band]):  # the smallest set that can be linked is in the band below
        out += _part_keys(values, rule, band - 1)
    return np.concatenate(out)


def set_hash(r: np.ndarray, v: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(mix64(v ^ np.uint64(0x5DEECE66D)), out=total[1:])
        cut = np.searchsorted(r, np.arange(rows + 1))
        return mix64(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def bitmap(values: np.ndarray) -> np.ndarray:
    """A bit for each shingle, of as many bits as the size asks for; bytes, least significant bit first."""
    width = min(MAX_BITS, max(64, 1 << int(BITS_PER_SHINGLE * len(values) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _set_rows(batches, rule: Rule):
    """(doc_id, text) to (doc_id, node, n, keys); keys only where the task meets a set for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for block in blocks(batch.column(1)):
            r, v = shingles(block, rule.words)
            node = set_hash(r, v, block.rows)
            cut = np.searchsorted(r, np.arange(block.rows + 1))
            n = np.diff(cut)
            keys: list = [None] * block.rows
            for i in np.flatnonzero(n).tolist():
                if (x := int(node[i])) not in seen:
                    seen.add(x)
                    keys[i] = tile_keys(v[cut[i] : cut[i + 1]], rule).view(np.int64)
            if len(seen) > HELD_NODES:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(node), pa.array(n), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "keys"])


#: Kinds of what _run_rows makes: a row of a tile of several nodes; a node alone with its tile in the task, whose tile may go on in
#: the next task; a tile that may.
_SURE, _ALONE, _EDGE = 0, 1, 2


def _run_rows(batches):
    """(key, node), ascending, to (key, node, kind). Only a task's first and last key can go on elsewhere; equal rows are one."""
    first = last = None  # the first key; the last row, not yet told, whether its key came before it, too
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(key):
            continue
        before = False
        if last is None:
            first = int(key[0])
        else:
            key, node, before = np.append(np.int64(last[0]), key), np.append(np.int64(last[1]), node), last[2]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[new], node[new]
        up = np.append(before, key[1:] == key[:-1])
        shared_ = up | np.append(key[:-1] == key[1:], False)
        last = int(key[-1]), int(node[-1]), bool(up[-1])
        shared_[-1] = False  # told with the next batch
        yield _kinds(key[shared_], node[shared_], _SURE)
        if len(key) > 1 and key[0] == first and not shared_[0]:
            yield _kinds(key[:1], node[:1], _ALONE)
    if last is not None:
        key, node, up = np.array(last[:1]), np.array(last[1:2]), last[2]
        yield _kinds(key, node, _SURE if up else _ALONE)
        edges = np.unique([first, last[0]])
        yield _kinds(edges, np.zeros_like(edges), _EDGE)


def _kinds(key: np.ndarray, node: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(np.full(len(key), kind, np.int32))], names=["key", "node", "kind"])


def shared_tiles(postings: DataFrame) -> DataFrame:
    """(node, key) to the (key, node) of the keys of several nodes, each once.

    One exchange by ranges of (key, node): a tile of very many nodes lies in many
    tasks, each of which compares neighbours. What a task cannot tell, of its
    first and last key, is settled by the keys that two tasks have at their ends.
    """
    told = shared.keep(postings.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_run_rows, "key long, node long, kind int"), "tile-runs")
    # At most two rows from each task.
    cut = told.where(F.col("kind") == _EDGE).groupBy("key").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("key")
    alone = told.where(F.col("kind") == _ALONE).join(F.broadcast(cut), "key", "left_semi")
    return told.where(F.col("kind") == _SURE).unionByName(alone).select("key", "node")


def _array_rows(batches, rule: Rule):
    """(text, node, copies) to (node, n, copies, bits, shingles, tiles) of the texts that have that node; the last two ascending."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            r, v = shingles(block, rule.words)
            cut = np.searchsorted(r, np.arange(block.rows + 1))
            part = batch.slice(block.first, block.rows)
            at = np.flatnonzero(set_hash(r, v, block.rows) == part.column(1).to_numpy())
            part = part.take(pa.array(at))
            own = [v[cut[i] : cut[i + 1]] for i in at.tolist()]
            tiles = [np.unique(tile_keys(x, rule).view(np.int64)).tobytes() for x in own]
            binary = (pa.array(x, pa.binary()) for x in ([bitmap(x).tobytes() for x in own], [x.tobytes() for x in own], tiles))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([len(x) for x in own], pa.int64()), part.column(2), *binary], names=["node", "n", "copies", "bits", "shingles", "tiles"])


def _bounded_rows(batches, rule: Rule):
    """Pairs (x, y, x's bitmap, y's bitmap, x's size, y's size) to those that sizes and bit counts allow to be linked."""
    for batch in batches:
        ok = []
        for p, q, n, m in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            width = min(len(p), len(q))
            p, q = (_fold(np.frombuffer(x, np.uint8), width).view(np.uint64) for x in (p, q))
            bound = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
            ok.append(rule.may_link(min(n, m), max(n, m)) and rule.linked(bound, n, m))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _verify_rows(batches, rule: Rule):
    """Pairs with their arrays to the pairs that are linked."""
    for batch in batches:
        xs, ys, a, b = (batch.column(i).to_pylist() for i in range(4))
        ok = []
        for p, q in zip(a, b):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            ok.append(rule.linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))


def _under(rows, *parameters):
    """A function over batches under a rule and the like."""
    return lambda batches: rows(batches, *parameters)


def _with_sides(pairs: DataFrame, arrays: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (x, y) with columns of both nodes. An x has few pairs; a y may have very many."""
    side = lambda c: arrays.select(F.col("node").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in columns])
    pairs = shared.keep(pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(HUB_SALTS))), "hub-pairs")
    hubs = shared.broadcast_if_few(shared.keep(pairs.select("y", "salt").distinct(), "hub-salts"), FEW).join(side("y"), "y")
    return shared.broadcast_if_few(pairs, FEW).join(side("x"), "x").join(hubs, ["y", "salt"]).select("x", "y", *[f"{c}_{k}" for k in columns for c in ("x", "y")])


def verify(pairs: DataFrame, arrays: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) whose sets are linked: those that the bitmaps allow, by exact intersection."""
    some = _with_sides(pairs, arrays, ["bits", "n"]).mapInArrow(_under(_bounded_rows, rule), "x long, y long")
    return _with_sides(some, arrays, ["shingles"]).mapInArrow(_under(_verify_rows, rule), "x long, y long")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


class _Sets:
    """Sorted arrays of some rows, merged into one numbering; counts what one row has in common with others."""

    def __init__(self, arrays: list[np.ndarray]):
        self.size = np.fromiter(map(len, arrays), np.int64, len(arrays))
        self.first = np.cumsum(self.size) - self.size
        values, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.first[i] : self.first[i] + self.size[i]]
        size = self.size[others]
        out = np.zeros(len(others), np.int64)
        full = np.flatnonzero(size)
        if not len(full) or not len(own):
            return out
        size, first = size[full], self.first[others[full]]
        ends = np.cumsum(size)
        self.mark[own] = True
        found = self.mark[self.flat[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))]]
        self.mark[own] = False
        out[full] = np.add.reduceat(found, ends - size, dtype=np.int64)
        return out


class _Block:
    """The nodes of one block of a tile: pairs of its first and second side that sizes and bit counts allow, in the first tile they share."""

    def __init__(self, rule: Rule, key: int, sides: tuple[int, int], own, comp, bits: list[bytes], tiles: list[np.ndarray], n):
        self.rule, self.sides, self.own, self.comp, self.n = rule, sides, np.array(own), np.array(comp), np.array(n)
        width = min(map(len, bits))
        self.bits = np.stack([_fold(np.frombuffer(x, np.uint8), width) for x in bits]).view(np.uint64)
        self.before = _Sets([t[t < key] for t in tiles])

    def partners(self, i: int) -> np.ndarray:
        other = (self.own == self.sides[1]) & (self.comp != self.comp[i])
        if self.sides[0] == self.sides[1]:
            other[: i + 1] = False
        n, b = self.n, self.bits
        j = np.flatnonzero(other & self.rule.may_link(np.minimum(n, n[i]), np.maximum(n, n[i])))
        if not len(j):
            return j
        only_i = np.bitwise_count(b[i] & ~b[j]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(b[j] & ~b[i]).sum(1, dtype=np.int64)
        j = j[self.rule.linked(np.minimum(n[i] - only_i, n[j] - only_j), n[i], n[j])]
        return j[self.before.common(i, j) == 0] if len(j) else j

    def pairs(self):
        """(i, partners of i) for the rows of the first side that have some."""
        for i in np.flatnonzero(self.own == self.sides[0]).tolist():
            j = self.partners(i)
            if len(j):
                yield i, j


def _by_block(batches):
    """Rows that begin with (key, first, second, own, node), sorted by these, as (the first three, the rest) for each block of two
    nodes or more; a repeated node counts once."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != at:
                if len(held) > 1:
                    yield at, held
                held, at = [], row[:3]
            if not held or held[-1][1] != row[4]:
                held.append(row[3:])
    if len(held) > 1:
        yield at, held


def _marked_rows(batches, rule: Rule):
    """Rows (key, first, second, own, node, comp, n, bits, tiles) by block to (key, first, second, own, node, comp) of the nodes with a partner."""
    for (key, first, second), held in _by_block(batches):
        own, node, comp, n, bits, tiles = zip(*held)
        block = _Block(rule, key, (first, second), own, comp, bits, [np.array(t) for t in tiles], n)
        some = np.zeros(len(held), bool)
        for i, j in block.pairs():
            some[i] = some[j] = True
        at = np.flatnonzero(some).tolist()
        if at:
            columns = [[key] * len(at), [first] * len(at), [second] * len(at), *([x[i] for i in at] for x in (own, node, comp))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "first", "second", "own", "node", "comp"])


class _Links:
    """A spanning forest of the links seen, and how many documents each node is linked with."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.near: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.up.setdefault(min(x, y), min(x, y))
        return x != y

    def flush(self) -> pa.RecordBatch:
        nodes = list(self.up)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.root(x) for x in nodes], pa.int64()), pa.array([self.near.get(x, 0) for x in nodes], pa.int64())], names=["x", "y", "near"])
        self.up, self.near = {}, {}
        return out


def _linked_rows(batches, rule: Rule, every: bool):
    """Rows (key, first, second, own, node, comp, copies, shingles, tiles) by block to (x, y, near): node, a node it is joined with,
    and how many documents it was found to be linked with. Unless every pair counts, pairs whose components are joined are passed over."""
    links = _Links()
    for (key, first, second), held in _by_block(batches):
        own, node, comp, copies, raw, tiles = zip(*held)
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        block = _Block(rule, key, (first, second), own, comp, [bitmap(x).tobytes() for x in sets], [np.frombuffer(t, np.int64) for t in tiles], [len(x) for x in sets])
        shared_ = _Sets(sets)
        near = np.zeros(len(held), np.int64)
        copies = np.array(copies)
        for i, j in block.pairs():
            if not every:
                at = links.root(comp[i])
                j = j[[links.root(comp[k]) != at for k in j.tolist()]]
                if not len(j):
                    continue
            j = j[rule.linked(shared_.common(i, j), block.n[i], block.n[j])]
            near[i] += copies[j].sum()
            near[j] += copies[i]
            for k in j.tolist():
                links.join(comp[i], comp[k])
        if every:
            for k in np.flatnonzero(near).tolist():
                links.near[node[k]] = links.near.get(node[k], 0) + int(near[k])
        if len(links.up) > HELD_NODES:
            yield links.flush()
    yield links.flush()


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("comp", "_comp"), "node", "left").withColumn("comp", F.coalesce("_comp", "node")).drop("_comp")


@dataclass
class Candidates:
    """sets: a row for each document (doc_id, node, n). rows: (key, node) of the tiles of two nodes or more, one tile for the same
    nodes. arrays: (node, n, copies, bits, shingles, tiles) of the nodes in rows, where copies is the number of documents; a node
    may have several equal rows, if its document has."""

    sets: DataFrame
    rows: DataFrame
    arrays: DataFrame


def candidates(docs: DataFrame, rule: Rule) -> Candidates:
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    made = shared.keep(docs.mapInArrow(_under(_set_rows, rule), schema), "sets-keys")
    sets = shared.keep(made.drop("keys"), "sets")
    rows = shared_tiles(made.where("keys is not null").select("node", F.explode("keys").alias("key")))
    shared.drop(made)
    del made
    shared.release(docs.sparkSession)
    who = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"who{k}") for k in (1, 2)]
    one = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *who).groupBy("members", "who1", "who2").agg(F.min("key").alias("key")).select("key")
    tiles = shared.keep(rows.join(one, "key", "left_semi"), "tiles")
    shared.drop(rows)
    # The sets of the nodes that share a tile, from one of their texts.
    named = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("copies"))
    wanted = shared.keep(tiles.select("node").distinct().join(named, "node"), "candidates")
    texts = docs.join(shared.broadcast_if_few(wanted, FEW), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node", "copies")
    arrays = shared.keep(texts.mapInArrow(_under(_array_rows, rule), "node long, n long, copies long, bits binary, shingles binary, tiles binary"), "arrays")
    return Candidates(sets, tiles, arrays)


def linked(found: Candidates, rule: Rule, comps: DataFrame | None = None) -> DataFrame:
    """(x, y, near) of all tiles: see _linked_rows. With comps, only of tiles whose nodes are of several components."""
    rows, arrays = found.rows, found.arrays
    if comps is None:
        rows = rows.withColumn("comp", F.col("node"))
    else:
        rows = shared.keep(_with_comp(rows, comps), "tile-comps")
    of_tile = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), F.max("n").alias("most")]
    side = F.least(F.lit(TILE_BLOCK), F.greatest(F.lit(16), F.lit(BLOCK_SHINGLES) / F.col("most")))
    tiles = rows.join(arrays.select("node", "n").distinct(), "node").groupBy("key").agg(*of_tile).where("lo <> hi").select("key", F.ceil(F.col("members") / side).cast("int").alias("nb"))
    rows = shared.keep(rows.join(tiles, "key"), "tile-blocks")
    member = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    # A node meets each block of its tile once: as the first side or the second.
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("own", "with").alias("first"), F.greatest("own", "with").alias("second"), "own", "node", "comp")
    by_block = lambda df: df.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "own", "node")
    known = arrays.select("node", "n", "bits").join(rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_TILES).alias("tiles")), "node")
    full = member.join(known, "node").select("key", "first", "second", "own", "node", "comp", "n", "bits", "tiles")
    marked = shared.keep(by_block(full).mapInArrow(_under(_marked_rows, rule), "key long, first long, second long, own long, node long, comp long"), "marked")
    full = shared.broadcast_if_few(marked, FEW).join(arrays, "node").select("key", "first", "second", "own", "node", "comp", "copies", "shingles", "tiles")
    return by_block(full).mapInArrow(_under(_linked_rows, rule, comps is None), "x long, y long, near long")


def join_near(docs: DataFrame, rule: Rule = OP5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text): (documents, links, counts). documents: doc_id, node, n_shingles; null node without shingles. links: x, y,
    a spanning forest of all links between different sets, by parts. counts: node, copies (documents of it), near (documents of
    other sets that are linked with it)."""
    found = candidates(docs, rule)
    rows = shared.keep(linked(found, rule), "near-links")
    shared.drop(found.arrays)
    copies = found.sets.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    near = rows.where("near > 0").groupBy(F.col("x").alias("node")).agg(F.sum("near").alias("near"))
    counts = copies.join(near, "node", "left").na.fill(0, ["near"])
    return _documents(found), rows.where("x <> y").select("x", "y"), counts


def _documents(found: Candidates) -> DataFrame:
    return found.sets.select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), F.col("n").alias("n_shingles"))


def near_links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text): (documents, links) as join_near, with links enough to hold every component together."""
    found = candidates(docs, rule)
    links, rows = None, found.rows
    for order in (1, 2):
        if links is not None:
            rows = shared.keep(_with_comp(rows.select("key", "node"), components(links)), "hub-comps")
        else:
            rows = rows.withColumn("comp", F.col("node"))
        # Each node with the hub, of another component, of most of its tiles.
        hubs = rows.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(order), "node")).alias("hub"))
        tried = rows.join(hubs, "key").where("comp <> hub.comp").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
        best = tried.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
        new = verify(best.select(F.col("node").alias("x"), F.col("hub").alias("y")), found.arrays, rule)
        links = shared.keep(new if links is None else new.unionByName(links), "hub-links")
        shared.release(docs.sparkSession)
    more = shared.keep(linked(found, rule, components(links)).where("x <> y").select("x", "y"), "near-links")
    shared.drop(found.arrays)
    shared.release(docs.sparkSession)
    return _documents(found), links.unionByName(more)


def _named(documents: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with shingles, and (node, component_id, copies, hot) of their nodes."""
    nodes = documents.where("node is not null")
    smallest = _with_comp(nodes.groupBy("node").agg(F.min("doc_id").alias("low")), components(links))
    return nodes, smallest.join(smallest.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("node", "component_id")


def near_components(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, the document's own among them."""
    documents, links = near_links(docs, rule)
    nodes, named = _named(documents, links)
    alone = documents.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return shared.join_spread(nodes, named, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def near_join(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id as near_components, and n_links: the other documents that the document is linked with."""
    documents, links, counts = join_near(docs, rule)
    nodes, named = _named(documents, links)
    named = named.join(counts.select("node", (F.col("copies") - 1 + F.col("near")).alias("n_links")), "node")
    alone = documents.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return shared.join_spread(nodes, named, "node").select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_join(shared.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, of 5-word shingles and 80 per cent: one row of each component stays, that with the smallest doc_id.

    Of rows with one doc_id in a component one stays, whichever; a null doc_id comes after all others. Rows without words all stay.
    """
    shared.prepare(spark)
    row = shared.unused("row", docs)
    docs = shared.keep(docs.withColumn(row, F.monotonically_increasing_id()), "stage-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    first = near_components(docs.select(key.alias("doc_id"), "text"), STAGE).where("doc_id = component_id").select(F.col("doc_id.row").alias(row))
    first = shared.broadcast_if_few(shared.keep(first, "stage-first"), 4 * FEW)  # 8 bytes each
    shared.release(spark)
    return docs.join(first, row, "left_semi").drop(row)
