"""Ranked lexical search by inverted treaps.

1. Each task reads its documents once and packs them into shards of bounded text:
   for every term the postings (document, tf) in doc_id order.
2. Counts of all documents (N, L, df) come from the shards by sums; each item's
   terms get their weights, and items are put together into blocks.
3. Every block meets every shard once, by an equi-join on a group of tasks: shards
   are dealt to the groups, blocks go to each. In a shard, each asked term's
   postings become a treap: doc_id is the search order, the impact the heap order
   (ties by a hash of the place, so that copies don't make a chain).
4. For an item, the treaps of its terms are walked together over intervals of
   documents. Of each term the highest posting inside the interval is known by
   descent; their weighted sum bounds every score in the interval. The interval
   of the highest bound is opened at its highest posting's document, which is
   scored exactly, and falls into two. Intervals whose bound cannot enter the
   best k (ties: whose first doc_id is too large) are pruned. Many intervals are
   opened at a time, in numpy. The best k of an item are handed on from shard to
   shard of a task; a window with a limit before its exchange merges the tasks.

Nothing is broadcast, and the driver sees N, L and the number of items alone.

Cases: null, empty and termless texts are no documents; they count in nothing
and are never returned. Each row is a document, whatever its doc_id: repeated
rows count, and take a rank each. A null doc_id ranks as the greatest and comes
back as null. Rows of one item_id are one item with the terms of all of them. An
item without terms, or whose terms no document holds, has no row; so has every
item where there are no documents. Terms of weight 0 (in nearly all documents)
add nothing. Whole texts are read, however long. Other columns are ignored. The
index is written and its counts are read while the result is built.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import shared

#: Text and documents of a shard (one longer text is a shard of its own), items of a block.
SHARD_BYTES, SHARD_DOCS, BLOCK_ITEMS = 16 << 20, 32_768, 256
#: Intervals opened at a time, and results of blocks that a task keeps before it hands them on.
OPENED, KEPT_BLOCKS = 256, 1024
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1

#: The words of a text whose letters A-Z are small, as Spark and as bytes of UTF-8.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = "shard string, docs long, words long, terms array<string>, holders array<int>, ids binary, lengths binary, places binary, counts binary"


def index(docs: DataFrame) -> DataFrame:
    """Shards of docs(doc_id, text): a row of INDEX for each."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        vocabulary, ids, lengths, terms, counts, size = {}, [], [], [], [], 0

        def shard():
            nonlocal vocabulary, ids, lengths, terms, counts, size, made
            made += 1
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            docs_ = np.repeat(place, [len(t) for t in terms])
            term, count = np.concatenate(terms), np.concatenate(counts)
            sort = np.lexsort((docs_, term))
            holders = np.bincount(term, minlength=len(vocabulary)).astype(np.int32)
            row = {
                "shard": [f"{part}-{made}"], "docs": [len(ids)], "words": [sum(lengths)],
                "terms": pa.array([pa.array(list(vocabulary), pa.binary()).cast(pa.string()).to_pylist()], pa.list_(pa.string())), "holders": pa.array([holders], pa.list_(pa.int32())),
                "ids": [np.array(ids, "<i8")[order].tobytes()], "lengths": [np.array(lengths, "<i8")[order].tobytes()], "places": [docs_[sort].astype("<i4").tobytes()], "counts": [count[sort].astype("<i4").tobytes()],
            }
            vocabulary, ids, lengths, terms, counts, size = {}, [], [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer() if text.is_valid else b""
                found = TERM_BYTES.findall(bytes(data).lower())
                if not found:
                    continue
                if ids and (size + len(data) > SHARD_BYTES or len(ids) == SHARD_DOCS):
                    yield shard()
                each = Counter(found)
                terms.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in each), np.int32, len(each)))
                counts.append(np.fromiter(each.values(), np.int32, len(each)))
                ids.append(NO_ID if doc is None else doc)
                lengths.append(len(found))
                size += len(data)
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of items(item_id, text), each once."""
    words = F.regexp_extract_all(F.translate(F.col("text"), UPPER, SMALL), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(words)).alias("term")).distinct()


def treap(impacts: list[int], first: int, left: np.ndarray, right: np.ndarray) -> int:
    """Links the nodes first, first + 1, ... into a tree that is a heap on their impacts; returns its root."""
    lefts, rights, stack = [-1] * len(impacts), [-1] * len(impacts), []
    for i, v in enumerate(impacts):
        last = -1
        while stack and impacts[stack[-1]] < v:
            last = stack.pop()
        if last >= 0:
            lefts[i] = last + first
        if stack:
            rights[stack[-1]] = i + first
        stack.append(i)
    left[first : first + len(impacts)], right[first : first + len(impacts)] = lefts, rights
    return stack[0] + first


class Shard:
    """The postings of a shard, and treaps of the terms asked for so far."""

    def __init__(self, terms: pa.Array, holders: np.ndarray, ids: bytes, lengths: bytes, places: bytes, counts: bytes, documents: int, words: int):
        self.terms = terms
        self.ends = np.cumsum(holders.astype(np.int64))
        self.starts = self.ends - holders
        self.ids = np.frombuffer(ids, "<i8")
        self.place = np.frombuffer(places, "<i4").astype(np.int64)
        tf = np.frombuffer(counts, "<i4").astype(np.int64)
        n = np.frombuffer(lengths, "<i8")
        if 90 * int(n.max()) * documents < 1 << 63:
            norm = 10 + 90 * n * documents // words
        else:
            norm = np.array([10 + 90 * int(x) * documents // words for x in n], np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[self.place])
        self.left = np.full(len(tf), -1, np.int64)
        self.right = np.full(len(tf), -1, np.int64)
        self.roots: dict[int, int] = {}

    def root(self, term: int) -> int:
        if term not in self.roots:
            a, b = int(self.starts[term]), int(self.ends[term])
            # A hash of the place breaks ties.
            heap = (self.impact[a:b] << 32) | (self.place[a:b] * 2_654_435_761 & 0xFFFFFFFF)
            self.roots[term] = treap(heap.tolist(), a, self.left, self.right)
        return self.roots[term]

    def into(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each subtree (a matrix: intervals by terms), the highest posting strictly between low and high; -1 if none."""
        node = node.copy()
        flat = node.reshape(-1)
        low, high = np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        open_ = np.flatnonzero(flat >= 0)
        while len(open_):
            at = flat[open_]
            place = self.place[at]
            over, under = place >= high[open_], place <= low[open_]
            moved = over | under
            open_ = open_[moved]
            flat[open_] = np.where(over[moved], self.left[at[moved]], self.right[at[moved]])
            open_ = open_[flat[open_] >= 0]
        return node

    def scores(self, places: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The exact scores of documents, by binary search in each term's postings."""
        out = np.zeros(len(places), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, b = int(self.starts[t]), int(self.ends[t])
            at = np.minimum(np.searchsorted(self.place[a:b], places) + a, b - 1)
            out += np.where(self.place[at] == places, w * self.impact[at], 0)
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k (ids, scores) of those given and of this shard's documents."""
        low, high = np.array([-1]), np.array([len(self.ids)])
        node = np.array([[self.root(t) for t in terms.tolist()]], np.int64)
        bound = (weights * self.impact[node[0]]).sum(keepdims=True)
        while len(bound):
            if len(scores) == k:
                enters = (bound > scores[-1]) | ((bound == scores[-1]) & (self.ids[np.minimum(low + 1, len(self.ids) - 1)] < ids[-1]))
                low, high, node, bound = low[enters], high[enters], node[enters], bound[enters]
                if not len(bound):
                    break
            # Highest bounds first; of equal ones those with the smallest documents.
            order = np.lexsort((low, -bound))
            now, later = order[:OPENED], order[OPENED:]
            part = node[now]
            weighted = np.where(part >= 0, weights * self.impact[part], -1)
            pivot = self.place[part[np.arange(len(now)), weighted.argmax(axis=1)]]
            found = self.scores(pivot, terms, weights)
            ids, scores = np.concatenate([ids, self.ids[pivot]]), np.concatenate([scores, found])
            rank = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[rank], scores[rank]
            lows, highs = np.concatenate([low[now], pivot]), np.concatenate([pivot, high[now]])
            nodes = np.concatenate([part, part])
            wide = highs - lows > 1
            lows, highs = lows[wide], highs[wide]
            nodes = self.into(nodes[wide], lows, highs)
            bounds = np.where(nodes >= 0, weights * self.impact[nodes], 0).sum(axis=1)
            alive = bounds > 0
            low, high = np.concatenate([low[later], lows[alive]]), np.concatenate([high[later], highs[alive]])
            node, bound = np.concatenate([node[later], nodes[alive]]), np.concatenate([bound[later], bounds[alive]])
        return ids, scores


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, groups: int | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the k best docs(doc_id, text) for each of items(item_id, text).

    ``groups``: into how many the shards are dealt, the session's shuffle partitions if not said; the blocks of items go to each.
    """
    spark = docs.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shared.keep(index(docs), "treap-index")
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
    documents, words = total["n"], total["l"]
    asked = shared.keep(item_terms(items), "treap-items")
    blocks = max(1, -(-asked.select(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()[0] // BLOCK_ITEMS))
    held = shards.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("holders").alias("df"))))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").select("item_id", F.struct("term", weight.alias("w")).alias("t")).where("t.w > 0")
    each = weighed.groupBy("item_id").agg(F.collect_list("t").alias("terms"))
    block = each.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    block = block.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = shards.drop("docs", "words").withColumn("_g", F.pmod(F.hash("shard"), F.lit(groups))).join(block.hint("shuffle_merge"), "_g")
    kind = items.schema["item_id"].dataType

    def run(batches):
        name, shard = None, None
        results: OrderedDict = OrderedDict()
        ids_type = None

        def found(done):
            rows = [(i, d, s) for one in done for i, d, s in one]
            lengths = [len(d) for _, d, _ in rows]
            owners = [i for (i, _, _), n in zip(rows, lengths) for _ in range(n)]
            return pa.RecordBatch.from_arrays([pa.array(owners, ids_type), pa.array(np.concatenate([d for _, d, _ in rows]) if rows else [], pa.int64()), pa.array(np.concatenate([s for _, _, s in rows]) if rows else [], pa.int64())], names=["item_id", "doc_id", "score"])

        for batch in batches:
            columns = {f: batch.column(f) for f in batch.schema.names}
            ids_type = batch.schema.field("items").type.value_type.field("item_id").type
            for r in range(batch.num_rows):
                if columns["shard"][r].as_py() != name:
                    name = columns["shard"][r].as_py()
                    shard = Shard(columns["terms"][r].values, columns["holders"][r].values.to_numpy(), *(columns[c][r].as_py() for c in ("ids", "lengths", "places", "counts")), documents, words)
                entries, block_ = columns["items"][r].values, columns["block"][r].as_py()
                lists = entries.field("terms")
                flat = lists.flatten()
                at = pc.index_in(flat.field("term"), value_set=shard.terms).fill_null(-1).to_numpy()
                weights, bounds = flat.field("w").to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                if block_ not in results:
                    none = np.zeros(0, np.int64)
                    results[block_] = [(i, none, none) for i in entries.field("item_id").to_pylist()]
                    if len(results) > KEPT_BLOCKS:
                        yield found([results.popitem(last=False)[1]])
                best = results[block_]
                results.move_to_end(block_)
                for i, (item, ids, scores) in enumerate(best):
                    here = slice(bounds[i], bounds[i + 1])
                    known = at[here] >= 0
                    if known.any():
                        best[i] = (item, *shard.best(at[here][known].astype(np.int64), weights[here][known], ids, scores, k))
        if results:
            yield found(results.values())

    from pyspark.sql import types as T

    partial = pairs.mapInArrow(run, T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score")


def op11_treaps(spark, sf_dir: str) -> DataFrame:
    return rank_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), d AS (SELECT row, doc_id, t, len(t) AS n FROM w WHERE len(t) > 0), g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM d), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY term), s AS (
  SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), g GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
