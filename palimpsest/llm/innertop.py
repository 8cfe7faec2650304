"""Exact top-k by integer inner product: columnar branch and bound.

Vectors are turned to integers, floor(1024 * x), and packed into chunks in
vertical layout: one row of values for each dimension. Every chunk of queries
meets every chunk of candidates once: candidates are dealt to groups of tasks,
the queries go to each group, and an equi-join on the group brings them
together, so that nothing is broadcast and no task holds more than two chunks
and the best k of the queries at hand.

For one query in one chunk, scores are accumulated dimension block by block,
the query's heaviest blocks first. What the remaining blocks can still add is
at most the product of both sides' remaining masses (Cauchy-Schwarz; the masses
are sums of squares in exact integers, their roots rounded up). Candidates whose
bound falls below the k-th best score known are dropped, and the survivors
are compacted before the next block. The k-th best is known early: a few
candidates of each chunk are scored first, and while a chunk of queries goes on
to the next candidates its results stay. Bounds below the threshold only are
cut, so ties survive and the smaller id wins them. Each group hands on k rows
for each query; a window with a limit before its exchange merges them.

Scores are exact: a matrix product in float32 or float64 is used only where the
sum of all amounts (bounded by the masses) is an integer these hold exactly, and
64-bit integers otherwise.

Cases: vectors that are null, empty, hold a null or a component that is not
finite take no part; nor does one with so large a component that a score could
pass 64 bits (2**31 / sqrt(dimensions) after scaling). Vectors meet those of
their own length only. A query's own rows are those of its vec_id; of equal
query rows of one id with the same vector one is answered, of an id with
different vectors the one with the greatest components. A repeated candidate
row takes a rank for each row. Null ids take no part. Fewer than k candidates:
all of them. Empty table: no rows. The job that counts the queries runs while
the result is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import shared

#: Vectors in a chunk of candidates, queries in a chunk of queries.
CHUNK, QUERIES = 8192, 512
#: Dimensions accumulated between two bounds.
BLOCK = 8
#: Candidates of each chunk that are scored in full, to know a threshold.
SEEDS = 256

PACKED = "part string, dims int, ids binary, cells binary"


def scaled(vectors: DataFrame, vec: str, factor: int) -> DataFrame:
    """Adds ``_v``, the integers of each vector that takes part, as array<int>; the others go."""
    cells = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * factor))
    limit = F.sqrt(F.lit(2.0) ** 62 / F.size(vec))
    fine = F.forall(F.col(vec), lambda x: F.coalesce(F.abs(F.floor(x.cast("double") * factor)) < limit, F.lit(False)) & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**40))
    kept = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).where(fine)
    return kept.withColumn("_v", cells.cast("array<int>"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of at most ``size`` of the rows (id, _v) of a partition, one length of vectors each, in vertical layout."""

    def run(batches):
        from pyspark import TaskContext

        part, held, made = TaskContext.get().partitionId(), {}, 0

        def chunk(dims, pieces):
            nonlocal made
            ids, cells = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
            made += 1
            return pa.RecordBatch.from_pydict({"part": [f"{part}-{made}"], "dims": pa.array([dims], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "cells": [np.ascontiguousarray(cells.T).astype("<i4").tobytes()]})

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            starts, cells = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(starts)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                block = cells[(starts[at][:, None] + np.arange(dims)[None, :])]
                pieces = held.setdefault(dims, [])
                pieces.append((ids[at], block))
                if sum(len(p[0]) for p in pieces) >= size:
                    ids_, cells_ = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
                    whole = len(ids_) // size * size
                    for a in range(0, whole, size):
                        yield chunk(dims, [(ids_[a : a + size], cells_[a : a + size])])
                    held[dims] = [(ids_[whole:], cells_[whole:])]
        for dims, pieces in held.items():
            if sum(len(p[0]) for p in pieces):
                yield chunk(dims, pieces)

    return rows.mapInArrow(run, PACKED)


class Chunk:
    """Vectors in vertical layout with the remaining masses of each split into blocks."""

    def __init__(self, dims: int, ids: bytes, cells: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.cells = np.frombuffer(cells, "<i4").reshape(dims, len(self.ids))
        self.dims = dims
        self.starts = list(range(0, dims, BLOCK))
        squares = self.cells.astype(np.int64) ** 2
        self.mass = np.add.reduceat(squares, self.starts, axis=0)  # blocks x vectors
        self.norm = np.sqrt(self.mass.sum(axis=0).astype(np.float64))

    def typed(self, kind) -> np.ndarray:
        if getattr(self, "kind", None) is not kind:
            self.kind, self.values = kind, np.ascontiguousarray(self.cells.astype(kind))
        return self.values


def exact_kind(a: Chunk, b: Chunk):
    """The quickest type in which every partial sum of a score of these chunks is exact."""
    most = float(a.norm.max(initial=0)) * float(b.norm.max(initial=0)) * (1 + 1e-9)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Best:
    """The best k candidates of each query so far, by score and then by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0, np.int64)] * queries

    def threshold(self, q: int):
        return int(self.scores[q][-1]) if len(self.scores[q]) == self.k else None

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        if len(ids) > 4 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def search(queries: Chunk, candidates: Chunk, best: Best) -> None:
    """Puts the candidates of a chunk that belong to the best k of each query into ``best``."""
    kind = exact_kind(queries, candidates)
    cells, asked = candidates.typed(kind), queries.typed(kind)
    n = len(candidates.ids)
    seeds = min(n, SEEDS)
    first = asked.T @ cells[:, :seeds]
    masses = candidates.mass
    slack = 1e-6 + 1e-15 * float(queries.norm.max(initial=0)) * float(candidates.norm.max(initial=0))  # rounding of sums above 2**53
    for q in range(len(queries.ids)):
        own = candidates.ids == queries.ids[q]
        known = np.flatnonzero(~own[:seeds])
        best.add(q, candidates.ids[known], first[q, known].astype(np.int64))
        least = best.threshold(q)
        alive = np.flatnonzero(~own[seeds:]) + seeds
        if not len(alive):
            continue
        left = queries.mass[:, q]
        order = np.argsort(-left, kind="stable")
        sums = np.zeros(len(alive), kind)
        rest, query_rest = masses[:, alive].sum(axis=0), int(left.sum())
        for at, block in enumerate(order.tolist()):
            a = candidates.starts[block]
            rows = slice(a, min(a + BLOCK, candidates.dims))
            values = cells[rows][:, alive]
            sums = sums + asked[rows, q] @ values
            rest = rest - masses[block, alive]
            query_rest -= int(left[block])
            if least is not None and at + 1 < len(order):
                # The root is rounded up: the product of the masses may be one unit in the last place too small.
                more = np.sqrt(rest.astype(np.float64) * float(query_rest)) * (1 + 1e-12) + slack
                stays = sums + more >= least
                if not stays.all():
                    alive, sums, rest = alive[stays], sums[stays], rest[stays]
                    if not len(alive):
                        break
        if len(alive):
            scores = sums.astype(np.int64)
            if least is not None:
                alive, scores = alive[scores >= least], scores[scores >= least]
            best.add(q, candidates.ids[alive], scores)


def top_products(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vec: str = "embedding", factor: int = 1024, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each row of ``queries``.

    Both have the columns vec_id (long) and vec (array of numbers). ``groups``: into how many the candidates are dealt, the
    session's shuffle partitions if not said; the queries go to each of them.
    """
    spark = vectors.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = lambda df: scaled(df.select(F.col(vec_id).cast("long").alias("_id"), F.col(vec).alias("_x")).where("_id is not null"), "_x", factor).select("_id", "_v")
    asked = slim(queries).groupBy("_id").agg(F.max("_v").alias("_v"))
    chunks = max(1, -(-queries.count() // QUERIES))
    asked = packed(asked.coalesce(chunks), QUERIES).select(F.col("part").alias("q_part"), "dims", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    asked = asked.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = packed(slim(vectors), CHUNK).withColumn("_g", F.pmod(F.hash("part"), F.lit(groups)))
    pairs = asked.join(held.hint("shuffle_merge"), ["_g", "dims"]).select("q_part", "q_ids", "q_cells", "dims", "ids", "cells")

    def run(batches):
        name, query, best = None, None, None

        def found():
            lengths = [len(x) for x in best.ids]
            return pa.RecordBatch.from_pydict({"query_id": np.repeat(query.ids, lengths), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})

        for batch in batches:
            for r in range(batch.num_rows):
                q_part, q_ids, q_cells, dims, ids, cells = (batch.column(c)[r].as_py() for c in range(6))
                if (q_part, dims) != name:
                    if best:
                        yield found()
                    name, query = (q_part, dims), Chunk(dims, q_ids, q_cells)
                    best = Best(len(query.ids), k)
                search(query, Chunk(dims, ids, cells), best)
        if best:
            yield found()

    partial = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_innertop(spark, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
