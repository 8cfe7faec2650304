"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of word beginnings is
trained in numpy from confirmed toxic examples (P) and unlabelled texts (U)
with the class-prior-corrected, non-negative risk

    R = prior * E_P[l(+g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l; while the second part is negative, its gradient is
reversed, as the method asks. All hashed features of the sample are weighed
under this risk; an L1 penalty, applied as a proximal step, leaves the weights
of most at zero. The prior is the share of toxic rows among the labelled
training rows; the bias is that of the prior, so a text without any feature of
weight scores the prior.

Cases: null, empty and wordless texts score the prior. Without confirmed
toxic rows every text scores 0. Repeated rows are scored each for itself; a
label without a document, a null label or a null doc_id teaches nothing. Input
columns with the names of added ones are replaced by them (``names`` gives
others); the stage hands on all columns as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import ALNUM_OR_HIGH, blocks

#: Lengths in bytes of the word beginnings that are features besides the whole word.
PREFIXES = (4, 5)


@dataclass
class Params:
    """max_positive, max_unlabelled: bounds of the training sample, in rows. penalty: of the L1 norm.

    rate and penalty were chosen among 0.03 to 0.3 and 1e-4 to 1e-3 by the log-loss on a fifth of the training rows that taught nothing.
    """

    max_positive: int = 1500
    max_unlabelled: int = 3000
    rounds: int = 200
    rate: float = 0.2
    penalty: float = 3e-4


def _features(block, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature hash) of a block; with keys, (row, index of the key), only those found."""
    low = block.lowered()
    starts, ends = low.spans(ALNUM_OR_HIGH)
    rows = low.row_of(starts)
    found_r, found_f = [], []
    for k, salt in ((0, 1), *((k, k) for k in PREFIXES)):
        at = np.flatnonzero(ends - starts > k) if k else slice(None)
        s = starts[at]
        h = low.hashes(s, s + k if k else ends) ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)
        r = rows[at]
        if keys is not None:
            i = np.searchsorted(keys, h)
            i[i == len(keys)] = 0
            hit = keys[i] == h
            r, h = r[hit], i[hit]
        found_r.append(r)
        found_f.append(h)
    r, f = np.concatenate(found_r), np.concatenate(found_f)
    if keys is not None:
        pair = np.unique(r.astype(np.int64) * max(1, len(keys)) + f)
        return pair // max(1, len(keys)), pair % max(1, len(keys))
    order = np.lexsort((f, r))
    r, f = r[order], f[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
    return r[new], f[new]


def _examples(batches) -> dict[bool, list[np.ndarray]]:
    """The distinct feature hashes of each text of (positive, text), for positive and unlabelled texts.

    Copies of one text are one example, or each word of a much-copied toxic text would look toxic.
    """
    found = {True: set(), False: set()}
    for batch in batches:
        flags = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            r, f = _features(block)
            cut = np.searchsorted(r, np.arange(block.rows + 1))
            for i in range(block.rows):
                found[flags[block.first + i]].add(f[cut[i] : cut[i + 1]].tobytes())
    return {flag: [np.frombuffer(x, np.uint64) for x in sorted(texts)] for flag, texts in found.items()}


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, block) -> np.ndarray:
        g = np.full(block.rows, self.bias)
        if len(self.keys):
            r, f = _features(block, self.keys)
            g += np.bincount(r, weights=self.weights[f], minlength=block.rows)
        return shared.sigmoid(g)


def risk_gradient(g: np.ndarray, n_p: int, prior: float) -> tuple[np.ndarray, bool]:
    """Gradient of the risk by the outputs g, the first n_p of which are of positive examples; and whether it is the reversed one."""
    s, n_u = shared.sigmoid(g), len(g) - n_p
    negative = np.mean(np.logaddexp(0, g[n_p:])) - prior * np.mean(np.logaddexp(0, g[:n_p]))
    # d l(+g)/dg = s - 1; d l(-g)/dg = s
    of_negative = np.concatenate((-prior * s[:n_p] / n_p, s[n_p:] / n_u))
    if negative < 0:
        return -of_negative, True
    of_negative[:n_p] += prior * (s[:n_p] - 1) / n_p
    return of_negative, False


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: Params) -> Model:
    """positive, unlabelled: the distinct features of each text."""
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 60.0 if n_p and prior >= 1 else -60.0)
    doc = np.repeat(np.arange(n_p + n_u, dtype=np.int32), [len(x) for x in (*positive, *unlabelled)])
    flat = np.concatenate([*positive, *unlabelled])
    keys = np.unique(flat)
    col = np.searchsorted(keys, flat).astype(np.int32)
    del flat
    w, b = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(keys)), np.zeros(len(keys))
    for t in range(1, p.rounds + 1):
        by_doc, _ = risk_gradient(np.bincount(doc, w[col], n_p + n_u) + b, n_p, prior)
        g = np.bincount(col, by_doc[doc], len(keys))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        size = p.rate * (1 - (t - 1) / p.rounds) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w -= size * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - size * p.penalty, 0.0)
    left = np.flatnonzero(w)
    return Model(keys[left], w[left], b)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): trains on a bounded sample of both; every row given may be used.

    A document with several labels counts as toxic if any of them says so. Of a
    repeated doc_id the least text is taken. One task trains; only the weights that are not zero come to the driver.
    """
    by_doc = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = by_doc.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("prior")).first()["prior"] or 0.0
    text = docs.select("doc_id", "text").where("text is not null")
    pos_ids = shared.hash_sample(by_doc.where("toxic = 1").select("doc_id"), "doc_id", params.max_positive)
    pos = shared.one_each(text.join(F.broadcast(pos_ids), "doc_id", "left_semi"), "doc_id")  # ids bounded by max_positive
    pos = pos.select(F.lit(True).alias("positive"), "text")
    unl = shared.hash_sample(text, "doc_id", params.max_unlabelled).select(F.lit(False).alias("positive"), "text")

    def learn(batches) -> Model:
        examples = _examples(batches)
        return train(examples[True], examples[False], float(share), params)

    return shared.trained(pos.unionByName(unl), learn)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the prediction to the columns of docs, which must hold ``text``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights that are not zero, of a bounded sample
    kept = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*kept)
    text_at = kept.index("text")

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                s = sent.value.scores(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every document; learns only from rows outside the held-out fold."""
    docs = shared.table(spark, sf_dir, "documents")
    labels = shared.table(spark, sf_dir, "labels")
    model = fit(docs.where(shared.crc_fold("doc_id", 5) != 0), labels.where(shared.crc_fold("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (shared.crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    shared.prepare(spark)
    labels = shared.table(spark, sf_dir, "labels")
    model = fit(docs.where(shared.crc_fold("doc_id", 5) != 0), labels.where(shared.crc_fold("doc_id", 5) != 0))
    own = tuple(shared.unused(n, docs) for n in ("score", "predicted"))
    return score(docs, model, own).where(F.col(own[1]) == 0).select(*docs.columns)
