"""Language identification by hierarchical discrimination.

A linear classifier first predicts the language family from byte n-grams;
one-versus-one linear support vector machines then separate the languages
inside the family, each pair by its own machine, and the pairs vote.
Features are the relative frequencies of hashed byte trigrams and 5-grams of
the whole text (letters lower-cased, digits and punctuation folded).

Cases: a null text or one without any letter is ``und`` with score 0. With no
labelled rows every text is ``und`` with score 0; with one learned language
every text with a letter gets it with score 1. Ties go to the language first
in alphabetical order. Repeated rows are scored each. Input columns with the
names of added ones are replaced by them (``names`` gives others); the stage
hands on all columns as they were.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import LOWER, Block, blocks, segment_sums

#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 12
DIM = 1 << BITS
_LETTER = regex.compile(r"\p{L}")


def _fold_table() -> np.ndarray:
    t = LOWER.copy()
    for b in range(128):
        if not 97 <= t[b] <= 122:
            t[b] = 0x30 if 0x30 <= b <= 0x39 else 0x20
    return t


_FOLD = _fold_table()


@dataclass
class Params:
    """max_rows: bound of the labelled training sample; families: code to family."""

    max_rows: int = 3000
    cost: float = 50.0
    passes: int = 12
    families: dict = field(default_factory=lambda: dict(_FAMILY_OF))


def _grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and of the 5-gram at each byte; DIM*2 where it would leave the row."""
    c = _FOLD[block.data]
    # Capital Latin-1 letters are the same bytes but for one bit.
    capital = np.zeros(len(c), bool)
    capital[1:] = (c[:-1] == 0xC3) & (c[1:] >= 0x80) & (c[1:] <= 0x9E)
    c[capital] += 0x20
    x = c.astype(np.uint32)
    n = len(x)
    out = []
    for size, seed in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        h = np.zeros(n, np.uint32)
        m = n - size + 1
        if m > 0:
            g = x[:m].copy()
            for k in range(1, size):
                g *= np.uint32(16777619)
                g += x[k : k + m]
            g *= np.uint32(seed)
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x2C1B3C6D)
            h[:m] = (g >> np.uint32(32 - BITS)) + (DIM if size == 5 else 0)
        for k in range(1, size):
            at = block.offsets[1:] - k
            h[at[at >= block.offsets[:-1]]] = 2 * DIM
        out.append(h)
    return out[0], out[1]


def _lengths(block: Block) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(block.offsets)
    return np.maximum(1, n - 2), np.maximum(1, n - 4)


def _frequencies(batches) -> list[tuple[str, bytes, bytes]]:
    """The language and the sparse frequencies (buckets, values) of each text of (lang, text), in a fixed order."""
    out = []
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            g3, g5 = _grams(block)
            n3, n5 = _lengths(block)
            for i, (a, b) in enumerate(zip(block.offsets[:-1], block.offsets[1:])):
                u3, c3 = np.unique(g3[a:b], return_counts=True)
                u5, c5 = np.unique(g5[a:b], return_counts=True)
                u, v = np.concatenate((u3, u5)), np.concatenate((c3 / n3[i], c5 / n5[i]))
                real = u < 2 * DIM
                out.append((langs[block.first + i], u[real].astype(np.uint16).tobytes(), v[real].astype(np.float32).tobytes()))
    return sorted(out)


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, p: Params, seed: int) -> np.ndarray:
    """Linear SVM (squared hinge) over some rows of x by dual coordinate descent; the last column of x is the bias. y is +1 or -1."""
    n, d = len(rows), x.shape[1]
    w, alpha = np.zeros(d, np.float32), np.zeros(n)
    share = {s: max(1, int((y == s).sum())) for s in (1, -1)}
    diag = np.where(y > 0, n / (2 * p.cost * share[1]), n / (2 * p.cost * share[-1])) * 0.5
    q = np.einsum("ij,ij->i", x, x)[rows] + diag
    rng = np.random.default_rng(seed)
    for _ in range(p.passes):
        for i in rng.permutation(n):
            own = x[rows[i]]
            g = y[i] * float(own @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * own
                alpha[i] = new
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with the usual softened targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        s = shared.sigmoid(a * margin + b)
        g = np.array([((s - t) * margin).sum() + 1e-3 * a, (s - t).sum()])
        r = s * (1 - s) + 1e-9
        h = np.array([[(r * margin * margin).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 1e-6)), float(b)


@dataclass
class Model:
    """machines: (kind, first, second) of each row of weights; kind is ``family`` or ``pair``."""

    langs: list[str]
    family: dict[str, str]
    machines: list[tuple[str, str, str]]
    weights: np.ndarray  # machines x (2*DIM + 1), the last column 0 for grams that leave the row
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        n = block.rows
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        families = sorted({self.family[x] for x in self.langs})
        votes = {f: np.ones(n) for f in families}
        pairs = {x: np.zeros(n) for x in self.langs}
        wins = {x: np.zeros(n) for x in self.langs}
        if self.machines:
            g3, g5 = _grams(block)
            n3, n5 = _lengths(block)
        for k, (kind, a, b) in enumerate(self.machines):
            m = segment_sums(self.weights[k][g3].astype(np.float64), block.offsets) / n3 + segment_sums(self.weights[k][g5].astype(np.float64), block.offsets) / n5 + self.bias[k]
            prob = shared.sigmoid(self.scale[k] * m + self.shift[k])
            if kind == "family":
                votes[a] = prob
            else:
                pairs[a] += prob
                pairs[b] += 1 - prob
                wins[a] += m >= 0
                wins[b] += m < 0
        fam = np.stack([votes[f] for f in families])
        fam = fam / np.maximum(fam.sum(0), 1e-12)
        best_family = fam.argmax(0)
        out, score = np.full(n, "und", dtype=object), np.zeros(n)
        for i, f in enumerate(families):
            own = [x for x in self.langs if self.family[x] == f]
            rows = best_family == i
            rank = np.stack([wins[x] + 1e-3 * pairs[x] for x in own])
            best = rank.argmax(0)
            inner = np.stack([pairs[x] for x in own])[best, np.arange(n)] / max(1, len(own) - 1) if len(own) > 1 else np.ones(n)
            out[rows] = np.array(own, dtype=object)[best[rows]]
            score[rows] = (fam[i] * inner)[rows]
        for i, raw in enumerate(block.texts()):
            if _LETTER.search(raw[:64].decode("utf-8", "ignore")) is None and _LETTER.search(raw.decode("utf-8", "replace").replace("�", " ")) is None:
                out[i], score[i] = "und", 0.0
        return out.tolist(), np.clip(score, 0.0, 1.0)


def train(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]], p: Params) -> Model:
    """rows: (buckets, frequencies) of each labelled text."""
    names = sorted(set(langs))
    family = {x: p.families.get(x, x) for x in names}
    machines: list[tuple[str, str, str]] = []
    families = sorted(set(family.values()))
    if len(families) > 1:
        machines += [("family", f, "") for f in families]
    for f in families:
        machines += [("pair", a, b) for a, b in combinations([x for x in names if family[x] == f], 2)]
    m = len(machines)
    weights, bias, scale, shift = np.zeros((m, 2 * DIM + 1), np.float32), np.zeros(m), np.ones(m), np.zeros(m)
    if m:
        x = np.zeros((len(rows), 2 * DIM + 1), np.float32)
        for i, (u, v) in enumerate(rows):
            x[i, u] = v
        norm = float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean()) or 1.0
        x /= norm
        x[:, -1] = 1.0
        label = np.array(langs)
        fam = np.array([family[x_] for x_ in langs])
        for k, (kind, a, b) in enumerate(machines):
            rows_k = np.arange(len(rows)) if kind == "family" else np.flatnonzero((label == a) | (label == b))
            y = np.where((fam if kind == "family" else label)[rows_k] == a, 1.0, -1.0)
            w = _svm(x, rows_k, y, p, k)
            scale[k], shift[k] = _calibrate((x @ w)[rows_k], y)
            weights[k, : 2 * DIM] = w[: 2 * DIM] / norm
            bias[k] = w[-1]
    return Model(names, family, machines, weights, bias, scale, shift)


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """docs(doc_id, text, lang): trains on a bounded hash sample of the rows with text and lang, of a repeated doc_id on one. One task trains; only the machines come to the driver."""
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")

    def learn(batches) -> Model:
        rows = _frequencies(batches)
        return train([r[0] for r in rows], [(np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32)) for r in rows], params)

    return shared.trained(shared.hash_sample(labelled, "doc_id", params.max_rows).select("lang", "text"), learn)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and the score to the columns of docs, which must hold ``text``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # machines * 32 KiB
    kept = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*kept)
    text_at = kept.index("text")

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                lang, s = sent.value.predict(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(s, pa.float64())], names=[*kept, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Predicts the language of every document; learns only from rows outside the held-out fold."""
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(docs.where(shared.crc_fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (shared.crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.4) -> DataFrame:
    """Pipeline stage: documents go whose language is not recognised.

    Those are null texts, texts without a letter, and texts whose best language
    the model gives less than ``min_score``. The
    declared language decides nothing about its own row beyond training.
    """
    shared.prepare(spark)
    model = fit(docs.where(shared.crc_fold("doc_id", 4) != 2))
    if not model.langs:
        # Nothing to learn from: only what has no letter is rejected.
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = tuple(shared.unused(n, docs) for n in ("lang_pred", "score"))
    return predict(docs, model, own).where((F.col(own[0]) != "und") & (F.col(own[1]) >= min_score)).select(*docs.columns)
