"""Toxicity by a factorization machine over hashed terms.

Terms are lowercase words and their leading 4 to 8 bytes, hashed into DIMENSION buckets, with the logarithm of
their count as value, and one term for the text's length. Terms whose presence says nothing about the label (a
G-test over the labelled sample) have weight 0, so that long clean texts don't add up noise; over the others a
factorization machine learns a weight each and, by inner products of factors, one for every pair, which is how an
insult together with a group, or a stem that only counts often in a short text, weighs more than the sum of both.

Training takes at most MAX_LABELLED labelled documents, those of the least hash of doc_id, a fifth of which is held
out to choose the cut. The terms are counted by Spark; what the driver fits is the sample's active terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X
from lexsieve.llm._spark import cut

MAX_LABELLED = 20_000
DIMENSION = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: What a term must reach to have a weight, and how many may: the model's size. Parameters of ``train``.
MIN_COUNT, MIN_G, MAX_TERMS = 5, 25.0, 4096
FACTORS = 8
OUT = "doc_id long, score double, toxic boolean"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, doc, words = X.stems(texts, PREFIXES)
    return (h & np.uint64(DIMENSION - 1)).astype(np.int64), doc, words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a term."""
    seen = np.zeros((2, DIMENSION), np.int64)
    for batch in batches:
        for piece in X.slices(batch, "text", 1 << 20):
            term, doc, _ = _terms(piece.column("text"))
            pair = np.unique(doc * DIMENSION + term)
            label = np.asarray(piece.column("toxic"))[pair // DIMENSION]
            for k in (0, 1):
                seen[k] += np.bincount(pair[label == k] % DIMENSION, minlength=DIMENSION)
    some = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0][some]), pa.array(seen[1][some])], names=["term", "clean", "toxic"])


def _g(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G statistic of each term's presence against the label."""
    total = n_pos + n_neg
    out = np.zeros(len(pos))
    have = pos + neg
    for seen, n in ((pos, n_pos), (neg, n_neg)):
        for cell, side in ((seen, have), (n - seen, total - have)):
            expected = n * side / max(1, total)
            out += 2 * cell * np.log(np.maximum(cell, 1e-12) / np.maximum(expected, 1e-12)) * (cell > 0)
    return out


def _rows(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of active terms; column len(terms) is the length."""
    term, doc, words = _terms(texts)
    at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    keep = terms[at] == term if len(terms) else np.zeros(len(term), bool)
    pair, n = np.unique(doc[keep] * (len(terms) + 1) + at[keep], return_counts=True)
    row, col, value = pair // (len(terms) + 1), pair % (len(terms) + 1), np.log2(1.0 + n)
    docs = np.arange(len(texts))
    row, col = np.concatenate((row, docs)), np.concatenate((col, np.full(len(docs), len(terms))))
    value = np.concatenate((value, np.log1p(words) / 5))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], value[order]


class Model:
    """A fitted machine: sorted ``terms``, weights ``w``, factors ``v``, ``bias`` and the ``cut`` on the probability."""

    def __init__(self, terms: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float, cut_: float):
        self.terms, self.w, self.v, self.bias, self.cut = terms, w, v, bias, cut_

    def raw(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        z += np.bincount(row, self.w[col] * value, n)
        for f in range(self.v.shape[1]):
            a = self.v[col, f] * value
            z += 0.5 * (np.bincount(row, a, n) ** 2 - np.bincount(row, a * a, n))
        return z

    def score(self, texts: pa.Array) -> np.ndarray:
        row, col, value = _rows(texts, self.terms)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, col, value, len(texts)), -40, 40)))


def gradient(model: Model, row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray, l2: float) -> list[np.ndarray]:
    """Of the weighted logistic loss, with l2 / 2 times the squares of weights and factors, by weights, factors and bias."""
    n, m = len(label), len(model.w)
    z = model.raw(row, col, value, n)
    g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
    gr = g[row] * value
    out = [np.bincount(col, gr, m) + l2 * model.w, np.empty_like(model.v), np.array([g.sum()])]
    for f in range(model.v.shape[1]):
        a = model.v[col, f] * value
        total = np.bincount(row, a, n)
        out[1][:, f] = np.bincount(col, gr * (total[row] - a), m) + l2 * model.v[:, f]
    return out


def fit(terms: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Full-batch Adam on the logistic loss of four fifths of the rows; the cut has the best F1 on the last fifth."""
    n, m = len(label), len(terms) + 1
    rng = np.random.default_rng(7)
    model = Model(terms, np.zeros(m), rng.normal(0, 0.01, (m, FACTORS)), 0.0, 0.5)
    if n == 0 or label.min() == label.max():
        model.bias, model.cut = (-5.0 if n == 0 or label[0] == 0 else 5.0), 0.5
        return model
    held = rng.permutation(n) % 5 == 0
    if label[~held].min() == label[~held].max() or label[held].min() == label[held].max():
        held[:] = False
    share = label.mean()
    weight = np.where(held, 0.0, np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5)
    weight /= weight.sum()
    params = [model.w, model.v, np.zeros(1)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        model.bias = float(params[2][0])
        grads = gradient(model, row, col, value, label, weight, l2)
        for p, d, (a, b) in zip(params, grads, moment, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.bias = float(params[2][0])
    p = 1 / (1 + np.exp(-np.clip(model.raw(row, col, value, n), -40, 40)))
    judged = held if held.any() else ~held
    best = -1.0
    for c in np.arange(0.02, 0.99, 0.02):
        said, truth = p[judged] >= c, label[judged] == 1
        f1 = 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())
        if f1 >= best - 1e-9 and (f1 > best + 1e-9 or c <= 0.5):
            best, model.cut = f1, float(c)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, min_count: int = MIN_COUNT, min_g: float = MIN_G, max_terms: int = MAX_TERMS) -> Model:
    """Fit on the labelled documents, at most ``max_labelled``: those of the least hash of their id, then the least id.

    Terms that fewer than ``min_count`` of them hold, or whose G statistic is under ``min_g``, have no weight, and of
    more than ``max_terms`` those of the greatest statistic, then the least number, have one.

    A label other than 0 and 1, and null ids and texts, are left out; of several labels of one document the greatest
    counts, of several texts the least. Repeated rows count once, an empty text by its length alone, and long ones are
    taken whole. Without both classes, or with an empty table, the model gives one constant. Other columns are not
    looked at.
    """
    sample = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)")
    sample = sample.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    # the sample has at most max_labelled rows
    known = cut(texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = known.select("text", "toxic").mapInArrow(_counts, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= min_count).toPandas()
    g = _g(counts["toxic"].to_numpy(np.float64), counts["clean"].to_numpy(np.float64), totals.get(1, 0), totals.get(0, 0))
    order = np.lexsort((counts["term"].to_numpy(), -g))[:max_terms]
    terms = np.sort(counts["term"].to_numpy(np.int64)[order[g[order] >= min_g]])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                row, col, value = _rows(piece.column("text"), shared.value)
                cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), pack(col.astype(np.int32)), pack(value.astype(np.float32))], names=["doc_id", "toxic", "col", "value"])

    got = sorted((r["doc_id"], r["toxic"], bytes(r["col"]), bytes(r["value"])) for r in known.mapInArrow(active, "doc_id long, toxic int, col binary, value binary").collect())
    col = np.concatenate([np.frombuffer(x[2], np.int32) for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(x[3], np.float32) for x in got]).astype(np.float64) if got else np.zeros(0)
    row = np.repeat(np.arange(len(got)), [len(x[2]) // 4 for x in got]).astype(np.int64)
    return fit(terms, row, col, value, np.array([x[1] for x in got], np.int64))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                p = model.score(piece.column("text"))
                none = np.asarray(piece.column("text").is_null())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p, mask=none), pa.array(p >= model.cut, mask=none)], names=["doc_id", "score", "toxic"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row. A null text has null score and verdict; an empty one is scored by its
    length alone, a long one whole; a score equal to the cut is toxic. A null id stays null, repeated rows and texts
    under one id are each scored, an empty table gives an empty one, and other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scores(shared), OUT)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all their columns as they were; null texts stay, and each
    of repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, name, 1 << 20):
                texts = piece.column(name)
                clean = shared.value.score(texts) < shared.value.cut
                yield piece.filter(pa.array(clean | np.asarray(texts.is_null())))

    return docs.mapInArrow(run, docs.schema)
