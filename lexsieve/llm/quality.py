"""Document quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or abstains from one statistic of a text. All documents' votes are counted by pattern
(at most 3 ** len(LABELLERS) of them), and EM over the counts estimates, without gold labels, how often each labeller
votes what in good and in bad documents, and how many are bad. The posteriors of at most MAX_SAMPLE documents, those
of the least hash of id and text, train a logistic scorer over hashed word shapes, which then judges every document: it
sees how often each shape occurs, and so grades texts on which the labellers' fixed cuts abstain or err.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X

MAX_SAMPLE = 20_000
DIMENSION = 1 << 16
#: Beyond so many words the share of words said before counts for less, in proportion.
OLD_WORDS = 3000
#: (statistic, bad if above, good if below); reversed where the first is the smaller.
LABELLERS = (
    ("repeat", 0.2, 0.02),
    ("symbol", 0.06, 0.02),
    ("bar", 0.1, 0.005),
    ("upper", 0.5, 0.2),
    ("letter", 0.6, 0.8),
    ("shout", 0.2, 0.02),
    ("old", 0.93, 0.8),
    ("word_bytes", 14.0, 11.0),
    ("words", 2.0, 12.0),
)
OUT = "doc_id long, score double, keep boolean"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_LOWER, _UPPER, _DIGIT = _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_BEYOND = np.arange(256) >= 0x80
_SYMBOL = _table("#$%&*<>=~^{}[]\\/_|@+")
#: Each byte's class for shapes; punctuation stands for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[_LOWER | _BEYOND] = ord("a")
_CLASS[_UPPER] = ord("A")
_CLASS[_DIGIT] = ord("0")


class _Words:
    """Words of a slice of texts (runs of bytes above U+0020), with what both the votes and the features need."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.data, self.off = X.raw(texts)
        if len(self.data):
            self.start, self.end = X._spans(self.data, self.off, X.INSIDE["space"])
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.hash = X.prefix_hashes(self.data, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        cuts = np.searchsorted(self.start, self.off)
        self.count = np.diff(cuts)
        self.doc = np.repeat(np.arange(self.n), self.count)
        same = np.zeros(len(self.hash), bool)
        if len(self.hash):
            same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.same = same

    def per_doc(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[flag], minlength=self.n)

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(table[self.data])))
        return run[self.off[1:]] - run[self.off[:-1]]

    def stats(self) -> dict[str, np.ndarray]:
        words = np.maximum(1, self.count)
        size = np.bincount(self.doc, (self.end - self.start).astype(float), self.n)
        upper, letters = self.bytes_in(_UPPER), self.bytes_in(_UPPER | _LOWER | _BEYOND)
        last = self.data[self.end - 1] if len(self.end) else self.data
        distinct = np.bincount(np.unique((self.doc.astype(np.uint64) << np.uint64(40)) | (self.hash >> np.uint64(24))).astype(np.uint64) >> np.uint64(40), minlength=self.n) if len(self.hash) else np.zeros(self.n)
        return {
            "repeat": self.per_doc(self.same) / words,
            "symbol": self.bytes_in(_SYMBOL) / np.maximum(1, size),
            "bar": self.per_doc((self.end - self.start == 1) & (last == ord("|"))) / words,
            "upper": upper / np.maximum(1, letters),
            "letter": letters / np.maximum(1, size),
            "shout": self.per_doc(last == ord("!")) / words,
            # words repeat more the longer a text is
            "old": np.where(self.count >= 40, 1 - distinct / words, 0.0) * np.minimum(1, OLD_WORDS / words),
            "word_bytes": size / words,
            "words": self.count.astype(float),
        }

    def patterns(self) -> np.ndarray:
        """The votes as digits of base 3, first labeller lowest: 0 bad, 1 good, 2 abstains."""
        stats, out = self.stats(), np.zeros(self.n, np.int64)
        for k, (name, bad, good) in enumerate(LABELLERS):
            x = stats[name]
            is_bad, is_good = (x > bad, x < good) if bad > good else (x < bad, x > good)
            out += np.where(is_bad, 0, np.where(is_good, 1, 2)) * 3**k
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket, share of the document's words) of word shapes, pairs of shapes and repeats, and statistics
        in steps. A shape is a word's classes of bytes with runs collapsed."""
        if not len(self.start):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0)
        kind = _CLASS[self.data]
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[self.start] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        s, e = place[self.start], place[self.end - 1] + keep[self.end - 1] * 0
        e = place[self.end]
        shape = X.prefix_hashes(kind[keep], s, e)
        pair = shape.copy()
        pair[1:] = X.mix(shape[1:] + X.mix(shape[:-1]))
        first = np.ones(len(shape), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        hashes, docs = [shape, pair[~first], np.full(int(self.same.sum()), 12345, np.uint64)], [self.doc, self.doc[~first], self.doc[self.same]]
        key, n = np.unique(np.concatenate(docs).astype(np.int64) * DIMENSION + (np.concatenate(hashes) % np.uint64(DIMENSION)).astype(np.int64), return_counts=True)
        doc, bucket = key // DIMENSION, key % DIMENSION
        value = n / self.count[doc]
        extra_doc, extra = [], []
        stats = self.stats()
        for k, (name, bad, good) in enumerate(LABELLERS):
            step = np.clip(np.floor(4 * stats[name] / max(bad, good)), 0, 12).astype(np.int64)
            extra_doc.append(np.arange(self.n))
            extra.append((X.mix((step + 100 * k + 777).astype(np.uint64)) % np.uint64(DIMENSION)).astype(np.int64))
        return np.concatenate((doc, *extra_doc)), np.concatenate((bucket, *extra)), np.concatenate((value, np.full(self.n * len(extra), 0.25)))


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of bad documents, table[class, labeller, vote], posterior of bad by pattern) by EM.

    Starts from: bad if any labeller says so. Classes are 0 good, 1 bad; votes as in a pattern's digits.
    """
    m = len(LABELLERS)
    votes = np.stack([patterns // 3**k % 3 for k in range(m)], axis=1)
    post = np.where((votes == 0).any(axis=1), 0.9, 0.05)
    table = np.full((2, m, 3), 1 / 3)
    share = 0.5
    for _ in range(steps):
        share = float((post * counts).sum() / max(1, counts.sum()))
        for c, weight in ((0, (1 - post) * counts), (1, post * counts)):
            for k in range(m):
                table[c, k] = (np.bincount(votes[:, k], weight, 3) + 0.1) / (weight.sum() + 0.3)
        log = [np.log(max(1e-9, p)) + np.log(table[c, np.arange(m), votes]).sum(axis=1) for c, p in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return share, table, post


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability that each text is good."""
        w = _Words(texts)
        doc, bucket, value = w.features()
        z = self.bias + np.bincount(doc, self.weights[bucket] * value, w.n)
        return np.where(w.count > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 1e-5) -> Model:
    """Full-batch Adam on the logistic loss against soft labels."""
    names, col = np.unique(bucket, return_inverse=True)
    n, m = len(good), len(names)
    params = [np.zeros(m), np.zeros(1)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        z = params[1][0] + np.bincount(row, params[0][col] * value, n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - good) / max(1, n)
        grads = [np.bincount(col, g[row] * value, m) + l2 * params[0], np.array([g.sum()])]
        for p, d, (a, b) in zip(params, grads, moment, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSION)
    weights[names] = params[0]
    return Model(weights, float(params[1][0]))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in X.slices(batch, "text", 1 << 20):
            p, n = np.unique(_Words(piece.column("text")).patterns(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in X.slices(batch, "text", 1 << 20):
            w = _Words(piece.column("text"))
            doc, bucket, value = w.features()
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(w.n + 1))
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(w.patterns()), pack(bucket[order].astype(np.int32)), pack(value[order].astype(np.float32))], names=["doc_id", "h", "pattern", "bucket", "value"])


def _highest(total: int, max_sample: int) -> int:
    """The greatest 64-bit hash of a range that holds max_sample of ``total`` rows, and a fifth more to be sure."""
    return min((1 << 63) - 1, -(1 << 63) + (max_sample * 6 << 64) // (5 * total))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sample: int = MAX_SAMPLE) -> tuple[Model, dict[str, tuple[float, float]]]:
    """The scorer, and of each labeller the estimated chance of voting bad in (good, bad) documents.

    Votes are counted over all texts. The scorer is fitted to at most ``max_sample`` of them, those of the least hash of
    id and text; a null id is one like any other, two texts under one id are two, equal rows are interchangeable, and
    texts of any length are taken whole. Null texts are left out; without any text, an empty table included, and without
    words, the scorer calls everything bad. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    counts = docs.select("text").mapInArrow(_votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    patterns, n = counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    _, table, bad = estimate(patterns, n)
    accuracy = {name: (float(table[0, k, 0]), float(table[1, k, 0])) for k, (name, _, _) in enumerate(LABELLERS)}
    total = int(n.sum())
    if not total:
        return Model(np.zeros(DIMENSION), -5.0), accuracy
    # a hash range that holds max_sample rows or slightly more, then exactly that many; rows alike in all are interchangeable
    h = F.xxhash64("doc_id", "text", F.lit(3))
    rows = docs.where(h <= _highest(total, max_sample)).select("doc_id", h.alias("h"), "text").mapInArrow(_sampled, "doc_id long, h long, pattern long, bucket binary, value binary")
    got = [tuple(r)[2:] for r in rows.orderBy("h", "doc_id", "pattern", "bucket", "value").limit(max_sample).collect()]
    bucket = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[1], np.int32) for r in got)]).astype(np.int64)
    value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r[2], np.float32) for r in got)]).astype(np.float64)
    row = np.repeat(np.arange(len(got)), [len(r[1]) // 4 for r in got]).astype(np.int64)
    at = np.searchsorted(patterns, np.array([r[0] for r in got], np.int64))
    return fit(row, bucket, value, 1 - bad[at]), accuracy


def _judge(shared, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                p = shared.value.score(piece.column("text"))
                none = np.asarray(piece.column("text").is_null())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p, mask=none), pa.array(p >= cut, mask=none)], names=["doc_id", "score", "keep"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) of every row; score is the probability of good text. A null text has nulls, a text
    without words, an empty one included, scores 0. A score equal to the cut keeps. Null ids stay null, repeated rows and
    texts under one id are each scored, long texts whole, an empty table gives an empty one, and other columns are not
    looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge(shared, cut), OUT)
