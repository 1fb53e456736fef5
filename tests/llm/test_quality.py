import itertools
import random

import numpy as np
import pyarrow as pa
from lexsieve.llm import _text as X
from lexsieve.llm import quality


def corpus(words, n=900, seed=6):
    r = random.Random(seed)
    rows = []
    words = words[:64]
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(15, 150))]
        kind = k % 9
        if kind == 0:
            w = [x for x in w[:8] for _ in range(9)]
        elif kind == 1:
            w = [y for x in w for y in (x, "|")]
        elif kind == 2:
            w = [x + r.choice(["***", "###", "%%%"]) for x in w]
        elif kind == 3:
            w = [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w), kind >= 4))
    return rows


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20000) < 0.2
    m = len(quality.LABELLERS)
    miss = np.linspace(0.2, 0.7, m)
    votes = np.where(rng.random((20000, m)) < np.where(bad[:, None], 1 - miss, 0.02), 0, 1)
    pattern, n = np.unique((votes * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
    share, table, post = quality.estimate(pattern, n.astype(float))
    assert abs(share - 0.2) < 0.01
    assert np.abs(table[1, :, 0] - (1 - miss)).max() < 0.03 and np.abs(table[0, :, 0] - 0.02).max() < 0.01


def test_held_out_accuracy_without_labels(spark, words):
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model, rates = quality.train(docs.where("doc_id < 600"))
    assert all(good < 0.05 for good, _ in rates.values())
    got = quality.score(docs.where("doc_id >= 600"), model).toPandas().set_index("doc_id")
    truth = {i: g for i, _, g in rows}
    assert np.mean([bool(got.keep[i]) == truth[i] for i in got.index]) > 0.97
    assert not [i for i in got.index if truth[i] and not got.keep[i]]


def test_sample_at_any_size():
    """The hash range holds a fifth more than the sample, whatever the total."""
    for total in (1, 20_000, 10**6, 10**9, 2 * 10**10, 10**11, 10**13):
        share = (quality._highest(total, 20_000) + (1 << 63)) / (1 << 64)
        assert share == min(1 - 2.0**-64, 24_000 / total) or abs(share * total - 24_000) < 1


def shapes(text):
    """Features of a text, found word by word."""
    w = [x.encode() for x in text.split()]
    kind = lambda c: "a" if chr(c).islower() and c < 128 or c >= 128 else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else chr(c)
    shape = ["".join(k for k, _ in itertools.groupby(map(kind, x))) for x in w]
    return w, shape, list(zip(shape[:-1], shape[1:], strict=True)), sum(x == y for x, y in zip(w[:-1], w[1:], strict=True))


def test_scores_against_brute_force(words):
    """The score is a logistic sum over shapes, their pairs, repeats and nine stepped statistics, summed here in Python."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.DIMENSION), 0.3)
    texts = [t for _, t, _ in corpus(words, 40)] + ["one", "a a a a", "Ab3 é! ab3 É!", ""]
    got = model.score(pa.array(texts))
    bucket = lambda h: int(h) % quality.DIMENSION
    for text, p in zip(texts, got, strict=True):
        w, shape, pairs, repeats = shapes(text)
        if not w:
            assert p == 0
            continue
        h = {s: int(X.prefix_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)]))[0]) for s in set(shape)}
        pair = lambda a, b: int(X.mix(np.array([h[b]], np.uint64) + X.mix(np.array([h[a]], np.uint64)))[0])  # noqa: B023, E731
        z = model.bias + sum(model.weights[bucket(h[s])] for s in shape) / len(w) + sum(model.weights[bucket(pair(*x))] for x in pairs) / len(w) + repeats * model.weights[12345 % quality.DIMENSION] / len(w)
        stats = quality._Words(pa.array([text])).stats()
        for k, (name, bad, good) in enumerate(quality.LABELLERS):
            step = int(np.clip(np.floor(4 * stats[name][0] / max(bad, good)), 0, 12))
            z += 0.25 * model.weights[bucket(X.mix(np.array([step + 100 * k + 777], np.uint64))[0])]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9


def test_ids_that_are_null_or_repeated(spark, words):
    """The model depends on the rows alone, not on their order, whatever their ids."""
    docs = spark.createDataFrame([(None if k % 2 else k % 10, t) for k, t, _ in corpus(words, 200)], "doc_id long, text string")
    a, b = quality.train(docs, max_sample=50)[0], quality.train(docs.repartition(5).orderBy("text"), max_sample=50)[0]
    assert np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias) and a.weights.any()


def test_odd_rows(spark, odd, nothing, words):
    model, _ = quality.train(spark.createDataFrame(corpus(words, 300), "doc_id long, text string, good boolean").select("doc_id", "text").unionByName(odd.select("doc_id", "text")))
    got = quality.score(odd, model).toPandas()
    assert len(got) == odd.count()
    assert got[got.doc_id == 3].keep.isna().all() and (got[got.doc_id == 4].score == 0).all()
    empty, _ = quality.train(nothing)
    assert quality.score(odd, empty).where("keep").count() == 0 and quality.score(nothing, model).count() == 0
