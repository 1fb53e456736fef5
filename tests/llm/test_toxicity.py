import random

import numpy as np
from lexsieve.llm import toxicity


def corpus(spark, words, n=1500):
    """Toxic: an insult together with a group. Either alone, and long clean texts, are not."""
    r = random.Random(4)
    insults, groups = ["snark", "blorb", "quazz"], ["zilnfolk", "morvites", "tandarians"]
    rows, labels = [], []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        kind = k % 4
        if kind in (0, 1):
            w.insert(r.randint(0, len(w)), r.choice(insults))
        if kind in (0, 2):
            w.insert(r.randint(0, len(w)), r.choice(groups))
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_pairs_on_held_out_rows(spark, words):
    docs, labels = corpus(spark, words)
    model = toxicity.train(docs, labels.where("doc_id < 1200"))
    got = toxicity.score(docs.where("doc_id >= 1200"), model).toPandas()
    truth = got.doc_id % 4 == 0
    assert (got.toxic == truth).mean() > 0.95
    # a linear model with the same weights alone can't separate insult and group from either alone
    linear = toxicity.Model(model.terms, model.w, np.zeros_like(model.v), model.bias, model.cut)
    alone = toxicity.score(docs.where("doc_id >= 1200"), linear).toPandas()
    assert (alone.toxic == truth.values).mean() < (got.toxic == truth).mean()


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    row, col, value = np.repeat(np.arange(6), 4), rng.integers(0, 9, 24), rng.random(24)
    label, weight = np.array([0, 1, 0, 1, 1, 0]), rng.random(6)
    m = toxicity.Model(np.arange(8), rng.normal(size=9), rng.normal(size=(9, 3)), 0.1, 0.5)

    def loss(w, v, b):
        z = toxicity.Model(m.terms, w, v, b, 0.5).raw(row, col, value, 6)
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + 0.01 / 2 * ((w**2).sum() + (v**2).sum()))

    g = toxicity.gradient(m, row, col, value, label, weight, 0.01)
    e = 1e-6
    for k in range(9):
        d = np.eye(9)[k] * e
        assert np.isclose(g[0][k], (loss(m.w + d, m.v, m.bias) - loss(m.w - d, m.v, m.bias)) / (2 * e), atol=1e-6)
        for f in range(3):
            d = np.zeros((9, 3))
            d[k, f] = e
            assert np.isclose(g[1][k, f], (loss(m.w, m.v + d, m.bias) - loss(m.w, m.v - d, m.bias)) / (2 * e), atol=1e-6)
    assert np.isclose(g[2][0], (loss(m.w, m.v, m.bias + e) - loss(m.w, m.v, m.bias - e)) / (2 * e), atol=1e-6)


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    row, col = np.repeat(np.arange(6), 4), rng.integers(0, 9, 24)
    m = toxicity.Model(np.arange(8), rng.normal(size=9), rng.normal(size=(9, 8)), 0.1, 0.5)
    value = rng.random(24)
    z = m.raw(row, col, value, 6)
    for k in range(6):
        x = np.bincount(col[row == k], value[row == k], 9)
        # repeated terms of a row are separate occurrences
        occ = [(c, v) for c, v in zip(col[row == k], value[row == k], strict=True)]
        pairs = sum(occ[i][1] * occ[j][1] * m.v[occ[i][0]] @ m.v[occ[j][0]] for i in range(len(occ)) for j in range(i))
        assert np.isclose(z[k], m.bias + m.w @ x + pairs)


def test_texts_under_one_id_and_ties(spark, words):
    """The model depends on the rows alone, not on their order, with two texts under one id and repeated labels."""
    docs, labels = corpus(spark, words, 300)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat(text, ' another') as text")).unionByName(docs.where("doc_id < 50"))
    labels = labels.unionByName(labels.selectExpr("doc_id", "1 - toxic as toxic").where("doc_id % 10 = 0"))
    a = toxicity.train(docs, labels, max_labelled=200)
    b = toxicity.train(docs.repartition(7).orderBy("text"), labels.repartition(3), max_labelled=200)
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.w, b.w) and a.cut == b.cut
    few = toxicity.train(docs, labels, max_terms=3)
    assert len(few.terms) == 3


def test_odd_rows(spark, odd, nothing, words):
    docs, labels = corpus(spark, words, 200)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")))
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == odd.count() and got[got.doc_id == 3].toxic.isna().all()
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.keep_clean(odd, model).where("text is null").count() == 2
    assert toxicity.score(nothing, model).count() == 0
    constant = toxicity.train(nothing, labels)
    assert not toxicity.score(docs, constant).where("toxic").count()
    assert toxicity.train(docs, labels.where("toxic = 0")).cut == 0.5
