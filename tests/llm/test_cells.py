import numpy as np
from lexsieve.llm import cells
from lexsieve.llm.queries import QUERIES


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def exact(ids, x, every, k=10):
    x = x.astype(np.float32).astype(float)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        d[at] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[at])] = [(r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order) if np.isfinite(d[j])]
    return out


def rows(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    return out


def same(got, want):
    return got.keys() == want.keys() and all(
        [y[:2] for y in got[i]] == [y[:2] for y in want[i]] and np.allclose([y[2] for y in got[i]], [y[2] for y in want[i]], atol=1e-6) for i in want
    )


def test_query_asks_every_fiftieth_row_against_all(spark):
    got = rows(QUERIES["op9_ann"](spark, "/root/testdata/sf0.01"))
    assert set(got) == set(range(0, 500, 50)) and all([x[0] for x in r] == list(range(1, 11)) for r in got.values())
    assert any(x[1] % 50 for r in got.values() for x in r)


def test_recall_and_all_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 24))[rng.integers(0, 20, 6000)] * 1.5 + rng.normal(size=(6000, 24))).astype(np.float32)
    ids = np.arange(6000) - 3000
    df, want = frame(spark, ids, x), exact(ids, x, 10)
    got = rows(cells.neighbours_of(df, every=10, fit=2000))
    assert got.keys() == want.keys() and all(len(r) == 10 for r in got.values())
    assert np.mean([len({y[1] for y in got[i]} & {y[1] for y in want[i]}) / 10 for i in want]) > 0.9
    # all cells probed, and queries in many broadcasts: the true neighbours
    monkeypatch.setattr(cells, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(cells, "SAMPLE", 600)
    assert same(rows(cells.neighbours_of(df, every=10, target=1.0, fit=2000)), want)


def test_odd_rows(spark):
    inf = float("inf")
    same_x = [(k, [9.0, 9.0]) for k in range(100, 900)]  # one cell holds most
    more = [(k, [float(k), 1.0]) for k in range(5)] + same_x
    odd = [(3, [3.0, 1.0]), (3, [4.0, 7.0]), (None, [1.0, 1.0]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (1000, [inf, 1.0])]
    df = spark.createDataFrame([(*r, 1, "y") for r in more + odd], "vec_id long, embedding array<float>, cell int, ids string")
    want = exact(np.array([r[0] for r in more]), np.array([r[1] for r in more]), 50)
    assert same(rows(cells.neighbours_of(df, target=1.0)), want) and len(want) == 17
    assert cells.neighbours_of(df.where("false")).count() == 0 and cells.neighbours_of(df.where("vec_id = 1")).count() == 0
    assert cells.neighbours_of(df.where("vec_id = 0")).count() == 0
    big = frame(spark, range(4), np.array([[1e30, 0.0], [2e30, 0.0], [-3e30, 0.0], [0.0, 0.0]]))
    assert [r[1] for r in rows(cells.neighbours_of(big))[0]] == [1, 3, 2]
