import numpy as np
import pytest
from lexsieve.llm import ann


def recall(got, ids, x, queries, q, own):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    hit = 0
    for name, v in zip(queries, q, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        if own:
            d[ids == name] = np.inf
        rows = sorted(by[name], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11)) and all(abs(r.distance - d[ids == r.neighbour_id][0]) < 1e-4 for r in rows)
        hit += sum(r.distance <= np.sort(d)[9] + 1e-5 for r in rows)
    return hit / (10 * len(queries))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24)) * 1.5
    x = (centres[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 24))).astype(np.float32)
    return np.arange(1500), x, spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_recall_of_all_rows_and_of_new_queries(spark, data):
    ids, x, df = data
    graph = ann.build(df, block=64)
    assert recall(ann.search(graph).collect(), ids, x.astype(float), ids, x.astype(float), True) > 0.9
    q = x[:60] + np.float32(0.1)
    queries = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(q)], "vec_id long, embedding array<float>")
    found = []
    for limit in (ann.BROADCAST_BYTES, 0):
        got = ann.search(graph, queries, broadcast_bytes=limit).collect()
        assert recall(got, ids, x.astype(float), range(60), q.astype(float), False) > 0.9
        found.append(sorted(map(tuple, got)))
    assert found[0] == found[1]


def test_both_walks_agree_on_ties_and_equal_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (200, 3)).astype(float)  # many equal vectors and equal distances
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    graph = ann.cut(ann.build(df, degree=8, block=16))
    for queries in (None, df.where("vec_id < 20")):
        got = [sorted(map(tuple, ann.search(graph, queries, beam=12, k=5, broadcast_bytes=b, only=list(range(40)) if queries is None else None).collect())) for b in (ann.BROADCAST_BYTES, 0)]
        assert got[0] == got[1] and got[0]


def test_a_block_of_equal_vectors_is_cut(spark):
    rows = [(k, b"\0" * 8, 5 if k < 900 else 6) for k in range(910)]
    placed = ann._salted(spark.createDataFrame(rows, "id long, vec binary, block int"), 16)
    sizes = {(r.block, r.salt): r["count"] for r in placed.groupBy("block", "salt").count().collect()}
    assert sizes.pop((6, 0)) == 10 and sum(sizes.values()) == 900 and len(sizes) == 15 and max(sizes.values()) < 128
    df = spark.createDataFrame([(k, [1.0, 2.0] if k < 600 else [float(k), 0.0]) for k in range(620)], "vec_id long, embedding array<float>")
    got = ann.search(ann.build(df, degree=8, block=16), k=3).collect()
    assert len(got) == 3 * 620 and all(r.distance == 0 for r in got if r.vec_id < 600)


def test_odd_rows(spark):
    rows = [(k, [float(k), 1.0]) for k in range(5)] + [(k, [9.0, 9.0]) for k in range(10, 40)] + [(3, [3.0, 1.0]), (3, [4.0, 7.0]), (None, [1.0, 1.0]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<float>, block int, nbr string")
    got = ann.search(ann.build(df), k=3).collect()
    assert {r.vec_id for r in got} == {*range(5), *range(10, 40)}
    assert [(r.neighbour_id, r.distance) for r in sorted(got, key=lambda r: r.rank) if r.vec_id == 0][:2] == [(1, 1.0), (2, 2.0)]
    assert all(r.distance == 0 for r in got if r.vec_id >= 10) and all(r.vec_id != r.neighbour_id for r in got)
    assert ann.search(ann.build(df.where("false"))).count() == 0
    assert ann.search(ann.build(df.where("vec_id = 0"))).count() == 0
    queries = df.where("vec_id is null or vec_id in (0, 50, 51, 52)")
    assert {r.vec_id for r in ann.search(ann.build(df), queries, k=2).collect()} == {0}


def test_degree_and_beam_grow_until_recall_holds(data):
    ids, x, df = data
    x = x.astype(float)
    few = ann.build(df, degree=5)
    assert recall(ann.search(few, beam=11).collect(), ids, x, ids, x, True) < 0.85
    exact = ann.truth(few)
    d = np.sqrt(((x[:, None] - x[[*exact]][None]) ** 2).sum(axis=2))
    assert len(exact) == ann.SAMPLE and np.allclose(np.sort(d, axis=0)[1:11].T, [*exact.values()], atol=1e-4)
    assert recall(ann.neighbours(df, degree=5, beam=11).collect(), ids, x, ids, x, True) > 0.9
