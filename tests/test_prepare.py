from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from lexsieve.functions.canonical import Flags
from lexsieve.operators.moderator import Moderator
from lexsieve.plans import prepare as P
from lexsieve.plans import score as S
from lexsieve.plans.queries import QUERIES
from lexsieve.sources.folders import app_dir
from lexsieve.sources.lexicon import Lexicon
from lexsieve.sources.tables import PRESETS, Source, read, read_training_csv, write_training_csv
from lexsieve.streaming.moderate import hit_rate, moderated
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def rows(df):
    return sorted((r.comment_text, r.label) for r in df.select("comment_text", "label").collect())


def test_labels(spark):
    order = F.col("k")
    df = spark.createDataFrame([(0, "abc", 0.5, 1, 0), (1, "abd", None, 0, 0), (2, "abe", 0.49, 0, 1), (3, None, 1.0, 1, 1), (4, " x ", 1.0, 1, 1)], "k int, text string, toxicity double, toxic int, insult int")
    assert rows(P.prepare(df, "toxicity", order)) == [("abc", 1), ("abd", 0), ("abe", 0)]
    assert rows(P.prepare(df, "toxic_columns", order)) == [("abc", 1), ("abd", 0), ("abe", 1)]
    assert rows(P.prepare(df.withColumn("label", F.col("insult")), "label", order, min_length=1)) == [(" x ", 1), ("abc", 0), ("abd", 0), ("abe", 1)]
    with pytest.raises(ValueError):
        P.prepare(df.select("k"), "label", order)
    with pytest.raises(ValueError):
        P.prepare(df, "other", order)


def test_pairs_toxic_first(spark):
    df = spark.createDataFrame([(0, "same", "same"), (1, "bad one", "good one"), (2, "good one", None)], "k int, toxic string, detox string")
    assert rows(P.prepare(df, "pairs", F.col("k"))) == [("bad one", 1), ("good one", 1), ("same", 1)]


def test_union_keeps_the_first_source(spark):
    a = P.prepare(spark.createDataFrame([(0, "aaa", 1), (1, "aaa", 0), (2, "bbb", 0)], "k int, text string, label int"), "label", F.col("k"))
    b = P.prepare(spark.createDataFrame([(0, "bbb", 1), (1, "ccc", 1)], "k int, text string, label int"), "label", F.col("k"))
    assert rows(P.union([a, b])) == [("aaa", 1), ("bbb", 0), ("ccc", 1)] and rows(P.union([b, a])) == [("aaa", 1), ("bbb", 1), ("ccc", 1)]
    with pytest.raises(ValueError):
        P.union([])


@pytest.mark.parametrize(("share", "total", "want"), [(0.3, None, (10, 23)), (0.5, None, (10, 10)), (0, None, (10, 90)), (0.05, None, (10, 90)), (0.3, 20, None)])
def test_balance(spark, share, total, want):
    df = spark.createDataFrame([(f"text {k}", int(k < 10)) for k in range(100)], "comment_text string, label int")
    got = P.balance(df, share, total)
    counts = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert (counts.get(1, 0), counts.get(0, 0)) == want if want else sum(counts.values()) == total
    assert rows(got) == rows(P.balance(df.repartition(3), share, total))


def test_sample_takes_the_first_of_the_order(spark, monkeypatch):
    import hashlib

    texts = [f"text {k}" for k in range(3000)]
    df = spark.createDataFrame([(t, len(t) % 2) for t in texts], "comment_text string, label int").repartition(5)
    want = sorted(texts, key=lambda t: (hashlib.md5(f"{t}42".encode()).hexdigest(), t))
    for n in (0, 1, 50, 1500, 2999, 3000, 5000):
        assert {r.comment_text for r in P.sample(df, n).collect()} == set(want[:n])
    same = spark.createDataFrame([("x", 1), ("x", 0), ("x", 1)], "comment_text string, label int")
    assert [r.label for r in P.sample(same, 1).collect()] == [0] and P.sample(same, 2).count() == 2


def test_plans_scale(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(k, f"text {k}", k % 2) for k in range(3000)], "k int, text string, label int")
    made = P.prepare(df, "label", F.col("k"))
    assert "HashAggregate" in plan(made) and "SortAggregate" not in plan(made) and "Sort" not in plan(made)
    rows = made.select("comment_text", "label")
    for x in (P.sample(rows, 700), P.balance(rows, 0.6), P.balance(rows, 0.6, 900), P.union([made, made])):
        assert "TakeOrdered" not in plan(x) and "SortAggregate" not in plan(x)


def test_sources_by_name(spark, tmp_path):
    spark.createDataFrame([("so bad", 0.9), ("so good", 0.1), ("both", 0.2), ("x", 1.0)], "text string, toxicity double").coalesce(1).write.parquet(str(tmp_path / "score"))
    spark.createDataFrame([("both", 1), ("new, \"quoted\"", 1), ("new two", 0)], "text string, label int").coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "own"))
    assert rows(P.prepare_preset(spark, "score", str(tmp_path / "score"))) == [("both", 0), ("so bad", 1), ("so good", 0)]
    sources = {"score": replace(PRESETS["score"], path=str(tmp_path / "score")), "own": Source(str(tmp_path / "own"), "csv", "label", max_rows=2)}
    assert len(rows(P.prepare_sources(spark, {"own": sources["own"]}))) == 2
    sources["own"] = replace(sources["own"], max_rows=None)
    want = [("both", 0), ("new two", 0), ('new, "quoted"', 1), ("so bad", 1), ("so good", 0)]
    assert rows(P.prepare_sources(spark, sources)) == want
    assert ("both", 1) in rows(P.prepare_sources(spark, dict(reversed(sources.items()))))
    broken = {"gone": Source(str(tmp_path / "gone")), **sources, "odd": replace(sources["own"], labels="other")}
    with pytest.raises(PySparkException):
        P.prepare_sources(spark, broken)
    with pytest.warns(UserWarning, match="left out"):
        assert rows(P.prepare_sources(spark, broken, skip_failing=True)) == want
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no source"):
        P.prepare_sources(spark, {"gone": broken["gone"]}, skip_failing=True)
    with pytest.raises(KeyError):
        P.prepare_preset(spark, "nothing", "")


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_files_count_in_the_order_of_their_paths(spark, tmp_path, kind):
    path = f"{tmp_path}/a 100% é"
    for k, n in {8: 3, 9: 4000, 10: 300}.items():  # Spark reads the largest file first
        data = [("same text", k), *[(f"text {k} {i}\nend", k) for i in range(n)], (f"text {k} 0\nend", 99), ("later text", k + 1)]
        df = spark.createDataFrame(data, "text string, label int").coalesce(1)
        df.write.option("header", True).option("escape", '"').mode("append").format(kind).save(f"{tmp_path}/{k}")
        (made,) = (tmp_path / str(k)).glob(f"part-*.{kind}")
        Path(path).mkdir(exist_ok=True)
        made.rename(f"{path}/part-{k}.{kind}")
    got = dict(rows(P.prepare_sources(spark, {"x": Source(path, kind, "label", "text")})))
    assert got["same text"] == 8 and got["later text"] == 9 and got["text 9 0\nend"] == 9
    assert len(got) == 2 + 3 + 4000 + 300


def test_sources_are_written_and_read_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = QUERIES["prep_sources"](spark, "/root/testdata/sf0.001")
        for name in ("first", "second"):
            assert len(spark.read.text(f"{app_dir(spark)}/sources/{name}").inputFiles()) > 1
        assert made.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_split_sample_stats(spark):
    df = spark.createDataFrame([(f"text {k}", k % 2) for k in range(1000)], "comment_text string, label int")
    parts = {r.part: r["count"] for r in P.split(df).groupBy("part").count().collect()}
    assert 60 < parts["eval"] < 140
    assert P.sample(df, 7).count() == 7 and P.stats(df).first().asDict() == {"rows": 1000, "toxic": 500, "share": 0.5}
    assert P.accuracy(df.withColumn("said", F.lit(1)), "said", "label").first().accuracy == 0.5


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", text', 1), ("two\nlines", 0)], "comment_text string, label int")
    write_training_csv(df, str(tmp_path / "t"))
    assert sorted((r.text, r.label) for r in read_training_csv(spark, str(tmp_path / "t")).collect()) == sorted(map(tuple, df.collect()))
    assert read(spark, Source(str(tmp_path / "t"), "csv")).count() == 2 and len(PRESETS) == 5


def test_scores(spark):
    data = [(k, f"{'awful horrid' if k % 2 else 'kind gentle'} word{k % 7}", k % 2) for k in range(200)]
    df = spark.createDataFrame(data, "id int, text string, label int")
    scored = S.decide(S.score_fallback(S.fit_fallback(df.where("id < 150")), df.where("id >= 150")))
    assert P.accuracy(scored, "toxic", "label").first().accuracy == 1
    made = S.score_with(df.unionByName(spark.createDataFrame([(999, None, 0)], df.schema)), lambda: lambda texts: [float("awful" in t) for t in texts])
    assert made.where("prob != label").count() == 0 and made.where("id = 999").first().prob is None
    routed = S.hybrid(df.where("id < 6").withColumn("s", F.get(F.array(*[F.lit(x) for x in (0.5, 0.89, 0.9, 0.95, 0.99, 1.0)]), F.col("id"))), "s", lambda d: d.withColumn("prob", F.lit(0.7)))
    assert {r.id: r.blocked for r in routed.collect()} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True}


def _field(number, body):
    """A length-delimited protobuf field; an int becomes a varint."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(body, int):
        return varint(number << 3) + varint(body)
    body = body.encode() if isinstance(body, str) else body
    return varint(number << 3 | 2) + varint(len(body)) + body


def two_class_model(weights):
    """An ONNX graph: logits are the mean of the rows of ``weights`` that the ids name, padding left out."""
    tensor = lambda name, kind, dims, raw: b"".join(_field(1, d) for d in dims) + _field(2, kind) + _field(8, name) + _field(9, raw)
    value = lambda name, kind, dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, d)) for d in dims))))
    node = lambda op, inputs, out, *attributes: b"".join(_field(1, x) for x in inputs) + _field(2, out) + _field(4, op) + b"".join(_field(5, a) for a in attributes)
    number = lambda name, v: _field(1, name) + _field(3, v) + _field(20, 2)
    nodes = [
        node("Gather", ["w", "input_ids"], "rows"),
        node("Cast", ["attention_mask"], "mask", _field(1, "to") + _field(3, 1) + _field(20, 2)),
        node("Unsqueeze", ["mask", "last"], "wide"),
        node("Mul", ["rows", "wide"], "kept"),
        node("ReduceSum", ["kept", "one"], "sum", number("keepdims", 0)),
        node("ReduceSum", ["wide", "one"], "n", number("keepdims", 0)),
        node("Div", ["sum", "n"], "logits"),
    ]
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g")
    graph += _field(5, tensor("w", 1, weights.shape, weights.astype("<f4").tobytes())) + _field(5, tensor("last", 7, [1], np.array([2], "<i8").tobytes())) + _field(5, tensor("one", 7, [1], np.array([1], "<i8").tobytes()))
    graph += b"".join(_field(11, value(x, 7, ["batch", "length"])) for x in ("input_ids", "attention_mask")) + _field(12, value("logits", 1, ["batch", "two"]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_onnx_scores_end_to_end(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {"[PAD]": 0, "[UNK]": 1, "awful": 2, "kind": 3}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    weights = np.array([[9, -9], [0.5, 0], [-2, 3], [2, -1]])
    (tmp_path / "model.onnx").write_bytes(two_class_model(weights))
    texts = ["awful", "kind", "awful kind other", "", "kind " * 128 + "awful " * 500, "awful " * 127 + "kind", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    got = {r.id: r.prob for r in S.score_with(df, S.onnx_scorer(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"))).collect()}

    def softmax(ids):
        e = np.exp(weights[ids].mean(axis=0))
        return e[1] / e.sum()

    ids = [[2], [3], [2, 3, 1], None, [3] * 128, [2] * 127 + [3]]  # only the first 128 tokens count
    assert all(got[k] == pytest.approx(softmax(x), abs=1e-5) for k, x in enumerate(ids) if x) and got[6] is None
    assert {r.id for r in S.decide(S.score_with(df.where("id in (0, 1)"), S.onnx_scorer(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json")))).where("toxic").collect()} == {0}


def test_onnx_scorer_is_built_in_workers():
    make = S.onnx_scorer("/nowhere/model.onnx", "/nowhere/tokenizer.json")
    with pytest.raises(Exception, match="nowhere|exist|File"):
        make()


def test_stream_equals_batch(spark, tmp_path):
    m = Moderator(Lexicon.from_mapping(spark, {"aa": "bad"}, Flags()))
    batch = spark.createDataFrame([(k, f"2024-01-01 00:{k:02}:00", "so bad" if k % 3 == 0 else None if k == 4 else "fine") for k in range(30)], "id int, at string, text string").withColumn("at", F.to_timestamp("at"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = moderated(stream, m).writeStream.format("memory").queryName("t_moderated").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("t_moderated").collect())) == sorted(map(str, moderated(batch, m).collect()))
    q = hit_rate(stream, m, "at").writeStream.format("memory").queryName("t_rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.texts, r.hits) for r in spark.table("t_rate").collect()) == [(10, 3), (10, 3), (10, 4)]
