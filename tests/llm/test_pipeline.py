import random

import corpus_pipeline
import pytest
from lexsieve.llm import decontamination, ngram_jaccard, pii, sentencepiece_codec
from pyspark.sql import functions as F
from test_decontamination import brute
from test_ngram_jaccard import groups

#: Names that the stages give inside.
INSIDE = ("of", "key", "row_key", "place", "in_group", "no_id", "lang", "source")


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """A small corpus: toxic texts, near copies, leaks, personal data, odd rows, and columns that documents don't have."""
    r = random.Random(12)
    d = tmp_path_factory.mktemp("sf")
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(4)]
    rows, labels = [], []
    for k in range(400):
        w = [r.choice(words) for _ in range(r.randint(30, 90))]
        if k % 8 == 0:
            w[5:5] = ["snarkful", "blorbish", "snarkful"]
        if k % 10 == 1:
            w[9:9] = items[k % 4][1].split()
        if k % 7 == 2:
            w.insert(3, f"x.{k}@mail.example.com")
        rows.append((k, " ".join(w)))
        if k % 10 == 4:
            rows.append((1000 + k, " ".join([*w[:12], "zzz", *w[13:]])))
        labels.append((k, int(k % 8 == 0)))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (2000, None), (2001, ""), (None, None)]
    docs = [(i, t, "en", f"src{k % 3}", len(t or ""), "extra") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, group_id string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "pii", "sentencepiece"]

    a = corpus_pipeline.cut(stages["toxicity"](spark, docs, folder))
    toxic = {k for k in range(400) if k % 8 == 0}
    assert a.columns == names and ids(a) == [i for i in ids(docs) if i not in toxic and i is not None and i - 1000 not in toxic] + [None, None]

    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = corpus_pipeline.cut(stages["near duplicates"](spark, a, folder))
    drop = {i for i, g in groups(rows, ngram_jaccard.N, ngram_jaccard.THRESHOLD) if i != g}
    want = sorted({i for i, _ in rows if i is not None and i not in drop}) + [None, None]
    assert b.columns == names and ids(b) == want and len(drop) > 20

    rows = [(r.doc_id, r.text) for r in b.collect() if r.doc_id is not None and r.text is not None]
    c = corpus_pipeline.cut(stages["decontamination"](spark, b, folder))
    leaked = {d for d, *_ in brute(rows, items, decontamination.MIN_MATCH, decontamination.MIN_COVERAGE)}
    assert c.columns == names and ids(c) == [i for i in ids(b) if i not in leaked] and len(leaked) > 20

    d = corpus_pipeline.cut(stages["pii"](spark, c, folder))
    before = {(r.doc_id, r.text): r for r in c.collect()}
    model = pii.train()
    redacted = sorted(str((i, t and pii.redact(t, pii.find(model, t)))) for i, t in before)
    assert d.columns == names and sorted({str((r.doc_id, r.text)) for r in d.collect()}) == sorted(set(redacted))
    assert d.where("text like '%@mail%'").count() == 0 and d.where("text like '%[EMAIL]%'").count() > 10
    assert d.where("n_chars != char_length(text)").count() == 0

    e = stages["sentencepiece"](spark, d, folder)
    texts = {r.doc_id: r.text for r in d.where("doc_id is not null").collect()}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(e).where("doc_id is not null").collect()}
    assert texts == back
    assert ids(corpus_pipeline.run(spark, folder)) == ids(e)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_clashing_names(spark, odd, words, tmp_path):
    """Every stage over rows with nulls, long texts, repeats, and columns named as those that the stages use inside."""
    names = [c for c in odd.columns if c not in ("doc_id", "text")]
    assert {"gone", "node", "of", "key", "row_key", "place"} <= {*names, *INSIDE}
    docs = odd.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), *names, *(F.lit("?").alias(c) for c in INSIDE if c not in names))
    labels = [(k, 0, 0) for k in range(12)]  # nothing is toxic
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.dtypes == before.dtypes, name
    # of 1, 1, 2 and 11 one row stays
    assert ids(docs) == ids(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))) == [1, *range(3, 11), None, None]
    assert docs.where("text is null").count() == 2


def test_two_texts_under_one_id_and_null_ids(spark, words, tmp_path):
    r = random.Random(8)
    a, b, c, clean, item = (" ".join(r.choice(words) for _ in range(60)) for _ in range(5))
    near = lambda t: " ".join([*t.split()[:20], "zzz", *t.split()[21:]])
    leak = f"{clean[:50]} {item}"
    rows = [(3, a), (7, near(a)), (7, near(b)), (9, b), (5, clean), (5, b), (6, clean + " tail"), (None, c), (None, c), (None, near(c)), (None, leak), (8, leak + " more"), (8, a[::-1]), (None, None), (None, "!"), (None, "!")]
    docs = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, gone string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda d: sorted(((x.doc_id, x.text) for x in d.collect()), key=str)
    got = stages["near duplicates"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    one = [x for x in left(got) if x[1] in (c, near(c))]
    assert len(one) == 1 and one[0][0] is None
    # b has its copy under 5, a under 3; 7 loses both of its texts and 9 its only one
    rest = [(3, a), (5, clean), (5, b), (None, leak), (8, a[::-1]), (None, None), (None, "!"), (None, "!")]
    assert [x for x in left(got) if x not in one and x != (8, leak + " more")] == sorted(rest, key=str)
    gone = [(None, leak), (8, leak + " more")]
    assert left(stages["decontamination"](spark, docs, str(tmp_path))) == sorted((x for x in rows if x not in gone), key=str)
    # an id that bridges two groups leaves one text of each
    bridge = spark.createDataFrame([(3, a), (7, near(a)), (7, near(b)), (9, b)], "doc_id long, text string")
    assert left(stages["near duplicates"](spark, bridge, str(tmp_path))) == sorted([(3, a), (7, near(b))], key=str)
