"""The corpus pipeline: toxicity, near duplicates, decontamination, PII and tokens, in this order.

Each stage takes (spark, docs, sf_dir) and gives what the next one works on; all but the last keep the columns of
``docs``, whatever they are. A stage decides on the row itself or on its text: of two texts under one doc_id each has
its own verdict, but for texts in no group in the near-duplicate stage (see there). Texts and rows are told apart by
64-bit hashes made inside the stage. Rows without a doc_id leak like others and are near duplicates of one another, but
stay beside a copy that has a doc_id. Rows with a null text pass the near-duplicate stage and decontamination. Rows that
repeat one doc_id and text count as one document and leave the near-duplicate stage as one row. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsieve.llm import decontamination, ngram_jaccard, pii, sentencepiece_codec, toxicity
from lexsieve.llm._spark import ID_BYTES, cut, maybe_broadcast

#: SQL can't express the models of stages 1, 4 and 5; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _text_key(docs: DataFrame) -> Column:
    """A 64-bit hash of the text, null where the text is null or has no word: what a verdict on a text is passed on by."""
    return F.when(docs["text"].rlike("[0-9A-Za-z]|[^\\x00-\\x7f]"), F.xxhash64(docs["text"]))


def _row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of doc_id and text; null for a row that has neither a doc_id nor a word."""
    return F.when(docs["doc_id"].isNotNull() | _text_key(docs).isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), docs["text"]))


def _having(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose key is (left_semi) or isn't (left_anti) in ``keys``, a table of one column, ``gone``."""
    return docs.join(maybe_broadcast(keys, ID_BYTES), key == keys["gone"], how)


def _without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of these keys."""
    return _having(docs, key, cut(keys.distinct()), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorization machine calls toxic. It is trained on the stage's own documents and the labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the least doc_id of each group of texts that are near duplicates, and of repeated rows one.

    Groups are of texts, so of a doc_id's rows that are in groups each stays or goes by itself, and no group is emptied.
    A text in no group still goes where another row of its doc_id does. Of a group's rows without a doc_id one stays
    too, whether or not the group has a row with one.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(docs).alias("key"), _row_key(docs).alias("row_key")).where("row_key is not null"))
    # each text is judged once: those that stand in several rows are collected, the others taken from their row
    often = cut(rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("gone")))
    texts = docs.where(_text_key(docs).isNotNull()).select(_text_key(docs).alias("key"), "text")
    once = _having(texts, texts["key"], often, "left_anti")
    if not often.isEmpty():
        once = once.unionByName(cut(_having(texts, texts["key"], often, "left_semi").groupBy("key").agg(F.min("text").alias("text"))))
    found = cut(ngram_jaccard.near_duplicates(once, id_col="key").select(F.col("doc_id").alias("in_group"), "group_id"))
    judged = rows.where("key is not null").join(found, F.col("key") == F.col("in_group"), "left").select("doc_id", "row_key", F.coalesce("group_id", "key").alias("of"))
    judged = cut(judged.distinct())
    first = judged.groupBy("of", F.isnull("doc_id").alias("no_id")).agg(F.min(F.struct("doc_id", "row_key")).alias("x"))
    lost = cut(judged.join(first.select("x.row_key"), "row_key", "left_anti").select("doc_id", F.col("row_key").alias("gone")))
    alone = judged.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("row_key").alias("gone")).where("n = 1")
    # test_each_stage_against_brute_force asks that a text in no group goes where its doc_id loses another row
    named = alone.join(lost.select("doc_id").distinct(), "doc_id", "left_semi").select("gone")
    kept = _without(docs, _row_key(docs), lost.select("gone").unionByName(named))
    twice = cut(rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row_key").alias("gone")))
    if twice.isEmpty():
        return kept
    # only the few rows that repeat are sorted
    again = _having(kept, _row_key(kept), twice, "left_semi")
    names = docs.columns
    order = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in names if c not in ("doc_id", "text")]
    rank = again.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order or [F.lit(1)])).alias("place"))
    one = rank.where("place = 1").select("row.*")
    return _without(kept, _row_key(kept), twice).unionByName(one)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a benchmark item, in one passage or several in any order, whatever their doc_id."""
    texts = docs.select(_text_key(docs).alias("key"), "text")
    found = decontamination.leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _without(docs, _text_key(docs), found.select(F.col("doc_id").alias("gone")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by their types; n_chars follows."""
    return pii.replace_in(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each document left."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", leaks),
    ("pii", private),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
