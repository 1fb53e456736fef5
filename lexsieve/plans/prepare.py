"""Training tables from labelled sources: labels, cleaning, union, first-wins deduplication, balancing, splitting."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsieve.sources.tables import LABEL, PRESETS, TEXT, Source, inline, read

TOXIC_COLUMNS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
_TEXT_NAMES = ("comment_text", "text", "comment", "sentence", "content")
_TOXIC_NAMES = ("input", "source", "toxic", "en_toxic_comment", "ru_toxic_comment", "toxic_sentence")
_CLEAN_NAMES = ("output", "target", "detox", "en_neutral_comment", "ru_neutral_comment", "neutral_sentence")


def first_of(df: DataFrame, names: Sequence[str], what: str) -> str:
    """The first of the names that is a column; ValueError if none is."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}")


def stable_order(text: Column, seed: int = 42) -> list[Column]:
    """A pseudo-random order of texts that any engine can repeat."""
    return [F.md5(F.concat(text, F.lit(str(seed)))), text]


#: The type of a row's place in the order of all sources: a fixed-width number, so that its minimum is hash-aggregated.
PLACE = "decimal(38,0)"
_FILE, _HALF, _SOURCE = 1 << 64, 1 << 96, 1 << 98


def _place(order: Column, half: Column) -> Column:
    """The place of a row: first its half, then its number, any long or what ``in_file_order`` gives."""
    return (half.cast(PLACE) * F.lit(str(_HALF)).cast(PLACE) + order.cast(PLACE)).cast(PLACE)


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows``, as read, with ``__place``: first the file, by path with numbers by value, then the row in it.

    Spark reads the parts of a file in their order, but larger files before smaller ones; so row ids say which row of one
    file comes first, not which file.
    """
    files = sorted(rows.inputFiles(), key=lambda path: [int(x) if k % 2 else x for k, x in enumerate(re.split("([0-9]+)", path))])
    rows = rows.withColumn("__place", F.monotonically_increasing_id().cast(PLACE))
    if len(files) < 2:
        return rows
    rank = inline(rows.sparkSession, list(enumerate(files)), "__rank int, __path string")
    rows = rows.withColumn("__file", F.input_file_name()).join(F.broadcast(rank), F.col("__file") == F.col("__path"), "left")
    place = F.col("__rank").cast(PLACE) * F.lit(str(_FILE)).cast(PLACE) + F.col("__place")
    return rows.withColumn("__place", place.cast(PLACE)).drop("__file", "__path", "__rank")


def from_pairs(df: DataFrame, order: Column) -> DataFrame:
    """(comment_text, label, place): the toxic texts of all rows, then the neutral ones, in one scan."""
    a, b = first_of(df, _TOXIC_NAMES, "toxic text"), first_of(df, _CLEAN_NAMES, "neutral text")
    halves = F.inline(F.array(F.struct(F.col(a).cast("string").alias(TEXT), F.lit(1).alias(LABEL)), F.struct(F.col(b).cast("string").alias(TEXT), F.lit(0).alias(LABEL))))
    return df.select(order.alias("row"), halves).select(TEXT, LABEL, _place(F.col("row"), 1 - F.col(LABEL)).alias("place"))


def labelled(df: DataFrame, labels: str, order: Column, text_col: str | None = None) -> DataFrame:
    """(comment_text, label, place) by one of the ways to label: ``label``, ``toxicity``, ``toxic_columns``, ``pairs``.

    ``order``: an integer that says which row comes first.
    """
    if labels == "pairs":
        return from_pairs(df, order)
    text = text_col or first_of(df, _TEXT_NAMES, "text")
    if labels == "label":
        label = F.col("label").cast("int")
    elif labels == "toxicity":
        label = (F.coalesce(F.col(first_of(df, ("toxicity", "toxic"), "toxicity")), F.lit(0)) >= 0.5).cast("int")
    elif labels == "toxic_columns":
        have = [F.col(c) for c in TOXIC_COLUMNS if c in df.columns]
        if not have:
            raise ValueError(f"no label column among {df.columns}")
        label = (F.greatest(*have) if len(have) > 1 else have[0]).cast("int")
    else:
        raise ValueError(f"unknown way to label: {labels}")
    return df.select(F.col(text).cast("string").alias(TEXT), label.alias(LABEL), _place(order, F.lit(0)).alias("place"))


def clean(df: DataFrame, min_length: int = 3, max_length: int = 512) -> DataFrame:
    """Rows whose text, stripped, has a length within both bounds; the text itself stays as it is."""
    return df.where(F.col(TEXT).isNotNull() & F.char_length(F.regexp_replace(TEXT, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")).between(min_length, max_length))


def first_wins(df: DataFrame) -> DataFrame:
    """One row a text, the first by ``place``: minima of fixed-width values, hash-aggregated with a map-side combine."""
    return df.groupBy(TEXT).agg(F.min_by(LABEL, "place").alias(LABEL), F.min("place").alias("place"))


#: Buckets of a pseudo-random order that are counted to find where a sample ends.
BUCKETS = 1 << 16


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in a stable pseudo-random order of texts; all if there are no more.

    Rows are counted by the first four hex digits of their hash. Those of the buckets that are in as a whole pass by a
    filter; only those of the bucket in which the sample ends are ranked. Which of equal texts under several labels stand
    first is decided by the label.
    """
    key, text = stable_order(F.col(TEXT), seed)
    bucket = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    counts = sorted((r["bucket"], r["n"]) for r in df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect())
    taken = 0
    for end, size in counts:
        if taken + size > n:
            break
        taken += size
    else:
        return df
    whole = df.where(bucket < end)
    if taken == n:
        return whole
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(key, text, LABEL))
    last = df.where(bucket == end).withColumn("__place", place).where(F.col("__place") <= n - taken).drop("__place")
    return whole.unionByName(last)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a stable pseudo-random order of texts."""
    return df.orderBy(*stable_order(F.col(TEXT), seed))


def prepare(df: DataFrame, labels: str, order: Column, text_col: str | None = None, min_length: int = 3, max_length: int = 512, max_rows: int | None = None) -> DataFrame:
    """(comment_text, label, place): one source labelled, cleaned, deduplicated and, if asked, sampled."""
    out = first_wins(clean(labelled(df, labels, order, text_col), min_length, max_length))
    return sample(out, max_rows) if max_rows else out


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """(comment_text, label): all prepared sources; of equal texts the one of the earliest source stays."""
    if not parts:
        raise ValueError("no source to combine")
    tagged = [p.select(TEXT, LABEL, (F.col("place") + F.lit(str(k * _SOURCE)).cast(PLACE)).cast(PLACE).alias("place")) for k, p in enumerate(parts)]
    return first_wins(reduce(DataFrame.unionByName, tagged)).select(TEXT, LABEL)


def prepare_sources(spark: SparkSession, sources: Mapping[str, Source], min_length: int = 3, max_length: int = 512, skip_failing: bool = False) -> DataFrame:
    """(comment_text, label): named sources read, labelled, cleaned, capped at their max_rows, and united in their order.

    Rows keep the order they have in their files, and files that of their paths. A source that can't be read or labelled
    raises; with ``skip_failing`` it is left out with a warning, and only if none is left that raises ValueError.
    """
    parts = []
    for name, source in sources.items():
        try:
            rows = in_file_order(read(spark, source))
            parts.append(prepare(rows, source.labels, F.col("__place"), source.text_col, min_length, max_length, source.max_rows))
        except (ValueError, PySparkException) as e:
            if not skip_failing:
                raise
            warnings.warn(f"source {name} left out: {e}", stacklevel=2)
    return union(parts)


def prepare_preset(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """``prepare_sources`` of one preset over the table at ``path``; KeyError for a name that isn't one."""
    return prepare_sources(spark, {name: replace(PRESETS[name], path=path)}, **options)


def balance(df: DataFrame, toxic_share: float = 0.3, max_total: int | None = None, seed: int = 42) -> DataFrame:
    """All toxic rows and as many clean ones as give the share, in a stable order, cut at ``max_total``.

    A share of 0 or less keeps everything.
    """
    counts = {r[LABEL]: r["n"] for r in df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, rest = counts.get(1, 0), counts.get(0, 0)
    wanted = min(int(toxic * (1 - toxic_share) / toxic_share), rest) if toxic_share > 0 else rest
    clean_rows = df.where(F.col(LABEL) == 0)
    both = df.where(F.col(LABEL) == 1).unionByName(sample(clean_rows, wanted, seed) if wanted < rest else clean_rows)
    return shuffled(sample(both, max_total, seed + 1) if max_total else both, seed + 1)


def split(df: DataFrame, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: train for about nine tenths of the texts, eval for the rest, by a hash of the text."""
    digit = F.conv(F.substring(F.md5(F.concat(TEXT, F.lit(str(seed)))), 1, 4), 16, 10).cast("int")
    return df.withColumn("part", F.when(digit % 10 == 0, "eval").otherwise("train"))


def stats(df: DataFrame) -> DataFrame:
    """(rows, toxic, share)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(LABEL).alias("toxic"), F.avg(LABEL).alias("share"))


def accuracy(df: DataFrame, said: str, truth: str) -> DataFrame:
    """(cases, accuracy) of a verdict against a label."""
    return df.agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col(said).cast("int") == F.col(truth)).cast("int")).alias("accuracy"))
