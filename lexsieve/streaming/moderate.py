"""Moderation of streams: verdicts depend on their row alone, so a stream takes the batch plan as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.moderator import Moderator


def moderated(stream: DataFrame, moderator: Moderator, mask: str = "*", text: str = "text") -> DataFrame:
    """``stream`` with found, censored and status; stateless, append mode."""
    out = moderator.censor(stream, mask, text)
    return out.withColumn("status", F.when(F.col("found"), "BLOCKED").when(~F.col("found"), "OK"))


def hit_rate(stream: DataFrame, moderator: Moderator, time: str, width: str = "10 minutes", late: str = "20 minutes", text: str = "text") -> DataFrame:
    """(start, texts, hits) in tumbling windows of event time, late rows dropped behind the watermark (an extension)."""
    found = moderator.detect(stream, text).withWatermark(time, late)
    rate = found.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.coalesce(F.col("found").cast("long"), F.lit(0))).alias("hits"))
    return rate.select(F.col("window.start").alias("start"), "texts", "hits")
