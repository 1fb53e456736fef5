"""Spark helpers shared by the operators: lineage cuts, byte counts, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.sources.folders import app_dir, delete

#: Bytes that may be broadcast; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: What a row of one 8-byte number takes in a broadcast table.
ID_BYTES = 16


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the application's shared folder and read it back, so no executor holds the only copy.

    The folder goes when the driver ends; ``drop`` frees a table earlier.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexsieve_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` gave and that nothing reads any more."""
    delete(df.sparkSession, df._lexsieve_path)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts of ``df``, nulls as 0."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()["n"] or 0)


def maybe_broadcast(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df``, a small plan such as a table read back, marked for broadcast if its bytes are within BROADCAST_BYTES, else
    as it is (a shuffle join follows). ``row_bytes``: of each row alike, or an expression of its size."""
    size = F.sum(row_bytes) if isinstance(row_bytes, Column) else F.count(F.lit(1)) * row_bytes
    return F.broadcast(df) if int(df.agg(size.alias("n")).first()["n"] or 0) <= BROADCAST_BYTES else df
