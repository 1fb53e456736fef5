"""Sources and sinks of labelled texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TEXT, LABEL = "comment_text", "label"


@dataclass(frozen=True)
class Source:
    """Where labelled texts come from and how their labels are derived; see ``plans.prepare``."""

    path: str = ""
    format: str = "parquet"
    labels: str = "label"
    text_col: str | None = None
    max_rows: int | None = None


#: Ready-made sources by name: how their labels are derived. Paths are the caller's.
PRESETS: dict[str, Source] = {
    "pairs": Source(labels="pairs"),
    "multi_label": Source(labels="toxic_columns", text_col="comment_text"),
    "score": Source(labels="toxicity", text_col="text"),
    "binary": Source(labels="label", text_col="text"),
    "binary_comment": Source(labels="label", text_col="comment_text"),
}


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of rows given in code. It is sent as Arrow data, which no Python worker needs to read."""
    kind = StructType.fromDDL(schema)
    columns = {f.name: [r[k] for r in rows] for k, f in enumerate(kind)}
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(kind)), kind)


def read(spark: SparkSession, source: Source) -> DataFrame:
    reader = spark.read
    return reader.csv(source.path, header=True, inferSchema=True, multiLine=True, escape='"') if source.format == "csv" else reader.format(source.format).load(source.path)


def write_training_csv(df: DataFrame, path: str) -> None:
    """(comment_text, label) as CSV with a header; quotes inside texts are doubled."""
    df.select(TEXT, LABEL).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """A training table as (text, label)."""
    rows = spark.read.schema(f"{TEXT} string, {LABEL} int").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumnRenamed(TEXT, "text")
