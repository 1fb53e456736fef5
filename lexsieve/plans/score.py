"""Toxicity scores by a pluggable model, a built-in fallback, and routing by rule and score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes texts, returns the probability that each is toxic.
Scorer = Callable[[list[str]], list[float]]


def score_with(df: DataFrame, make: Callable[[], Scorer], text: str = "text") -> DataFrame:
    """``df`` with ``prob`` from a scorer that ``make`` builds once in each worker; null for a null text."""

    @F.pandas_udf("double")
    def prob(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for texts in batches:
            have = texts.notna()
            out = pd.Series(np.nan, index=texts.index, dtype="float64").astype(object).where(have, None)
            if have.any():
                out[have] = scorer(texts[have].tolist())
            yield out.astype("float64")

    return df.withColumn("prob", F.when(F.col(text).isNotNull(), prob(text)))


def onnx_scorer(model_path: str, tokenizer_path: str, max_tokens: int = 128) -> Callable[[], Scorer]:
    """Builds scorers of an ONNX sequence classifier of two classes with its tokenizer's JSON file."""

    def make() -> Scorer:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_tokens)
        tokenizer.enable_padding()
        names = {i.name for i in session.get_inputs()}

        def score(texts: list[str]) -> list[float]:
            encoded = tokenizer.encode_batch(texts)
            feed = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": np.array([e.attention_mask for e in encoded], np.int64)}
            logits = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (e / e.sum(axis=1, keepdims=True))[:, 1].tolist()

        return score

    return make


def fit_fallback(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    """A logistic regression over hashed words, for where no ONNX model is at hand; trained by Spark."""
    stages = [RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\P{IsAlphabetic}+"), HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features, binary=True), LogisticRegression(featuresCol="__tf", labelCol=label, regParam=0.01, probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__said")]
    return Pipeline(stages=stages).fit(train.where(F.col(text).isNotNull()))


def score_fallback(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without rows of null text, with ``prob``; JVM-side."""
    scored = model.transform(df.where(F.col(text).isNotNull())).withColumn("prob", vector_to_array("__prob")[1])
    return scored.drop("__words", "__tf", "__raw", "__prob", "__said")


def decide(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """``df`` with ``toxic``: whether prob reaches the cut."""
    return df.withColumn("toxic", F.col("prob") >= cut)


def hybrid(df: DataFrame, similarity: str, score: Callable[[DataFrame], DataFrame], low: float = 0.90, high: float = 0.99, cut: float = 0.5) -> DataFrame:
    """``df`` with ``blocked``: by rule at ``high`` and above, never below ``low``, by the model in between.

    Only rows in between go through the model.
    """
    sure = df.where(~F.col(similarity).between(low, high) | (F.col(similarity) >= high) | F.col(similarity).isNull()).withColumn("blocked", F.coalesce(F.col(similarity) >= high, F.lit(False)))
    doubtful = score(df.where((F.col(similarity) >= low) & (F.col(similarity) < high)))
    return sure.unionByName(doubtful.withColumn("blocked", F.coalesce(F.col("prob") >= cut, F.lit(False))).select(*sure.columns))
