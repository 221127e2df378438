"""Model-backed operators behind a small protocol, with a deterministic stand-in."""

from __future__ import annotations

import hashlib
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scores

LIMIT = 32_000  # characters of a text that a prompt takes
PROMPTS = {
    "quality": "Rate the quality of this code from 0 to 9. Answer with one digit.",
    "educational": "Rate the educational value of this code from 0 to 9. Answer with one digit.",
    "complexity": "Rate the complexity of this code from 0 to 9. Answer with one digit.",
}


class Backend(Protocol):
    def generate(self, prompts: list[str], n: int = 1, max_tokens: int = 1) -> list[list[str]]: ...


class HashBackend:
    """One digit from the md5 of a prompt; stands in where there is no model."""

    def generate(self, prompts: list[str], n: int = 1, max_tokens: int = 1) -> list[list[str]]:
        return [[str(int(hashlib.md5(f"{p}{i or ''}".encode()).hexdigest()[:8], 16) % 10) for i in range(n)] for p in prompts]


def annotate(df: DataFrame, kind: str = "quality", column: str = "code", backend: Backend | None = None) -> DataFrame:
    """df with the column score: the backend's one token for each prompt, a batch at a time."""
    system, backend = PROMPTS[kind], backend or HashBackend()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in backend.generate([f"{system}\n{t}" for t in s])])

    return df.withColumn("score", run(F.substring(F.coalesce(F.col(column), F.lit("")), 1, LIMIT)))


def synthesize(df: DataFrame, mode: str, column: str = "seed", n: int = 1, backend: Backend | None = None) -> DataFrame:
    """df x n completions, flattened: (position, prompt, completion). Modes: prompt, similar, augment, tests."""
    # fixed values: how each mode asks
    asks = {"prompt": "Write a programming task about: ", "similar": "Write a task similar to these: ", "augment": "Rewrite this task: ", "tests": "Write pytest tests for this code: "}
    head, backend = asks[mode], backend or HashBackend()

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(backend.generate(list(s), n))

    asked = df.withColumn("prompt", F.concat(F.lit(head), F.col(column)))
    return asked.select("*", F.posexplode(run(F.col("prompt"))).alias("position", "completion"))


def fit_regressor(df: DataFrame, features: str, label: str, predicted: str = "predicted"):
    """A linear score over an array column of features; returns (model, function df -> df with predictions)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    vectors = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"), F.col(label).cast("double").alias("_y"))
    model = LinearRegression(featuresCol="_v", labelCol="_y", predictionCol=predicted, regParam=0.01).fit(vectors)
    return model, lambda d: model.transform(d.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))).drop("_v")


def evaluate_regressor(df: DataFrame, predicted: str, label: str, classes: int) -> tuple[DataFrame, DataFrame]:
    """(mse and accuracy, confusion of the rounded predictions)."""
    rounded = df.withColumn("_c", F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.rint(predicted).cast("int"))))
    return scores.regression_metrics(df, predicted, label, classes), scores.confusion(rounded, label, "_c")
