"""A text regressor: hashed words, a linear score; train, test, annotate, save and load.

The model is fitted by Spark ML over all training rows (sums over partitions, no rows on the driver). Null texts are empty;
rows without a label are left out of training and tests, and annotated like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import annotate


@dataclass
class TextRegressor:
    """column: the text; label: what is learned, 0 to classes - 1."""

    column: str = "text"
    label: str = "label"
    classes: int = 2
    buckets: int = 1 << 14
    penalty: float = 1.0
    model: PipelineModel | None = None

    def _given(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_text", F.coalesce(F.col(self.column), F.lit("")))

    def train(self, df: DataFrame) -> TextRegressor:
        rows = self._given(df).where(F.col(self.label).isNotNull()).select("_text", F.col(self.label).cast("double").alias("_label"))
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.buckets, binary=True),
            IDF(inputCol="_counts", outputCol="_features", minDocFreq=2),
            LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="_score", regParam=self.penalty, solver="l-bfgs", maxIter=60),
        ]
        self.model = Pipeline(stages=stages).fit(rows)
        return self

    def annotate(self, df: DataFrame, score: str = "score") -> DataFrame:
        """df with its scores."""
        if self.model is None:
            raise RuntimeError("train or load a model first")
        return self.model.transform(self._given(df)).withColumn(score, F.col("_score")).drop("_text", "_words", "_counts", "_features", "_score")

    def test(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(n, mse and accuracy; confusion of the rounded scores) over labelled rows."""
        scored = self.annotate(df.where(F.col(self.label).isNotNull()), "_predicted")
        return annotate.evaluate_regressor(scored, "_predicted", self.label, self.classes)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> TextRegressor:
        self.model = PipelineModel.load(path)
        return self
