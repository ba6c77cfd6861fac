"""Estimators other than the built-in linear one: anything that fits a DataFrame and adds a score column."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.learn.blocks import pack
from peptrail.learn.thresholds import Question, accepted


class Scorer(Protocol):
    """A fitted model."""

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """df with a column ``out`` of scores, higher for targets."""


class Estimator(Protocol):
    """Learns to tell class 1 from class 0."""

    def fit(self, df: DataFrame, features: list[str], label: str) -> Scorer: ...


class MLlibEstimator:
    """Any binary classifier of pyspark.ml, with standardised features unless ``scale`` is off."""

    def __init__(self, classifier, scale: bool = True) -> None:  # noqa: ANN001
        self.classifier, self.scale = classifier, scale

    def fit(self, df: DataFrame, features: list[str], label: str) -> MLlibScorer:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        stages = [VectorAssembler(inputCols=features, outputCol="_raw_features", handleInvalid="keep")]
        if self.scale:
            stages.append(StandardScaler(inputCol="_raw_features", outputCol="_features", withMean=True))
        last = self.classifier.copy().setFeaturesCol("_features" if self.scale else "_raw_features").setLabelCol(label)
        return MLlibScorer(Pipeline(stages=[*stages, last]).fit(df.withColumn(label, F.col(label).cast("double"))))


class MLlibScorer:
    def __init__(self, model) -> None:  # noqa: ANN001
        self.model = model

    def score(self, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rated = self.model.transform(df)
        column = "rawPrediction" if "rawPrediction" in rated.columns else "probability"
        value = vector_to_array(F.col(column))[1] if column in rated.columns else F.col("prediction")
        return rated.select(*[F.col(f"`{c}`") for c in df.columns], value.cast("double").alias(out))


def train_fold(rows: DataFrame, estimator: Estimator, features: list[str], target: str, first: tuple[str, bool, float], fdr: float, max_iter: int) -> tuple[Scorer | None, int]:
    """A scorer learned from rows and the targets that it accepts; ``first``: the starting feature, its direction, its threshold.

    Each turn fits accepted targets against decoys, scores all rows and accepts anew. None if a turn accepts no target.
    """
    name, descending, threshold = first
    score = (F.col(name) if descending else -F.col(name)).cast("double")
    current, scorer, passing = rows.withColumn("_score", score), None, 0
    for _ in range(max_iter):
        y = F.when(~F.col(target), 0).when(F.col("_score").cast("float") >= F.lit(threshold).cast("float"), 1)
        scorer = estimator.fit(current.withColumn("_y", y).where("_y is not null").drop("_score"), features, "_y")
        current = scorer.score(rows, "_score")
        blocks = pack(current, [F.col("_score")], F.col(target))
        found = accepted(blocks, lambda b: [b.x[:, 0]], [Question(0)], fdr)[0]
        blocks.close()
        passing, threshold = found.passing, found.threshold
        if threshold is None:
            return None, 0
    return scorer, passing
