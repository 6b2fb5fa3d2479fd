"""Baseline classifiers on word unigrams and bigrams, to see what deduplication does to accuracy. Results depend on the solver, so there is no SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption


def pipeline(kind: str = "logistic", features: int = 4096, classes: int = 2, iterations: int = 30) -> Pipeline:
    stages = [
        StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"),
        RegexTokenizer(inputCol="text", outputCol="words", pattern="\\W+"),
        NGram(n=2, inputCol="words", outputCol="bigrams"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="bigrams", outputCol="tf2", numFeatures=features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="x"),
    ]
    common = {"featuresCol": "x", "labelCol": "y"}
    if kind == "logistic":
        stages.append(LogisticRegression(maxIter=iterations, regParam=1e-3, **common))
    elif kind == "svm":
        stages.append(OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=1e-3, **common), **common))
    elif kind == "mlp":
        stages.append(MultilayerPerceptronClassifier(layers=[2 * features, 16, classes + 1], maxIter=iterations, seed=7, **common))
    else:
        raise InvalidOption(f"no model {kind}")
    return Pipeline(stages=stages)


def fit(train: DataFrame, kind: str = "logistic", **options) -> PipelineModel:
    return pipeline(kind, **options).fit(train)


def accuracy(model: Transformer, df: DataFrame) -> DataFrame:
    """One row: accuracy and n."""
    scored = model.transform(df)
    return scored.agg(F.coalesce(F.avg(F.when(F.col("prediction") == F.col("y"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def train_test_gap(train: DataFrame, test: DataFrame, kind: str = "logistic", **options) -> DataFrame:
    """Accuracy on training and test rows, and their gap."""
    model = fit(train, kind, **options)
    a, b = accuracy(model, train), accuracy(model, test)
    return a.select(F.col("accuracy").alias("train_accuracy"), F.col("n").alias("n_train")).crossJoin(b.select(F.col("accuracy").alias("test_accuracy"), F.col("n").alias("n_test"))).withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))


def inflation(train: DataFrame, test: DataFrame, clean_test: DataFrame, kind: str = "logistic", **options) -> DataFrame:
    """How much contamination lifts accuracy: on all test rows against clean ones."""
    model = fit(train, kind, **options)
    a, b = accuracy(model, test), accuracy(model, clean_test)
    return a.select(F.col("accuracy").alias("full")).crossJoin(b.select(F.col("accuracy").alias("clean"))).withColumn("inflation", F.col("full") - F.col("clean"))


def cross_validate(df: DataFrame, order: str, folds: int = 5, kind: str = "logistic", **options) -> list[float]:
    """Accuracy of each fold by a model of the others."""
    fold = F.pmod(F.xxhash64(order), F.lit(folds))
    return [accuracy(fit(df.where(fold != k), kind, **options), df.where(fold == k)).first().accuracy for k in range(folds)]
