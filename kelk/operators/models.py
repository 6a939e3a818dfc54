"""Models over folds: out-of-fold predictions, the holdout's ensemble, importance, storing and serving, with MLlib's trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.sources.readers import load_json, save_json


@dataclass(frozen=True)
class Features:
    """Numeric columns, whose nulls get the median of the training rows, and categories, of which unknown ones are one more."""

    numbers: tuple[str, ...]
    categories: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *self.categories]


@dataclass(frozen=True)
class Trees:
    iterations: int = 12
    depth: int = 4
    loss: str = "squared"
    seed: int = 7


def columns_of(df: DataFrame, leave_out: Sequence[str]) -> Features:
    """The features of a table: its text columns as categories, all others as numbers."""
    kept = [(c, kind) for c, kind in df.dtypes if c not in leave_out]
    return Features(tuple(c for c, kind in kept if kind != "string"), tuple(c for c, kind in kept if kind == "string"))


def _prepared(df: DataFrame, features: Features) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features.numbers})


def fit(rows: DataFrame, features: Features, label: str, weight: str | None = None, trees: Trees = Trees()) -> PipelineModel:
    """A pipeline of trees that predicts prediction; rows without a label, or with no positive weight, take no part."""
    rows = _prepared(rows, features).where(F.col(label).isNotNull())
    stages = [Imputer(inputCols=list(features.numbers), outputCols=[f"{c}__i" for c in features.numbers], strategy="median")]
    # A column without any value has no median, so it says nothing; a constant does no harm.
    empty = [c for c, n in rows.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features.numbers]).first().asDict().items() if not n]
    rows = rows.fillna(0.0, empty) if empty else rows
    if features.categories:
        stages.append(StringIndexer(inputCols=list(features.categories), outputCols=[f"{c}__i" for c in features.categories], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in features.names], outputCol="__features", handleInvalid="keep"))
    most = max([32, *[r + 2 for r in rows.agg(*[F.countDistinct(c).alias(c) for c in features.categories]).first()]]) if features.categories else 32
    model = GBTRegressor(labelCol=label, featuresCol="__features", predictionCol="prediction", maxIter=trees.iterations, maxDepth=trees.depth, lossType=trees.loss, seed=trees.seed, maxBins=most)
    if weight:
        rows = rows.where(F.col(weight) > 0)
        model = model.setWeightCol(weight)
    return Pipeline(stages=[*stages, model]).fit(rows)


def predict(df: DataFrame, model: PipelineModel, features: Features, out: str) -> DataFrame:
    found = model.transform(_prepared(df, features)).withColumnRenamed("prediction", out)
    return found.drop("__features", *[f"{c}__i" for c in features.names])


def train_folds(df: DataFrame, features: Features, label: str, fold: str, folds: int, weight: str | None = None, trees: Trees = Trees()) -> list[PipelineModel]:
    """A model for each fold, trained on the rows of the other folds; the folds are fitted side by side, as each leaves cores idle."""
    one = inheritable_thread_target(df.sparkSession)(lambda k: fit(df.where(F.col(fold) != k), features, label, weight, trees))
    with ThreadPoolExecutor(max_workers=folds) as pool:
        return list(pool.map(one, range(folds)))


def out_of_fold(df: DataFrame, models: Sequence[PipelineModel], features: Features, fold: str) -> DataFrame:
    """df's rows with prediction, each by the one model that has not seen its fold; rows without a fold are left out."""
    out = None
    for k, model in enumerate(models):
        part = predict(df.where(F.col(fold) == k), model, features, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble(df: DataFrame, models: Sequence[PipelineModel], features: Features) -> DataFrame:
    """df with each model's prediction fold_k, their mean and the population's standard deviation."""
    for k, model in enumerate(models):
        df = predict(df, model, features, f"fold_{k}")
    every = [F.col(f"fold_{k}") for k in range(len(models))]
    mean = sum(every[1:], every[0]) / len(every)
    return df.withColumns({"prediction": mean, "spread": F.sqrt(sum(((x - mean) * (x - mean) for x in every), F.lit(0.0)) / len(every))})


def importance(df: DataFrame, models: Sequence[PipelineModel], features: Features) -> DataFrame:
    """feature, mean, spread of the models' importances, the largest first."""
    rows = [(f, float(m.stages[-1].featureImportances[i])) for m in models for i, f in enumerate(features.names)]
    table = df.sparkSession.createDataFrame(rows, "feature string, value double")
    return table.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")).orderBy(F.desc("mean"), "feature")


def save(models: Sequence[PipelineModel], features: Features, folder: str, df: DataFrame) -> None:
    """The models and their features in a folder of any file system."""
    for k, model in enumerate(models):
        model.write().overwrite().save(f"{folder}/model-{k}")
    save_json(df.sparkSession, f"{folder}/features.json", {"numbers": features.numbers, "categories": features.categories, "models": len(models)})


def load(folder: str, df: DataFrame) -> tuple[list[PipelineModel], Features]:
    told = load_json(df.sparkSession, f"{folder}/features.json")
    return [PipelineModel.load(f"{folder}/model-{k}") for k in range(told["models"])], Features(tuple(told["numbers"]), tuple(told["categories"]))


def serve(df: DataFrame, folder: str, id: str) -> DataFrame:
    """id, prediction, spread of new rows by the stored models; columns that rows lack are null for all of them."""
    models, features = load(folder, df)
    for c in features.names:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c in features.categories else "double"))
    return ensemble(df, models, features).select(id, "prediction", "spread")


def predict_batches(df: DataFrame, make: Callable[[], Callable[[list[str]], list[float]]], text: str, out: str, batch: int = 32, low: float | None = None, high: float | None = None) -> DataFrame:
    """df with the predictions of any model of texts, made once a task and called with so many texts at a time, within low and high if given.

    make is what chooses the model: it runs on the executors, where it loads what it needs. A null text has no prediction.
    """

    @arrow_udf(T.DoubleType())
    def predicted(texts: pa.Array) -> pa.Array:
        run = make()
        rows = texts.to_pylist()
        at = [i for i, t in enumerate(rows) if t is not None]
        told: list[float | None] = [None] * len(rows)
        for start in range(0, len(at), batch):
            part = at[start : start + batch]
            for i, value in zip(part, run([rows[i] for i in part]), strict=True):
                value = value if low is None else max(low, value)
                told[i] = float(value if high is None else min(high, value))
        return pa.array(told, pa.float64())

    return df.withColumn(out, predicted(F.col(text)))


def hybrid(features: DataFrame, predictions: DataFrame, id: str, first: str, second: str) -> DataFrame:
    """The features with two models' predictions, their mean, their difference and its size."""
    a, b = F.col("base_first"), F.col("base_second")
    both = features.join(predictions.select(id, F.col(first).alias("base_first"), F.col(second).alias("base_second")), id)
    return both.withColumns({"base_mean": (a + b) / 2, "base_difference": a - b, "base_distance": F.abs(a - b)})
