"""Gradient-boosted regression on panels: fit, rank features, refit on the best, evaluate, sweep horizons."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.panel import forward_return, metrics, usable


@dataclass(frozen=True)
class Boosting:
    depth: int = 5
    rate: float = 0.02
    trees: int = 120
    seed: int = 1


@dataclass(frozen=True)
class Forest:
    depth: int = 5
    trees: int = 50
    seed: int = 1


#: Distinct values that a categorical regressor may have.
MAX_CATEGORIES = 512


def fit(train: DataFrame, regressors: list[str], target: str, how: Boosting | Forest = Boosting(), validation: str | None = None, categorical: tuple[str, ...] = ()) -> PipelineModel:
    """Fits a regressor; missing values take the training median. validation: a boolean column that marks rows for early stopping of boosted trees.

    categorical regressors are split on as sets of values, not by order; values that training lacks are a category of their own.
    """
    numbers = [i for i, r in enumerate(regressors) if r not in categorical]
    kinds = [i for i, r in enumerate(regressors) if r in categorical]
    raw = [F.col(f"`{r}`").cast("string" if i in kinds else "double").alias(f"_raw{i}") for i, r in enumerate(regressors)]
    plain = train.select(*raw, F.col(f"`{target}`").alias("_y"), *([validation] if validation else []))
    common = {"featuresCol": "_x", "labelCol": "_y", "maxDepth": how.depth, "seed": how.seed}
    if kinds:
        common["maxBins"] = MAX_CATEGORIES
    if isinstance(how, Forest):
        trees = RandomForestRegressor(numTrees=how.trees, **common)
    else:
        trees = GBTRegressor(stepSize=how.rate, maxIter=how.trees, **common)
        if validation:
            trees = trees.setValidationIndicatorCol(validation)
    stages = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=[f"_raw{i}" for i in numbers], outputCols=[f"_in{i}" for i in numbers]))
    if kinds:
        stages.append(StringIndexer(inputCols=[f"_raw{i}" for i in kinds], outputCols=[f"_in{i}" for i in kinds], handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages += [VectorAssembler(inputCols=[f"_in{i}" for i in range(len(regressors))], outputCol="_x"), trees]
    return Pipeline(stages=stages).fit(plain)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, regressors: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    raw = df.withColumns({f"_raw{i}": F.col(f"`{r}`").cast("string" if r in categorical else "double") for i, r in enumerate(regressors)})
    return model.transform(raw).drop("_x", *[f"_raw{i}" for i in range(len(regressors))], *[f"_in{i}" for i in range(len(regressors))])


def importances(spark: SparkSession, model: PipelineModel, regressors: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(regressors, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def select_and_refit(
    train: DataFrame, regressors: list[str], target: str, use_first: int = 25, how: Boosting | Forest = Boosting(), validation: str | None = None, categorical: tuple[str, ...] = ()
) -> tuple[PipelineModel, list[str], DataFrame]:
    """Ranks features with a first fit and fits again on the best: the model, the best, and all importances."""
    ranked = importances(train.sparkSession, fit(train, regressors, target, how, validation, categorical), regressors)
    best = [r.feature for r in ranked.limit(use_first).collect()]
    return fit(train, best, target, how, validation, categorical), best, ranked


def evaluate(model: PipelineModel, df: DataFrame, regressors: list[str], target: str, by: str, categorical: tuple[str, ...] = ()) -> DataFrame:
    return metrics(predict(model, df, regressors, categorical).withColumn("truth", F.col(f"`{target}`")), by)


def sweep(
    panel: DataFrame, regressors: list[str], horizons: list[int], by: str, split, how: Boosting | Forest = Boosting(), use_first: int = 25, categorical: tuple[str, ...] = (), root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(metrics, importances) for each horizon (in grid steps): features are ranked and chosen, and the model fitted on the best, with early stopping, anew.

    split adds a split column: train rows are fitted on, validation rows stop the boosting, test rows are evaluated. With root each horizon's importances
    and metrics are written there as CSV. The panel is read several times a horizon: cache or write it where it is costly.
    """
    found, ranks = [], []
    for h in horizons:
        data = split(usable(forward_return(panel, h), "output", regressors, categorical)).cache()
        fitting = data.where("split <> 'test'").withColumn("_late", F.col("split") == "validation")
        late = "_late" if isinstance(how, Boosting) and not fitting.where("_late").isEmpty() else None
        fitted, best, ranked = select_and_refit(fitting, regressors, "output", use_first, how, late, categorical)
        # A few rows each; collected, so that the cached rows can go.
        scores = evaluate(fitted, data.where("split = 'test'"), best, "output", by, categorical).withColumn("horizon", F.lit(h))
        for held, out, name in ((found, scores, "metrics"), (ranks, ranked.withColumn("horizon", F.lit(h)), "importances")):
            held.append(panel.sparkSession.createDataFrame(out.collect(), out.schema))
            if root is not None:
                held[-1].coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}-{h}")
        data.unpersist()
    return functools.reduce(DataFrame.unionByName, found), functools.reduce(DataFrame.unionByName, ranks)
