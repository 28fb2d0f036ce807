"""The three regressors and their comparison on held-out rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Estimator, Model
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame

from tablefit.operators.evaluate import compared_metrics


def linear(
    label: str, reg: float = 0.1, l1: float = 0.0, max_iter: int = 50, features: str = "features"
) -> LinearRegression:
    """Linear regression on scaled features; ridge unless `l1` is above 0."""
    return LinearRegression(
        labelCol=label, featuresCol=features, maxIter=max_iter, regParam=reg, elasticNetParam=l1
    )


def tree(
    label: str, depth: int = 8, min_rows: int = 10, seed: int = 42, features: str = "features_raw"
) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(
        labelCol=label,
        featuresCol=features,
        maxDepth=depth,
        minInstancesPerNode=min_rows,
        seed=seed,
    )


def forest(
    label: str,
    trees: int = 40,
    depth: int = 8,
    min_rows: int = 5,
    subsample: float = 0.8,
    seed: int = 42,
    features: str = "features_raw",
) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label,
        featuresCol=features,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_rows,
        subsamplingRate=subsample,
        seed=seed,
    )


def regressors(label: str, seed: int = 42) -> dict[str, Estimator]:
    return {
        "linear_regression": linear(label),
        "decision_tree": tree(label, seed=seed),
        "random_forest": forest(label, seed=seed),
    }


def fit_all(train: DataFrame, estimators: Mapping[str, Estimator]) -> dict[str, Model]:
    """Fit every estimator; `train` is read many times, so keep it first."""
    return {name: estimator.fit(train) for name, estimator in estimators.items()}


def prediction_column(name: str) -> str:
    return f"prediction_{name}"


def predict_all(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """One prediction column per model, all in one projection chain."""
    for name, model in models.items():
        df = model.transform(df, {model.getParam("predictionCol"): prediction_column(name)})
    return df


def compare(
    train: DataFrame, test: DataFrame, estimators: Mapping[str, Estimator], label: str
) -> DataFrame:
    """Fit on train, predict test, and give a row of errors per model."""
    models = fit_all(train, estimators)
    columns = {name: prediction_column(name) for name in models}
    return compared_metrics(predict_all(test, models), label, columns)
