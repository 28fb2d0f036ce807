"""Regression errors and example predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _metric_columns(label: str, prediction: str) -> list[Column]:
    # only rows that have both count, in every figure
    error = F.col(label) - F.col(prediction)
    y = F.when(error.isNotNull(), F.col(label))
    rows = F.count(error)
    # var_pop is merged from centred moments, so large labels cost no digits;
    # a constant label has no variance to explain.
    explained = F.nullif(F.var_pop(y) * rows, F.lit(0.0))
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.sum(error * error) / explained).alias("r2"),
        rows.alias("n"),
    ]


def metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row with rmse, mae, r2 and n, from a single aggregate; rows without a
    label or a prediction count in none of them."""
    return df.agg(*_metric_columns(label, prediction))


def compared_metrics(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """A row of `metrics` per model, still from a single aggregate; maps model
    name to its prediction column."""
    wide = df.agg(
        *[
            F.struct(*_metric_columns(label, column)).alias(f"m{i}")
            for i, column in enumerate(predictions.values())
        ]
    )
    rows = [
        F.struct(
            F.lit(model).alias("model"), *[F.col(f"m{i}.{m}") for m in ("rmse", "mae", "r2", "n")]
        )
        for i, model in enumerate(predictions)
    ]
    return wide.select(F.inline(F.array(*rows)))


def examples(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    prediction: str = "prediction",
    context: Sequence[str] = (),
    k: int = 12,
    worst: bool = False,
) -> DataFrame:
    """The k rows with the smallest (or largest) rounded absolute error; equal
    errors are ordered by key."""
    names = [key] if isinstance(key, str) else list(key)
    shown = df.select(
        *names,
        F.round(label, 2).alias("actual"),
        F.round(prediction, 2).alias("predicted"),
        F.round(F.abs(F.col(label) - F.col(prediction)), 2).alias("abs_error"),
        *[c for c in context if c not in names],
    )
    first = F.desc("abs_error") if worst else F.asc("abs_error")
    return shown.orderBy(first, *names).limit(k)
