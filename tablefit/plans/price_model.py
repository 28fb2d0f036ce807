"""Feature table to fitted regressors, their errors and example predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import DataFrame

from tablefit.operators import models, prep
from tablefit.operators.evaluate import compared_metrics, examples
from tablefit.operators.sampling import sample_n, split, split_kept
from tablefit.plans.feature_table import build_features, filter_ranges, grouper
from tablefit.sources.tables import stored, written
from tablefit.specs import FeatureSpec


@dataclass(frozen=True)
class Fitted:
    preparation: PipelineModel
    models: dict[str, Model]
    width: int
    predictions: DataFrame
    comparison: DataFrame

    def examples(
        self, name: str, label: str, key: str | Sequence[str], context: Sequence[str] = (),
        k: int = 12, worst: bool = False,
    ) -> DataFrame:
        column = models.prediction_column(name)
        return examples(self.predictions, label, key, column, context, k, worst)


def split_features(
    df: DataFrame, spec: FeatureSpec, key: str | Sequence[str], ratio: float = 0.8,
    seed: int = 42, group_key: str | None = None, carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Feature tables of both sides of a split of the clean table, with the
    frequent levels of the training rows alone."""
    train, test = split(df, key, ratio, seed, group_key)
    levels = grouper(spec).fit(filter_ranges(train, spec))
    return (
        build_features(train, spec, carry, levels),
        build_features(test, spec, carry, levels),
    )


def train_and_compare(
    features: DataFrame,
    spec: FeatureSpec,
    key: str | Sequence[str],
    estimators: Mapping[str, Estimator] | None = None,
    ratio: float = 0.8,
    seed: int = 42,
    max_train_rows: int = 5000,
    group_key: str | None = None,
    rel_error: float = prep.REL_ERROR,
    max_levels: int | None = None,
) -> Fitted:
    """Split, sample the training side, prepare, fit, predict and compare.

    Everything is fitted on `max_train_rows` rows of the training side (0 takes
    them all); predictions, errors and examples are those of all test rows.
    `max_levels` bounds the levels of a category (see `LevelIndexer`).

    Features and training vectors are read many times by the fits, so both are
    written to the shared folder first, the vectors unscaled; the scaler is fitted
    on them as written, and a lost executor costs a read.  Both go at the end; the predictions stay.
    """
    with ExitStack() as rows:
        train, test = split_kept(
            features, lambda made: rows.enter_context(stored(made, "features")), key, ratio, seed, group_key
        )
        fitted_on = sample_n(train, key, max_train_rows, seed)
        with ExitStack() as kept:
            preparation, vectors = prep.fit_on_kept(
                prep.build(spec, rel_error, max_levels), fitted_on, [spec.label],
                lambda raw: kept.enter_context(stored(raw, "train")),
            )
            scaled = preparation.stages[-1].transform(vectors)
            width = prep.width(scaled, "features_raw")
            fitted = models.fit_all(scaled, estimators or models.regressors(spec.label, seed))
        columns = {name: models.prediction_column(name) for name in fitted}
        predicted = models.predict_all(preparation.transform(test), fitted)
        predictions = written(predicted.select(*features.columns, *columns.values()), "predictions")
    comparison = compared_metrics(predictions, spec.label, columns)
    return Fitted(preparation, fitted, width, predictions, comparison)
