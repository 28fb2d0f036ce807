"""Exact quantiles against a sort, on shapes that make narrowing hard."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablefit.operators import quantiles
from tablefit.operators.quantiles import exact_quantiles, order_statistic
from tablefit.operators.summary import distribution

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def _expected(values, probs):
    ordered = sorted(values)
    return [ordered[max(1, math.ceil(p * len(ordered))) - 1] for p in probs]


def _shapes():
    rng = np.random.default_rng(1)
    n = 6000
    return {
        "uniform": rng.random(n),
        "one third one value": np.where(np.arange(n) % 3 == 0, 0.5, rng.random(n)),
        "two values": np.where(np.arange(n) % 2 == 0, 1.0, 2.0),
        "one value": np.full(n, 7.0),
        "long tail": np.exp(rng.normal(0, 8, n)),
        "all exponents": np.concatenate([2.0 ** np.arange(-1074, 1024), -(2.0 ** np.arange(-1074, 1024))]),
        "neighbours": np.nextafter(1.0, 2.0) + np.arange(3000) * np.finfo(float).eps,
        "few hot among many": np.where(rng.random(n) < 0.9, rng.integers(0, 4, n), rng.random(n) * 4),
        "signed zero and infinities": np.concatenate(
            [rng.normal(0, 1, n - 4), [-0.0, 0.0, math.inf, -math.inf]]
        ),
    }


@pytest.mark.parametrize("name", list(_shapes()))
@pytest.mark.parametrize("steps", [8, 4096])
def test_same_as_a_sort(spark, name, steps):
    values = [float(v) for v in _shapes()[name]]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(8)
    found = exact_quantiles(df, {"x": PROBS}, steps)["x"]
    assert found == _expected(values, PROBS)


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (math.nan, None), (3.0, None), (2.0, None)],
        "x double, empty double",
    )
    assert exact_quantiles(df, {"x": [0.5], "empty": [0.5, 0.9]}) == {
        "x": [2.0], "empty": [None, None],
    }


def test_lower_of_the_two_middle_values(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [2.0]}


def test_many_columns_at_once(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 48)) * 10.0 ** rng.integers(-9, 9, 48)
    names = [f"c{i}" for i in range(48)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], names)
    found = exact_quantiles(df, {n: [0.1, 0.5] for n in names})
    for i, name in enumerate(names):
        assert found[name] == _expected(data[:, i], [0.1, 0.5])


@pytest.mark.parametrize("guess", [None, (0.4, 0.6), (0.9, 0.95), (-5.0, -4.0)])
def test_order_statistic_survives_a_wrong_guess(spark, guess):
    values = [float(v) for v in np.random.default_rng(3).random(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = order_statistic(df, "x", 2000, guess, steps=100)
    assert found == sorted(values)[1999]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=200), st.floats(0, 1))
def test_any_list(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_quantiles(df, {"x": [p]}, steps=5)["x"] == _expected(values, [p])


def test_approximate_percentiles_are_within_their_bound(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"))
    row = distribution(df, "x", accuracy=1000).first()
    for p, name in [(0.25, "p25"), (0.5, "median"), (0.75, "p75")]:
        assert abs(row[name] - p * 50_000) <= 50_000 / 1000 + 1
    exact = distribution(df, "x", exact=True).first()
    assert (exact.p25, exact.median, exact.p75) == (12499.0, 24999.0, 37499.0)
    assert row.total == exact.total == 50_000


@pytest.mark.parametrize("shape", ["even", "skewed", "few"])
def test_approximate_quantiles_keep_their_rank_error(spark, monkeypatch, shape):
    """Many blocks a task and many tasks; nulls, NaN and a column without values count in nothing."""
    monkeypatch.setattr(quantiles, "BLOCK_ROWS", 10_000)
    i = F.col("id")
    x = {"even": (i * 7919 % 120_011).cast("double"), "skewed": F.exp((i * 7919 % 1009) / 20.0) * F.when(i % 3 == 0, -1).otherwise(1),
         "few": F.when(i % 10 < 6, 1.0).otherwise((i % 7).cast("double"))}[shape]
    df = spark.range(120_000).select(
        F.when(i % 11 == 0, None).when(i % 13 == 0, float("nan")).otherwise(x).alias("x"), F.lit(None).cast("double").alias("gone"),
    ).repartition(3)
    shares, error = [0.0, 0.01, 0.5, 0.93, 1.0], 0.01
    found = quantiles.approximate_quantiles(df, ["x", "gone"], shares, error)
    assert found["gone"] == [None] * len(shares)
    values = np.sort(np.array([r.x for r in df.where("x is not null and not isnan(x)").collect()]))
    for share, value in zip(shares, found["x"]):
        below, upto = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        assert upto > below and below <= (share + error) * len(values) and upto >= (share - error) * len(values)


def test_approximate_quantiles_of_few_rows_are_exact(spark):
    values = [5.0, -math.inf, 2.0, math.inf, 0.0, -0.5, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    found = quantiles.approximate_quantiles(df, ["x"], PROBS, 0.001)["x"]
    assert found == exact_quantiles(df, {"x": PROBS})["x"]
    assert quantiles.approximate_quantiles(df.limit(0), ["x"], [0.5], 0.001) == {"x": [None]}


def test_approximate_quantiles_hand_python_one_column(spark, monkeypatch):
    """However many columns are asked for: each one handed over is asked for its size after every row."""
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, math.nan, 6.0), (3.0, 9.0, None)], "a double, b double, c double")
    handed, run = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, *args: handed.append(df.columns) or run(df, *args))
    found = quantiles.approximate_quantiles(df, ["a", "b", "c"], [0.5], 0.001)
    assert [len(columns) for columns in handed] == [1]
    assert found == {"a": [2.0], "b": [9.0], "c": [5.0]}
