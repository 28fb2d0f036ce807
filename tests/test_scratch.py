"""Scopes that own the tables kept inside them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablefit.operators import models, prep
from tablefit.plans.price_model import train_and_compare
from tablefit.sources.tables import scratch, stored, written
from tablefit.specs import FeatureSpec


@pytest.fixture
def folder(spark):
    return Path(spark.conf.get("spark.checkpoint.dir"))


def names(folder):
    return {p.name for p in folder.iterdir()}


def test_scope_deletes_its_tables_and_no_others(spark, folder):
    before = names(folder)
    outside = written(spark.range(5), "outside")
    with scratch(spark) as scope:
        own = written(spark.range(7), "own")
        with stored(spark.range(3), "short") as short:
            assert short.count() == 3
        assert own.count() == 7 and {p.name.split("-")[0] for p in Path(scope).iterdir()} == {"own"}
        result = written(own.withColumn("double", F.col("id") * 2), "result", result=True)
    assert not Path(scope).exists()
    assert outside.count() == 5 and result.agg(F.sum("double")).first()[0] == 42
    assert {n.split("-")[0] for n in names(folder) - before} == {"outside", "result"}


def test_scopes_nest_and_end_on_failure(spark, folder):
    before = names(folder)
    with scratch(spark, "outer") as outer:
        with pytest.raises(ValueError):
            with scratch(spark, "inner") as inner:
                written(spark.range(2), "lost")
                kept = written(spark.range(4), "kept", result=True)
                raise ValueError
        assert Path(inner).parent == Path(outer) and not Path(inner).exists()
        assert kept.count() == 4
    assert names(folder) == before


def test_training_leaves_only_its_predictions(spark, folder):
    i = F.col("id")
    rows = spark.range(600).select(
        i.cast("string").alias("key"), (i % 7 * 10.0 + i % 3).alias("price"),
        (i % 3).cast("string").alias("kind"), (i % 7).cast("double").alias("size"),
    )
    spec = FeatureSpec(label="price", cats=["kind"], nums=["size"], excluded={"key": "identifier", "price": "label"})
    before = names(folder)
    fitted = train_and_compare(rows, spec, "key", {"line": models.linear("price")})
    assert {n.split("-")[0] for n in names(folder) - before} == {"predictions"}
    assert fitted.comparison.count() == 1


def test_table_of_a_wide_column_outlives_the_fit(spark, folder, monkeypatch):
    monkeypatch.setattr(prep, "MODEL_LEVELS", 2)
    rows = spark.createDataFrame([(c,) for c in "aabbbcd"], "c string")
    before = names(folder)
    model = prep.index(["c"]).fit(rows)
    assert {r.c: r.c_index for r in model.transform(rows).collect()} == {"b": 0.0, "a": 1.0, "c": 2.0, "d": 3.0}
    assert {"-".join(n.split("-")[:2]) for n in names(folder) - before} == {"level-places"}
