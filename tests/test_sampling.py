"""Samples and splits do not depend on layout, cover everything, and overlap nowhere."""

import pytest
from pyspark.sql import functions as F

from tablefit.functions.hashing import unit_hash
from tablefit.operators.sampling import sample, sample_n, split, split_kept
from tablefit.sources.tables import written


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 700).alias("owner"), "id"
    )


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_places_are_spread_evenly(table):
    row = table.select(unit_hash("key").alias("p")).agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean")
    ).first()
    assert 0 <= row.low < 0.01 and 0.99 < row.high < 1 and abs(row.mean - 0.5) < 0.01


def test_split_is_a_disjoint_cover(table):
    train, test = split(table, "key", 0.8)
    assert sorted(_ids(train) + _ids(test)) == list(range(20_000))
    assert 0.78 < train.count() / 20_000 < 0.82


def test_layout_changes_nothing(table):
    other = table.repartition(13, "owner").orderBy(F.desc("id"))
    for run in (lambda t: split(t, "key")[0], lambda t: sample(t, "key", 0.2),
                lambda t: sample_n(t, "key", 500)):
        assert _ids(run(table)) == _ids(run(other))


def test_seed_and_use_matter(table):
    assert _ids(sample(table, "key", 0.2)) != _ids(sample(table, "key", 0.2, seed=1))
    picked = sample_n(table, "key", 2000)
    test = split(picked, "key", 0.8)[1].count()
    assert 320 < test < 480  # a sample is split like any other rows


@pytest.mark.parametrize("n", [1, 7, 500, 19_999])
def test_exactly_n_rows_with_the_smallest_places(table, n):
    places = table.select("id", "key", unit_hash("key", use="sample").alias("p")).collect()
    expected = sorted(r.id for r in sorted(places, key=lambda r: (r.p, r.key))[:n])
    assert _ids(sample_n(table, "key", n)) == expected


@pytest.mark.parametrize("n", [0, -3, 20_000, 50_000])
def test_all_rows(table, n):
    assert sample_n(table, "key", n).count() == 20_000


def test_rows_with_equal_places_are_told_apart_by_the_whole_row(spark):
    # The key leaves rows undecided, so all share one place; n still holds.
    df = spark.range(5000).select(F.lit("same").alias("key"), "id")
    picked = sample_n(df, "key", 2000)
    assert picked.count() == 2000
    assert _ids(picked) == _ids(sample_n(df.repartition(5, "id"), "key", 2000))
    plan = picked._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Limit" not in plan


def test_rows_that_agree_everywhere(spark):
    df = spark.range(60).select(F.lit("same").alias("key"))
    assert sample_n(df, "key", 20).count() == 20


def test_one_key_with_a_third_of_all_rows(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("string").alias("key"),
        "id",
    )
    for n in (100, 4000, 8000):
        picked = sample_n(df, "key", n)
        assert picked.count() == n
        assert _ids(picked) == _ids(sample_n(df.repartition(7), "key", n))
    train, test = split(df, "id", 0.8, group_key="key")
    assert train.select("key").distinct().intersect(test.select("key").distinct()).count() == 0
    assert train.count() + test.count() == 9000


def test_groups_stay_together(table):
    train, test = split(table, "key", 0.5, group_key="owner")
    assert train.select("owner").intersect(test.select("owner")).count() == 0
    assert train.count() + test.count() == 20_000


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "key string, id int")
    train, test = split(df, "key")
    assert train.count() + test.count() == 3


def test_split_and_sample_move_no_row(table):
    for df in (*split(table, "key", group_key="owner"), sample(table, "key", 0.3),
               sample_n(table, "key", 300)):
        plan = df._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan


def test_rows_that_differ_only_in_where_their_nulls_are(spark):
    rows = [("same", None, "a")] * 20 + [("same", "a", None)] * 20
    df = spark.createDataFrame(rows, "key string, x string, y string")
    picks = [
        sorted(map(tuple, sample_n(df.repartition(n), "key", 10).collect()), key=repr) for n in (1, 3, 7)
    ]
    assert len(picks[0]) == 10 and picks[0] == picks[1] == picks[2]


def test_split_kept_equals_split_and_hashes_no_key_again(table, capsys):
    df = table.withColumn("in_train", F.lit("a column of its own"))
    for key, group in (("key", None), (["key", "id"], "owner")):
        sides = split_kept(df, lambda made: written(made, "sides"), key, 0.7, 3, group)
        for ours, theirs in zip(sides, split(df, key, 0.7, 3, group)):
            assert ours.columns == df.columns
            assert sorted(ours.collect()) == sorted(theirs.collect())
            capsys.readouterr()
            ours.explain(True)
            assert "md5" not in capsys.readouterr().out
