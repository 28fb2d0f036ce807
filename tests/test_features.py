"""Derived features, grouping, and the whole feature table."""

import datetime
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablefit import listing
from tablefit.functions import features as feat
from tablefit.operators import filters
from tablefit.operators.grouping import Group, TopNGrouper
from tablefit.operators.summary import group_count, group_summary
from tablefit.plans.clean_table import clean_table
from tablefit.plans.feature_table import build_features, grouper
from tablefit.specs import FeatureSpec

DAY = datetime.date


def _one(spark, schema, values, **columns):
    df = spark.createDataFrame([values], schema)
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("value, expected", [(3.0, math.log(4)), (None, 0.0), (-5.0, 0.0), (0.0, 0.0)])
def test_log1p_clipped(spark, value, expected):
    assert _one(spark, "x double", (value,), y=feat.log1p_clipped("x")).y == pytest.approx(expected, abs=1e-15)


@pytest.mark.parametrize(
    "beds, guests, expected",
    [(2.0, 0.0, None), (2.0, 4.0, 0.5), (2.0, -1.0, None), (None, 4.0, None), (2.0, None, None)],
)
def test_safe_ratio(spark, beds, guests, expected):
    assert _one(spark, "b double, g double", (beds, guests), y=feat.safe_ratio("b", "g")).y == expected


def test_flags_and_ratio(spark):
    for value, has, gone in [(2.0, 1.0, 0.0), (0.0, 0.0, 0.0), (None, 0.0, 1.0)]:
        row = _one(spark, "x double", (value,), has=feat.flag(F.col("x") > 0), gone=feat.missing("x"))
        assert tuple(row) == (has, gone)
    assert _one(spark, "x double", (73.0,), y=feat.ratio("x", 365.0)).y == 0.2
    with pytest.raises(ValueError):
        feat.ratio("x", 0)


def test_days_between(spark):
    row = _one(
        spark, "a date, b date", (DAY(2020, 2, 1), DAY(2020, 1, 1)),
        back=feat.days_between("a", "b"), forth=feat.days_between("b", "a"),
    )
    assert tuple(row) == (-31, 31)


def test_month_and_year(spark):
    row = _one(
        spark, "d date, m double", (DAY(2021, 5, 6), None),
        y=feat.year("d"), m=feat.month("d", "m"), plain=feat.month("d"),
    )
    assert tuple(row) == (2021.0, 5.0, 5.0)


def test_filters(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (20.0,), (20.5,), (None,)], "x double")
    kept = lambda d: [r.x for r in d.collect()]
    assert kept(filters.keep_range(df, "x", 1, 20)) == [1.0, 20.0]
    assert kept(filters.keep_range(df, "x", 1, 20, allow_null=True)) == [1.0, 20.0, None]
    assert kept(filters.keep_not_null(df, ["x"])) == [0.0, 1.0, 20.0, 20.5]
    assert kept(filters.keep_in(df, "x", [1.0, 20.5])) == [1.0, 20.5]


def _levels(spark, counts):
    rows = [(level,) for level, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string").repartition(5)


def _grouped(df, n, **options):
    model = TopNGrouper([Group("c", n, "g")], **options).fit(df)
    rows = model.transform(df)
    assert rows.count() == df.count()
    return {r.c: r.g for r in rows.distinct().collect()}


def test_tie_at_the_cut_goes_to_the_first_by_name(spark):
    df = _levels(spark, {"d": 3, "c": 2, "b": 2, "a": 1})
    assert _grouped(df, 2) == {"d": "d", "b": "b", "c": "other", "a": "other"}


def test_null_uses_up_a_place_or_not(spark):
    df = _levels(spark, {None: 5, "a": 4, "b": 3, "c": 1})
    assert _grouped(df, 2) == {None: "other", "a": "a", "b": "other", "c": "other"}
    assert _grouped(df, 2, null_takes_place=False) == {
        None: "other", "a": "a", "b": "b", "c": "other",
    }


def test_one_column_in_two_groups(spark):
    df = _levels(spark, {"a": 3, "b": 2, "c": 1})
    model = TopNGrouper([Group("c", 1, "one"), Group("c", 2, "two")]).fit(df)
    rows = model.transform(df).distinct().collect()
    assert {(r.c, r.one, r.two) for r in rows} == {
        ("a", "a", "a"), ("b", "other", "b"), ("c", "other", "other"),
    }
    assert sorted(r.level for r in model.levels("two").collect()) == ["a", "b"]


def test_levels_of_a_number(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "c int")
    assert _grouped(df, 1) == {1: "1", 2: "other"}


def test_groups_come_out_largest_first_then_by_name(spark):
    df = _levels(spark, {"b": 2, "a": 2, "z": 5, None: 2, "m": 1})
    assert [tuple(r) for r in group_count(df, "c").collect()] == [
        ("z", 5), ("a", 2), ("b", 2), (None, 2), ("m", 1),
    ]
    means = group_summary(df.withColumn("x", F.lit(1.005)), "c", "x", limit=3).collect()
    assert [tuple(r) for r in means] == [("z", 5, 1.01), ("a", 2, 1.01), ("b", 2, 1.01)]


def test_fewer_levels_than_places(spark):
    assert _grouped(_levels(spark, {"a": 2, "b": 1}), 9) == {"a": "a", "b": "b"}


def test_more_places_than_are_fetched(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") < 3000, F.col("id") % 1500).otherwise(F.col("id")).cast("string").alias("c")
    )
    model = TopNGrouper([Group("c", 1500, "g")], null_takes_place=False).fit(df)
    rows = model.transform(df)
    assert rows.filter("g <> 'other'").count() == 3000
    assert rows.filter("g = 'other'").count() == 3000


def test_groups_fitted_elsewhere(spark):
    train = _levels(spark, {"a": 3, "b": 2, "c": 1})
    model = TopNGrouper([Group("c", 2, "g")], other="rest").fit(train)
    rows = model.transform(_levels(spark, {"c": 9, "a": 1, "new": 3, None: 1}))
    assert {r.c: r.g for r in rows.distinct().collect()} == {
        "c": "rest", "a": "a", "new": "rest", None: "rest",
    }


@pytest.mark.parametrize("n", [2, 1500])
def test_levels_are_frozen_by_fit(spark, tmp_path, n):
    """What happens to the fitting table afterwards changes nothing, for any n."""
    path = str(tmp_path / "t")
    spark.range(6000).selectExpr("string(id % 2000) AS a", "string(id % 3) AS b").write.parquet(path)
    model = TopNGrouper([Group("a", n, "ga"), Group("b", 2, "gb")]).fit(spark.read.parquet(path))
    spark.range(10).selectExpr("'other' AS a", "'other' AS b").write.mode("overwrite").parquet(path)
    rows = spark.range(2000).selectExpr("string(id) AS a", "string(id % 3) AS b")
    found = model.transform(rows).collect()
    kept = sorted(str(i) for i in range(2000))[:n]
    assert {r.ga for r in found} == {*kept, "other"} and {r.gb for r in found} == {"0", "1", "other"}


def _clean_rows(spark, rows, columns):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return clean_table(df.withColumn("room_type", F.lit("Shared room")), listing.LISTING_CLEAN, "f")


def test_feature_table_shape_and_filters(spark):
    columns = ["id", "price", "accommodates", "bathrooms", "beds", "last_scraped", "host_since"]
    rows = [
        ("1", "$50", "1", None, None, "2020-02-01", "2020-03-03"),
        ("2", "$5,000.00", "20", "10", "20", "2020-02-01", ""),
        ("3", "$49.99", "2", None, None, None, None),
        ("4", "$5,000.01", "2", None, None, None, None),
        ("5", "$100", "21", None, None, None, None),
        ("6", "$100", None, None, None, None, None),
        ("7", "$100", "2", "10.5", None, None, None),
        ("8", "$100", "2", None, "21", None, None),
        ("9", "", "2", None, None, None, None),
    ]
    spec = listing.LISTING_FEATURES
    table = build_features(_clean_rows(spark, rows, columns), spec, carry=["listing_id"])
    found = {r.listing_id: r for r in table.collect()}
    assert set(found) == {"1", "2"}
    assert table.columns == ["listing_id", "price", *spec.cats, *spec.nums]
    assert len(table.columns) - 1 == 54
    types = dict(table.dtypes)
    assert types["host_age_days"] == "int"
    assert types["has_reviews"] == types["review_score_missing"] == "double"
    assert found["1"].host_age_days == -31 and found["2"].host_age_days is None
    assert found["2"].beds_per_guest == 1.0 and found["1"].beds_per_guest is None
    assert found["1"].review_score_missing == 1.0 and found["1"].has_reviews == 0.0
    # An absent category is one level and keeps its place; an absent raw column
    # leaves the feature null.
    assert found["1"].neighbourhood_grouped == "unknown" and found["1"].bedrooms is None


def test_same_levels_on_other_rows(spark):
    columns = ["id", "price", "accommodates", "neighbourhood_cleansed"]
    train = _clean_rows(spark, [("1", "$60", "2", "North")], columns)
    other = _clean_rows(spark, [("2", "$60", "2", "South"), ("3", "$60", "2", "North")], columns)
    spec = listing.LISTING_FEATURES
    levels = grouper(spec).fit(train)
    rows = build_features(other, spec, carry=["listing_id"], groups=levels).collect()
    assert {r.listing_id: r.neighbourhood_grouped for r in rows} == {"2": "outros", "3": "North"}


def test_the_three_lists_cover_the_clean_table(spark):
    spec = listing.LISTING_FEATURES
    clean = _clean_rows(spark, [("1",)], ["id"])
    spec.check(clean)
    used = set(spec.features()) & set(clean.columns)
    assert len(used) == 40 and len(spec.excluded) == 20 and len(clean.columns) == 60
    assert len(spec.made()) == 13


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"nums": ["beds", "beds"]}, "used twice"),
        ({"nums": ["listing_id"]}, "excluded but used"),
        ({"nums": ["price"]}, "excluded but used"),
        ({"nums": ["nowhere"]}, "not in the table"),
        ({"nums": ["beds"]}, "neither used nor excluded"),
        ({"excluded": {"listing_id": "id"}}, "label not excluded"),
    ],
)
def test_leaks_are_refused(spark, change, problem):
    spec = replace(listing.LISTING_FEATURES, **change)
    with pytest.raises(ValueError, match=problem):
        spec.check(_clean_rows(spark, [("1",)], ["id"]))


def test_own_spec_on_an_own_table(spark):
    df = spark.createDataFrame(
        [("k1", 10.0, "red", 2.0), ("k2", 20.0, "blue", 4.0), ("k3", 30.0, "red", None)],
        "key string, y double, colour string, size double",
    )
    spec = FeatureSpec(
        label="y", cats=["shade"], nums=["size", "half"],
        excluded={"key": "identifier", "y": "label", "colour": "grouped"},
        groups=[Group("colour", 1, "shade")],
        derived={"half": lambda: F.col("size") / 2},
    )
    rows = {tuple(r) for r in build_features(df, spec, carry=["key"]).collect()}
    assert rows == {
        ("k1", 10.0, "red", 2.0, 1.0), ("k2", 20.0, "other", 4.0, 2.0),
        ("k3", 30.0, "red", None, None),
    }
