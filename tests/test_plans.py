"""What Spark makes of the operators: scans, pushed filters, joins, shuffles."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from checks.listings import clean, feature_rows
from tablefit import listing
from tablefit.operators import evaluate, summary
from tablefit.operators.grouping import Group, TopNGrouper
from tablefit.plans import convert
from tablefit.plans.clean_table import clean_table
from tablefit.plans.feature_table import build_features
from tablefit.sources.tables import COMPILED_METHOD_BYTES

SF_DIR = "/root/testdata/sf0.001"
LAZY = """
agg_count clean_table feature_table derived_features filter_ranges group_count
group_mean_room_type group_mean_top15 hash_sample hash_split group_split metrics
compared_metrics prediction_examples reconcile table_profile target_summary
top_n_group join_left_top_neighbourhoods string_index impute_median sample_rows
""".split()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df):
    return _plan(df).count("FileScan parquet")


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    plan = _plan(entry_module.queries()[name](spark, SF_DIR))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert word not in plan


def test_cleaning_is_one_projection(spark, tmp_path):
    path = str(tmp_path / "raw")
    names = ["id", "room_type", *listing.NUMBERS, *listing.CURRENCIES, *listing.FLAGS, "unused"]
    spark.createDataFrame([tuple("1" for _ in names)], names).write.parquet(path)
    df = clean_table(spark.read.parquet(path), listing.LISTING_CLEAN, "f")
    plan = _plan(df)
    assert "Exchange" not in plan and _scans(df) == 1
    assert "unused" not in plan
    few = _plan(df.select("price"))
    assert re.search(r"ReadSchema: struct<room_type:string,price:string>", few)


def test_feature_filters_reach_the_scan(spark):
    df = feature_rows(spark, SF_DIR)
    plan = _plan(df)
    pushed = df._jdf.queryExecution().toString()
    # the table once, and each short list of levels
    assert _scans(df) == 1 + len(listing.LISTING_FEATURES.groups)
    assert "GreaterThanOrEqual(price,50.0)" in pushed
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    assert "weekly_price" not in plan


def test_the_price_of_features_needs_few_columns(spark):
    plan = _plan(build_features(clean(spark, SF_DIR), listing.LISTING_FEATURES).select("price"))
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "latitude" not in schema and "availability_30" not in schema


def test_groups_are_combined_before_the_shuffle(spark):
    df = clean(spark, SF_DIR)
    for grouped in (
        summary.group_count(df, "room_type"),
        summary.group_summary(df, "room_type", "price"),
        summary.reconcile(df, df, "room_type"),
    ):
        plan = _plan(grouped)
        assert plan.index("partial_") > plan.index("hashpartitioning")
    top = _plan(summary.group_summary(df, "room_type", "price", limit=2))
    assert "TakeOrderedAndProject" in top


def test_one_scan_for_all_metrics(spark):
    df = clean(spark, SF_DIR).select("price", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    found = evaluate.compared_metrics(df, "price", {"one": "a", "two": "b"})
    assert _scans(found) == 1 and _scans(summary.profile(clean(spark, SF_DIR))) == 1


def test_long_lists_of_levels_are_not_broadcast_by_hint(spark, monkeypatch):
    from tablefit.operators import grouping

    monkeypatch.setattr(grouping, "BROADCAST_BYTES", 3)
    df = spark.createDataFrame([("aaaa",), ("bbbb",)], "c string")
    model = TopNGrouper([Group("c", 2, "g")]).fit(df)
    assert "ResolvedHint" not in model.transform(df)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(grouping, "BROADCAST_BYTES", 8)
    assert "ResolvedHint" in model.transform(df)._jdf.queryExecution().analyzed().toString()


def test_levels_are_cut_before_they_meet(spark):
    """The count of levels may be huge; each task hands on the frequent ones only."""
    counts = spark.range(5).selectExpr("'c' AS column", "string(id) AS level", "id AS n")
    grouper = TopNGrouper([Group("c", 2, "a")])
    assert "TakeOrderedAndProject(limit=2" in _plan(grouper._most_frequent(counts, grouper.groups[0]))


@pytest.mark.parametrize("name", ["hash_split", "verify_write"])
def test_queries_compile_their_wide_projections(spark, name):
    limit, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set(limit, 65535)
        entry_module.queries()[name](spark, SF_DIR)
        assert int(spark.conf.get(limit)) == COMPILED_METHOD_BYTES
    finally:
        spark.conf.set(limit, before)


def test_digest_is_a_compiled_column_that_is_not_written(spark, tmp_path, monkeypatch):
    """Observed aggregates are interpreted: they add up the hash of a row, and do not make it."""
    (tmp_path / "x.csv").write_text("id,room_type,price\n1,Private room,$5.00\n2,Private room,\n3,Hotel room,$7.00\n")
    observed = []
    plain = convert.write_table

    def seen(df, path, partitions, by, rebalance, columns, unwritten):
        observed.extend(str(c) for c in columns)
        return plain(df, path, partitions, by, rebalance, columns, unwritten)

    monkeypatch.setattr(convert, "write_table", seen)
    found = convert.convert_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), listing.LISTING_CLEAN, digest=True)
    assert any("sum" in c for c in observed) and not any("xxhash64" in c for c in observed)
    assert convert.DIGEST not in spark.read.parquet(str(tmp_path / "out")).columns
    assert "ExistingRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.room_type: (r.rows_after, r.same_values) for r in found.collect()} == {
        "Private room": (2, True), "Hotel room": (1, True), "Entire home/apt": (0, True), "Shared room": (0, True),
    }
