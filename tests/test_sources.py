"""CSV and Parquet files, kept tables, and counts around a write."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablefit import listing
from tablefit.operators.summary import profile, reconcile
from tablefit.plans.convert import convert_csv
from tablefit.sources.csv import normalize_names, read_text_csv, with_source_file
from tablefit.sources.tables import (
    cached, read_table, register, shared_path, tune, write_table, written,
)


@pytest.mark.parametrize(
    "names, expected",
    [
        (["price", "price"], ["price", "price_2"]),
        ([" a ", "a", "a"], ["a", "a_2", "a_3"]),
        (["price", "price", "price_2"], ["price", "price_3", "price_2"]),
        (["price_2", "price", "price"], ["price_2", "price", "price_3"]),
        (["x", "", None, " "], ["x", "_c1", "_c2", "_c3"]),
        (["_c1", ""], ["_c1", "_c1_2"]),
        (["Id", "id"], ["Id", "id_2"]),
    ],
)
def test_normalize_names(names, expected):
    assert normalize_names(names) == expected
    lowered = [n.lower() for n in normalize_names(names)]
    assert len(set(lowered)) == len(lowered)


def _write(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'id,note\n1,"two\nlines"\n2,"say ""hi"", ok"\n3,\n4,""\n')
    rows = [tuple(r) for r in read_text_csv(spark, path).collect()]
    assert rows == [("1", "two\nlines"), ("2", 'say "hi", ok'), ("3", None), ("4", None)]


def test_without_multiline_a_break_ends_the_row(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'id,note\n1,"two\nlines"\n2,x\n')
    assert read_text_csv(spark, path, multiline=False).count() == 3


def test_short_and_long_rows(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "a,b,c\n1\n1,2,3,4\n")
    rows = [tuple(r) for r in read_text_csv(spark, path).collect()]
    assert rows == [("1", None, None), ("1", "2", "3")]


def test_repeated_and_blank_header_names(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "price , price,,price_2\n1,2,3,4\n")
    df = read_text_csv(spark, path)
    assert df.columns == ["price", "price_3", "_c2", "price_2"]
    assert tuple(df.first()) == ("1", "2", "3", "4")


def test_directory_of_files_with_names(spark, tmp_path):
    _write(tmp_path / "a.csv", "id,x\n1,a\n2,b\n")
    _write(tmp_path / "b.csv", "id,x\n3,c\n")
    df = with_source_file(read_text_csv(spark, str(tmp_path)))
    assert {tuple(r) for r in df.select("id", "source_file").collect()} == {
        ("1", "a.csv"), ("2", "a.csv"), ("3", "b.csv"),
    }
    assert df.rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("multiline", [True, False])
def test_file_with_another_header_fails(spark, tmp_path, multiline):
    _write(tmp_path / "a.csv", "id,x\n1,a\n2,b\n")
    _write(tmp_path / "b.csv", "x,id\nc,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_text_csv(spark, str(tmp_path), multiline).collect()


def test_empty_file(spark, tmp_path):
    with pytest.raises(Exception):
        read_text_csv(spark, _write(tmp_path / "a.csv", ""))


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "t")
    counts = write_table(
        spark.range(100), path, partitions=7, observed=[F.count(F.lit(1)).alias("n")]
    )
    assert counts == {"n": 100}
    assert len(list((tmp_path / "t").glob("*.snappy.parquet"))) == 7
    write_table(spark.range(5), path)
    assert read_table(spark, path).count() == 5


def test_partitioned_write_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    # One key holds most of the rows.
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 4))
    write_table(df, path, partition_by=["k"])
    kept = read_table(spark, path).filter("k = 1")
    assert kept.count() == df.filter("k = 1").count()
    assert "PartitionFilters: [isnotnull(k" in kept._jdf.queryExecution().toString()


def test_shared_path_is_in_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    paths = {shared_path(spark, "x") for _ in range(3)}
    assert len(paths) == 3 and all(p.startswith(base) for p in paths)


def test_written_cuts_the_plan(spark):
    df = written(spark.range(10).withColumn("x", F.rand()))
    assert "Rand" not in df._jdf.queryExecution().toString()
    assert df.collect() == df.collect()


def test_cached_is_released(spark):
    df = spark.range(10).withColumn("y", F.col("id") * 3)
    with cached(df) as kept:
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
        assert kept.count() == 10
    assert not df.storageLevel.useMemory


def test_register(spark):
    register(spark.range(3), "three_rows")
    assert spark.sql("SELECT COUNT(*) FROM three_rows").first()[0] == 3


def test_tune_changes_a_setting_only(spark):
    assert tune(spark) is spark
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


@pytest.mark.parametrize("before, tasks", [(None, 3), ("1", 3), ("1000000", None)])
def test_tune_cuts_several_tasks_a_core(spark, before, tasks):
    """A larger number that is set stays."""
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.minPartitionNum"):
        try:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
            tune(spark)
            wanted = int(before) if tasks is None else tasks * spark.sparkContext.defaultParallelism
            assert int(spark.conf.get(name)) == wanted
        finally:
            spark.conf.unset(name)
            tune(spark)


def test_convert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    header = "id,room_type,price,last_scraped\n"
    _write(source / "a.csv", header + '1,Shared room,"$1,000.00",2020-02-03\n2,Boat,$5,2020-02-03\n')
    _write(source / "b.csv", header + "3,Shared room,abc,nonsense\n4,Hotel room,$7.50,2021-01\n")
    target = str(tmp_path / "out")
    check = convert_csv(spark, str(source), target, listing.LISTING_CLEAN, partitions=2)
    assert {tuple(r) for r in check.collect()} == {
        ("Entire home/apt", 0, 0, 0, 0), ("Private room", 0, 0, 0, 0),
        ("Shared room", 2, 2, 0, 0), ("Hotel room", 1, 1, 0, 0),
    }
    rows = {r.listing_id: r for r in read_table(spark, target).collect()}
    assert {k: r.price for k, r in rows.items()} == {"1": 1000.0, "3": None, "4": 7.5}
    assert {k: r.source_file for k, r in rows.items()} == {"1": "a.csv", "3": "b.csv", "4": "b.csv"}
    assert rows["4"].snapshot_month == 1.0 and rows["3"].snapshot_year is None


def test_reconcile_with_null_keys_and_missing_sides(spark):
    before = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    after = spark.createDataFrame([("a",), (None,), ("c",)], "k string")
    assert {tuple(r) for r in reconcile(before, after, "k").collect()} == {
        ("a", 2, 1, -1), (None, 1, 1, 0), ("b", 1, 0, -1), ("c", 0, 1, 1),
    }


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in profile(df).collect()] == [
        (0, "a", "int", 2, 0), (1, "b", "string", 2, 1),
    ]


def test_other_header_with_repeated_names_fails(spark, tmp_path):
    _write(tmp_path / "in" / "a.csv", "id,price,price\n1,2,3\n")
    _write(tmp_path / "in" / "b.csv", "price,id,price\n20,2,30\n")
    with pytest.raises(ValueError, match="different headers"):
        read_text_csv(spark, str(tmp_path / "in"))
    _write(tmp_path / "longer" / "a.csv", "id,price,price\n1,2,3\n")
    _write(tmp_path / "longer" / "b.csv", "id,price,price,x\n1,2,3,4\n")
    with pytest.raises(ValueError, match="different headers"):
        read_text_csv(spark, str(tmp_path / "longer"), multiline=False)
    _write(tmp_path / "same" / "a.csv", "id,price,price\n1,2,3\n")
    _write(tmp_path / "same" / "b.csv", "id,price,price\n4,5,6\n")
    rows = read_text_csv(spark, str(tmp_path / "same")).collect()
    assert sorted(map(tuple, rows)) == [("1", "2", "3"), ("4", "5", "6")]


@pytest.mark.parametrize("multiline", [True, False])
def test_malformed_rows_are_told(spark, tmp_path, multiline):
    _write(tmp_path / "in" / "a.csv", "id,price\n1,2\n3,4,5\n6\n7,\n")
    rows = read_text_csv(spark, str(tmp_path / "in"), multiline, malformed="odd").collect()
    assert sorted((r.id, r.odd) for r in rows) == [("1", False), ("3", True), ("6", True), ("7", False)]


def test_header_case_and_missing_choice(spark, tmp_path):
    _write(tmp_path / "in" / "a.csv", 'ID,Room_Type,PRICE,last_scraped\n1,Shared room,"$1,000.00",2020-02-03\n')
    target = str(tmp_path / "out")
    check = convert_csv(spark, str(tmp_path / "in"), target, listing.LISTING_CLEAN)
    assert {(r.room_type, r.rows_after) for r in check.collect() if r.rows_after} == {("Shared room", 1)}
    assert spark.read.parquet(target).first().price == 1000.0
    _write(tmp_path / "no" / "a.csv", "id,price\n1,2\n")
    with pytest.raises(ValueError, match="room_type"):
        convert_csv(spark, str(tmp_path / "no"), target + "2", listing.LISTING_CLEAN)


def test_stored_tables_go(spark, tmp_path):
    from tablefit.sources.tables import stored

    with stored(spark.range(5)) as table:
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and Path(path).exists()
    assert not Path(path).exists()
