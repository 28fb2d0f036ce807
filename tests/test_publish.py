"""Tables that a failed job leaves alone, and digests that notice a changed value."""

import pytest
from pyspark.sql import functions as F

from tablefit.operators.summary import reconcile_values, value_digest
from tablefit.sources.tables import publish_table, read_published


def _versions(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = tmp_path / "table"
    publish_table(spark.range(10), str(path))
    failing = spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publish_table(failing, str(path))
    assert read_published(spark, str(path)).count() == 10
    publish_table(spark.range(20), str(path))
    assert read_published(spark, str(path)).count() == 20


def test_a_reader_that_has_begun_keeps_its_version(spark, tmp_path):
    path = tmp_path / "table"
    publish_table(spark.range(10), str(path))
    early = read_published(spark, str(path))
    publish_table(spark.range(20), str(path))
    assert early.count() == 10 and len(_versions(path)) == 2
    publish_table(spark.range(30), str(path), keep=0)
    assert len(_versions(path)) == 1 and read_published(spark, str(path)).count() == 30


def test_publishing_what_was_read(spark, tmp_path):
    """The old version is an input of the new one."""
    path = str(tmp_path / "table")
    publish_table(spark.range(10), path)
    publish_table(read_published(spark, path).union(spark.range(5)), path, partitions=2)
    assert read_published(spark, path).count() == 15


def test_no_table(spark, tmp_path):
    with pytest.raises(Exception, match="_current"):
        read_published(spark, str(tmp_path / "none"))


ROWS = [("a", 1, 1.5), ("a", 2, None), ("a", 2, None), ("b", None, -0.5), (None, 3, 2.5), ("c", 4, 4.0)]
SCHEMA = "k string, n int, x double"


def _found(spark, changed):
    before, after = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(changed, SCHEMA).repartition(3)
    rows = reconcile_values(before, after, "k").collect()
    return {r.k: (r.rows_before, r.rows_after, r.difference, r.same_values) for r in rows}


def test_order_does_not_matter(spark):
    found = _found(spark, ROWS[::-1])
    assert found == {"a": (3, 3, 0, True), "b": (1, 1, 0, True), None: (1, 1, 0, True), "c": (1, 1, 0, True)}


@pytest.mark.parametrize("place, row", [
    (0, ("a", 1, 1.25)), (1, ("a", 2, 0.0)), (1, ("a", None, None)), (2, ("a", 1, 1.5)), (4, (None, None, 2.5)), (3, ("b", 0, -0.5)),
])
def test_one_altered_cell_is_reported(spark, place, row):
    changed = [*ROWS[:place], row, *ROWS[place + 1:]]
    found = _found(spark, changed)
    assert {k for k, v in found.items() if not v[3]} == {row[0]}
    assert all(v[2] == 0 for v in found.values())


def test_values_that_change_columns_are_reported(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, n int, m int")
    swapped = spark.createDataFrame([("a", 2, 1)], "k string, n int, m int")
    assert not reconcile_values(df, swapped, "k").first().same_values
    assert value_digest(df, "k").first().rows == 1


def test_rows_on_one_side_only(spark):
    found = _found(spark, [*ROWS[:5], ("d", 4, 4.0)])
    assert found["c"] == (1, 0, -1, False) and found["d"] == (0, 1, 1, False)
