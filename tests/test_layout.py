"""Tables laid out so that range filters skip row groups."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablefit.sources.layout import clustered
from tablefit.sources.tables import publish_table, read_published, read_table, write_table


def _rows(df):
    return sorted(map(repr, df.collect()))


def _groups(path, ranges):
    """Row groups in all, and those whose least and greatest values meet every range."""
    total = met = 0
    for file in path.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            total += 1
            met += all(
                stats[n].has_min_max and stats[n].min <= high and stats[n].max >= low for n, (low, high) in ranges.items()
            )
    return total, met


@pytest.fixture(scope="module")
def table(spark):
    cell = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("int") for i in range(3)]
    return spark.range(40_000).select("id", cell[0].alias("x"), (cell[1] / 7.0).alias("y"), F.date_add(F.lit("2000-01-01"), cell[2]).alias("d"))


def test_filters_on_any_column_read_few_row_groups(spark, table, tmp_path):
    kept = {}
    for name, write in {
        "plain": {"partitions": 64}, "sorted": None, "clustered": {"partitions": 64, "cluster_by": ["x", "y"]},
    }.items():
        path = tmp_path / name
        if write is None:
            table.repartitionByRange(64, "x").write.parquet(str(path))
        else:
            write_table(table, str(path), **write)
        kept[name] = [_groups(path, ranges) for ranges in (
            {"x": (100, 150)}, {"y": (20.0, 27.0)}, {"x": (100, 150), "y": (20.0, 27.0)},
        )]
    assert all(met == total for total, met in kept["plain"])
    (_, by_x), (total, by_y), (_, by_both) = kept["clustered"]
    # each column alone reads about the root of all groups, both nearly one
    assert total >= 60 and by_x <= total / 3 and by_y <= total / 3 and by_both <= 8
    assert kept["sorted"][1][1] == kept["sorted"][1][0]
    assert _rows(read_table(spark, str(tmp_path / "clustered"))) == _rows(table)


def test_the_filters_reach_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "pushed")
    write_table(table, path, cluster_by=["x", "y", "d"])
    for where, pushed in (("x >= 900", "GreaterThanOrEqual(x,900)"), ("y <= 27", "LessThanOrEqual(y,27.0)")):
        rows = read_table(spark, path).filter(where).select("id")
        assert pushed in rows._jdf.queryExecution().toString()
        assert _rows(rows) == _rows(table.filter(where).select("id"))


def test_a_hot_value_is_spread(spark):
    """Half of all rows share one key."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("x"))
    sizes = clustered(rows, ["x"], 16).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 16 and max(s["count"] for s in sizes) < 2 * 20_000 / 16


ODD = [(1, None, 1.0), (2, 5, float("nan")), (3, 5, float("inf")), (4, -5, float("-inf")), (None, None, None), (4, -5, 0.0), (4, -5, 0.0)]


def test_edge_cases(spark, table, tmp_path):
    odd = spark.createDataFrame(ODD, "key int, x int, y double")
    assert _rows(clustered(odd, ["x", "y"], 3)) == _rows(odd)
    empty = clustered(odd.limit(0), ["x", "y"])
    assert empty.columns == odd.columns and empty.count() == 0
    assert clustered(odd, []) is odd
    nothing = odd.select("key", F.lit(None).cast("double").alias("x"))
    assert _rows(clustered(nothing, ["x"])) == _rows(nothing)
    with pytest.raises(ValueError, match="string"):
        clustered(spark.createDataFrame([("a",)], "x string"), ["x"])
    with pytest.raises(ValueError, match="at most 31"):
        clustered(odd, ["x"] * 32)
    with pytest.raises(ValueError, match="either"):
        write_table(odd, str(tmp_path / "both"), partition_by=["key"], cluster_by=["x"])
    publish_table(table, str(tmp_path / "published"), cluster_by=["x", "d"])
    assert read_published(spark, str(tmp_path / "published")).count() == 40_000


def test_rows_are_made_once(spark, tmp_path):
    """Quantiles, ranges and the write itself read a kept table, not the input's own steps again."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    rows = spark.range(1000).select("id", F.udf(count, "long")("id").alias("x"))
    write_table(rows, str(tmp_path / "out"), partitions=4, cluster_by=["x"])
    assert made.value == 1000
    assert _rows(read_table(spark, str(tmp_path / "out"))) == _rows(spark.range(1000).selectExpr("id", "id AS x"))
