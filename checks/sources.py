"""Reading, writing and checking files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.listings import RAW_COLUMNS, clean, derived_clean, raw, table, with_steps
from checks.registry import query
from tablefit import listing
from tablefit.operators.filters import keep_range
from tablefit.operators.summary import group_count, reconcile_values
from tablefit.plans.convert import convert_csv
from tablefit.sources.csv import read_text_csv, with_source_file
from tablefit.sources.records import read_split_csv
from tablefit.sources.tables import (
    cached,
    publish_table,
    read_published,
    read_table,
    shared_path,
    write_table,
    written,
)


def _write_csv(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, quote='"', escape='"', **plain).csv(path)
    return path


# A note with a quote, a comma and a line break for every third row.
_NOTE = """
CASE WHEN length(TRIM(id)) % 3 = 0
     THEN 'said "' || TRIM(room_type) || '", then' || chr(10) || 'left' ELSE 'plain' END
"""


_AS_READ = ", ".join(f"NULLIF({c}, '') AS {c}" for c in RAW_COLUMNS)


@query(with_steps("raw", f"SELECT {_AS_READ}, {_NOTE} AS note FROM raw"))
def scan_csv_text(spark, sf_dir):
    """Every text column out to CSV and back, with quotes and line breaks inside fields."""
    rows = raw(spark, sf_dir).select(*RAW_COLUMNS, F.expr(_NOTE).alias("note"))
    return read_text_csv(spark, _write_csv(rows, "scan_csv_text"))


@query(with_steps("raw", f"SELECT {_AS_READ}, {_NOTE} AS note FROM raw"))
def scan_csv_split(spark, sf_dir):
    """The same by the reader that splits multi-line files."""
    rows = raw(spark, sf_dir).select(*RAW_COLUMNS, F.expr(_NOTE).alias("note"))
    return read_split_csv(spark, _write_csv(rows, "scan_csv_split"))


# Columns that the newer snapshot lacks, and the order in which it has the others.
_GONE = ["beds", "weekly_price", "host_is_superhost"]
_NEWER = [c for c in reversed(RAW_COLUMNS) if c not in _GONE]


@query(with_steps("raw", f"""
SELECT {', '.join(
    f"CASE WHEN CAST(TRIM(id) AS BIGINT) % 2 = 0 THEN NULLIF({c}, '') END AS {c}" if c in _GONE
    else f"NULLIF({c}, '') AS {c}" for c in RAW_COLUMNS
)} FROM raw
"""))
def scan_csv_two_headers(spark, sf_dir):
    """Two snapshots in one folder, whose headers differ in order and in columns."""
    rows, odd = raw(spark, sf_dir), F.trim("id").cast("bigint") % 2 == 1
    older = _write_csv(rows.where(~odd).select(*RAW_COLUMNS), "two_headers_older")
    newer = _write_csv(rows.where(odd).select(*_NEWER), "two_headers_newer")
    return read_split_csv(spark, [older, newer])


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS price,
       CAST(o_custkey AS VARCHAR) AS price_3, o_orderpriority AS price_2,
       CAST(o_orderdate AS DATE)::VARCHAR AS _c4
FROM orders
""")
def normalize_header(spark, sf_dir):
    """A header with blanks around names, a repeat, a blank name and a name
    that looks like a repeat's."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias(" id "),
        F.col("o_orderstatus").alias("price"),
        F.col("o_custkey").cast("string").alias(" price"),
        F.col("o_orderpriority").alias("price_2"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias(" "),
    )
    return read_text_csv(spark, _write_csv(rows, "normalize_header"))


@query("SELECT 'orders.parquet' AS source_file, COUNT(*) AS total FROM orders")
def source_file(spark, sf_dir):
    return group_count(with_source_file(table(spark, sf_dir, "orders")), "source_file")


@query(with_steps("clean", "SELECT * FROM clean"), name="write_parquet")
def written_table(spark, sf_dir):
    path = shared_path(spark, "write_parquet")
    write_table(derived_clean(spark, sf_dir), path, rebalance=True)
    return read_table(spark, path)


@query(with_steps("clean", """
SELECT CAST(snapshot_year AS INTEGER) AS snapshot_year, COUNT(*) AS total,
       SUM(price) AS price_sum
FROM clean WHERE snapshot_year >= 1997 GROUP BY snapshot_year
"""))
def scan_partitioned(spark, sf_dir):
    """A table written by year and read back for some of the years."""
    path = shared_path(spark, "scan_partitioned")
    years = clean(spark, sf_dir).withColumn("snapshot_year", F.col("snapshot_year").cast("int"))
    write_table(years, path, partition_by=["snapshot_year"])
    kept = read_table(spark, path).filter(F.col("snapshot_year") >= 1997)
    return kept.groupBy("snapshot_year").agg(
        F.count(F.lit(1)).alias("total"), F.sum("price").alias("price_sum")
    )


@query(with_steps("clean", """
SELECT * FROM clean WHERE price BETWEEN 50 AND 200 AND accommodates BETWEEN 2 AND 4 AND snapshot_year >= 1995
"""))
def scan_clustered(spark, sf_dir):
    """A table laid out by price, guests and year, and read back by ranges of all three."""
    path = shared_path(spark, "scan_clustered")
    write_table(derived_clean(spark, sf_dir), path, cluster_by=["price", "accommodates", "snapshot_year"])
    rows = keep_range(read_table(spark, path), "price", 50, 200)
    return keep_range(rows, "accommodates", 2, 4).filter(F.col("snapshot_year") >= 1995)


@query("""
SELECT o_orderstatus, COUNT(*) AS total, MIN(o_orderdate) AS first_order FROM orders
WHERE o_totalprice BETWEEN 50000 AND 400000 GROUP BY o_orderstatus
""")
def scan_parquet(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(F.col("o_totalprice").between(50000, 400000))
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("total"), F.min("o_orderdate").alias("first_order")
    )


@query(with_steps("clean", """
SELECT room_type, COUNT(*) AS rows_before, COUNT(*) AS rows_after, 0::BIGINT AS difference,
       0::BIGINT AS malformed
FROM clean GROUP BY room_type
"""), name="verify_write")
def converted(spark, sf_dir):
    """The whole conversion: CSV in, clean Parquet out, rows checked."""
    source = _write_csv(raw(spark, sf_dir), "convert_source")
    return convert_csv(
        spark, source, shared_path(spark, "convert_target"), listing.LISTING_CLEAN
    )


@query(with_steps("clean", """
SELECT room_type, COUNT(*) AS rows_before, COUNT(*) AS rows_after, 0::BIGINT AS difference,
       0::BIGINT AS malformed
FROM clean GROUP BY room_type
"""))
def convert_split(spark, sf_dir):
    """The whole conversion by the reader that splits files, from two snapshots of different headers."""
    rows, odd = raw(spark, sf_dir), F.trim("id").cast("bigint") % 2 == 1
    older = _write_csv(rows.where(~odd).select(*RAW_COLUMNS), "split_older")
    newer = _write_csv(rows.where(odd).select(*_NEWER), "split_newer")
    target = shared_path(spark, "split_target")
    return convert_csv(spark, [older, newer], target, listing.LISTING_CLEAN, split=True)


@query(with_steps("raw", """
SELECT room_type, COUNT(*) AS rows_before, COUNT(*) AS rows_after, 0::BIGINT AS difference,
       COUNT(*) FILTER (WHERE k % 7 < 2) AS malformed
FROM (SELECT TRIM(room_type) AS room_type, CAST(TRIM(id) AS BIGINT) AS k FROM raw)
WHERE room_type IN ('Entire home/apt', 'Private room', 'Shared room', 'Hotel room') GROUP BY room_type
"""))
def convert_malformed(spark, sf_dir):
    """Rows with a cell too many or too few are converted and counted."""
    id_, kind = F.trim("id"), F.trim("room_type")
    k = id_.cast("bigint") % 7
    ending = F.when(k == 0, ",more,cells").when(k == 1, "").otherwise(",2020-01-01")
    lines = raw(spark, sf_dir).select(F.concat(id_, F.lit(","), kind, ending).alias("value"))
    # one cell a line under a separator that no line holds, so that each task's file begins with the header
    path = shared_path(spark, "malformed")
    named = lines.withColumnRenamed("value", "id,room_type,last_scraped")
    kept_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named.write.options(header=True, sep="\u0001", **kept_blanks).csv(path)
    return convert_csv(spark, path, shared_path(spark, "malformed_target"), listing.LISTING_CLEAN)


@query(with_steps("clean", """
SELECT * EXCLUDE (source_file) REPLACE (
    NULLIF(neighbourhood_cleansed, 'unknown') AS neighbourhood_cleansed
) FROM clean
"""))
def csv_round_trip(spark, sf_dir):
    """The clean table by way of a CSV file, where empty text is a null cell: a
    neighbourhood that was empty stays null instead of 'unknown'."""
    source = _write_csv(raw(spark, sf_dir), "round_trip_source")
    target = shared_path(spark, "round_trip_target")
    convert_csv(spark, source, target, listing.LISTING_CLEAN)
    return read_table(spark, target).drop("source_file")


@query(with_steps("clean", """
SELECT room_type, COUNT(*) AS rows_before, COUNT(*) AS rows_after, 0::BIGINT AS difference,
       0::BIGINT AS malformed, TRUE AS same_values
FROM clean GROUP BY room_type
"""))
def verify_values(spark, sf_dir):
    """The conversion with its values verified, not only its rows."""
    source, target = _write_csv(raw(spark, sf_dir), "verify_values_source"), shared_path(spark, "verify_values")
    return convert_csv(spark, source, target, listing.LISTING_CLEAN, digest=True)


@query(with_steps("clean", """
SELECT room_type, COUNT(*) AS rows_before, COUNT(*) AS rows_after, 0::BIGINT AS difference,
       bool_and(COALESCE(CAST(listing_id AS BIGINT) % 5 != 0 OR price IS NULL, TRUE)) AS same_values
FROM clean GROUP BY room_type
"""))
def altered_values(spark, sf_dir):
    """Equal counts, but a price in five differs: every room type with such a row is reported."""
    before = clean(spark, sf_dir)
    fifth = F.col("listing_id").cast("bigint") % 5 == 0
    after = before.withColumn("price", F.when(fifth, F.col("price") + 1).otherwise(F.col("price")))
    return reconcile_values(before, after, "room_type")


@query(with_steps("clean", "SELECT * FROM clean"))
def published(spark, sf_dir):
    """A table published twice: readers see the second version, whole."""
    path, rows = shared_path(spark, "published"), clean(spark, sf_dir)
    publish_table(rows.where("price > 100"), path)
    publish_table(rows, path, rebalance=True)
    return read_published(spark, path)


@query(with_steps("clean", """
SELECT cancellation_policy, COUNT(*) AS total FROM clean GROUP BY cancellation_policy
"""))
def materialize(spark, sf_dir):
    """One table kept for two uses, in memory and then in the shared folder."""
    with cached(clean(spark, sf_dir).select("cancellation_policy")) as kept:
        table_written = written(kept, "materialize")
    return group_count(table_written, "cancellation_policy")
