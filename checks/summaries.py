"""Counts, distributions, group summaries and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.listings import RAW_COLUMNS, clean, feature_rows, raw, sql_round, with_steps
from checks.registry import query
from tablefit.operators import summary
from tablefit.operators.sampling import sample_n
from tablefit.sources.tables import register, written


@query(with_steps("clean", "SELECT COUNT(*) AS total_rows FROM clean"))
def agg_count(spark, sf_dir):
    return summary.row_count(clean(spark, sf_dir))


@query(with_steps("clean", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price,
       quantile_disc(price, 0.25) AS p25, quantile_disc(price, 0.5) AS median,
       quantile_disc(price, 0.75) AS p75, max(price) AS max_price
FROM clean WHERE price IS NOT NULL
"""))
def distribution_price(spark, sf_dir):
    return summary.distribution(clean(spark, sf_dir), "price", exact=True)


@query(f"""
SELECT COUNT(*) AS total, {sql_round('avg(l_quantity)')} AS avg_l_quantity,
       quantile_disc(l_quantity, 0.01) AS p1, quantile_disc(l_quantity, 0.5) AS median,
       quantile_disc(l_quantity, 0.999) AS p99_9,
       {sql_round('stddev_samp(l_quantity)')} AS stddev_l_quantity,
       min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity
FROM lineitem
""")
def distribution_quantity(spark, sf_dir):
    """Percentiles of a column with few values and many repeats."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return summary.distribution(
        lines, "l_quantity", probs=[0.01, 0.5, 0.999], exact=True, std=True, minimum=True
    )


PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def close_ranks(rows, found, column, probs, accuracy=10_000):
    """`found` with each percentile replaced by whether its rank is within 1/accuracy of the rows."""
    known = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    row, kinds = found.first(), dict(found.dtypes)
    n, close = F.count(F.lit(1)), []
    for name, p in probs.items():
        below, upto = F.count_if(F.col("v") < row[name]), F.count_if(F.col("v") <= row[name])
        # and one row, as a rank is a whole number
        slack = n / accuracy + 1
        close.append(((below <= p * n + slack) & (upto >= p * n - slack)).alias(name))
    others = [F.lit(row[c]).cast(kinds[c]).alias(c) for c in found.columns if c not in probs]
    return known.agg(*others, *close)


@query(with_steps("clean", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price, max(price) AS max_price,
       TRUE AS p25, TRUE AS median, TRUE AS p75
FROM clean WHERE price IS NOT NULL
"""))
def distribution_approximate(spark, sf_dir):
    """The single-pass form: its percentiles are within their rank error."""
    rows = clean(spark, sf_dir)
    return close_ranks(rows, summary.distribution(rows, "price"), "price", PROBS)


@query(with_steps("clean", f"""
SELECT room_type, COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price
FROM clean WHERE price IS NOT NULL GROUP BY room_type
"""))
def group_mean_room_type(spark, sf_dir):
    return summary.group_summary(clean(spark, sf_dir), "room_type", "price")


@query(with_steps("clean", f"""
SELECT neighbourhood_cleansed, COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price
FROM clean WHERE price IS NOT NULL GROUP BY neighbourhood_cleansed
ORDER BY total DESC, neighbourhood_cleansed ASC NULLS LAST LIMIT 15
"""))
def group_mean_top15(spark, sf_dir):
    return summary.group_summary(clean(spark, sf_dir), "neighbourhood_cleansed", "price", limit=15)


@query(with_steps("clean", "SELECT room_type, COUNT(*) AS total FROM clean GROUP BY room_type"))
def group_count(spark, sf_dir):
    return summary.group_count(clean(spark, sf_dir), "room_type")


@query(with_steps("raw", """
SELECT property_type, COUNT(*) AS total FROM raw GROUP BY property_type
ORDER BY total DESC, property_type ASC NULLS LAST
"""))
def sort_desc(spark, sf_dir):
    return summary.group_count(raw(spark, sf_dir), "property_type")


@query(with_steps("features", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price,
       quantile_disc(price, 0.5) AS median, {sql_round('stddev_samp(price)')} AS stddev_price,
       min(price) AS min_price, max(price) AS max_price
FROM features
"""))
def target_summary(spark, sf_dir):
    return summary.distribution(
        feature_rows(spark, sf_dir), "price", probs=[0.5], exact=True, std=True, minimum=True
    )


@query(with_steps("features", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price, TRUE AS median,
       {sql_round('stddev_samp(price)')} AS stddev_price, min(price) AS min_price, max(price) AS max_price
FROM features
"""))
def target_summary_approximate(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    found = summary.distribution(rows, "price", probs=[0.5], std=True, minimum=True)
    return close_ranks(rows, found, "price", {"median": 0.5})


def sql_place(key: str, use: str, seed: int = 42) -> str:
    """A row's place in [0, 1) for the SQL check."""
    digest = f"md5('{use}:{seed}:' || {key})"
    return f"('0x' || substr({digest}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


SAMPLE_PLACE = sql_place("listing_id", "sample")


@query(with_steps("features", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price,
       quantile_disc(price, 0.5) AS median, min(price) AS min_price, max(price) AS max_price
FROM (SELECT price FROM features ORDER BY {SAMPLE_PLACE}, listing_id LIMIT 5000)
"""))
def sample_summary(spark, sf_dir):
    rows = written(sample_n(written(feature_rows(spark, sf_dir), "features"), "listing_id", 5000), "sample")
    return summary.distribution(rows, "price", probs=[0.5], exact=True, minimum=True)


@query(with_steps("features", f"""
SELECT COUNT(*) AS total, {sql_round('avg(price)')} AS avg_price, TRUE AS median,
       min(price) AS min_price, max(price) AS max_price
FROM (SELECT price FROM features ORDER BY {SAMPLE_PLACE}, listing_id LIMIT 5000)
"""))
def sample_summary_approximate(spark, sf_dir):
    rows = written(sample_n(written(feature_rows(spark, sf_dir), "features"), "listing_id", 5000), "sample")
    found = summary.distribution(rows, "price", probs=[0.5], minimum=True)
    return close_ranks(rows, found, "price", {"median": 0.5})


@query("""
SELECT COUNT(*) AS total, round(avg(l_tax), 6) AS avg_l_tax, quantile_disc(l_tax, 0.5) AS median,
       max(l_tax) AS max_l_tax
FROM lineitem WHERE l_linenumber % 4 != 0 AND l_tax IS NOT NULL
""")
def distribution_without_nan(spark, sf_dir):
    """NaN is no value, in any figure; every fourth line has one."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = F.when(F.col("l_linenumber") % 4 == 0, float("nan")).otherwise(F.col("l_tax"))
    rows = lines.select(odd.alias("l_tax"))
    return summary.distribution(rows, "l_tax", probs=[0.5], exact=True, digits=6)


@query(with_steps("clean", """
SELECT snapshot_year, room_type, COUNT(*) AS total, SUM(price) AS price_sum FROM clean
GROUP BY snapshot_year, room_type
"""))
def register_view(spark, sf_dir):
    register(clean(spark, sf_dir), "listings_clean")
    return spark.sql("""
        SELECT snapshot_year, room_type, COUNT(*) AS total, SUM(price) AS price_sum
        FROM listings_clean GROUP BY snapshot_year, room_type
    """)


@query(with_steps("raw", """
SELECT neighbourhood_cleansed, rows_before, rows_after, rows_after - rows_before AS difference
FROM (
    SELECT neighbourhood_cleansed, COUNT(*) AS rows_before,
           COUNT(*) FILTER (WHERE TRIM(room_type) = 'Private room') AS rows_after
    FROM raw GROUP BY neighbourhood_cleansed
)
"""))
def reconcile(spark, sf_dir):
    before = written(raw(spark, sf_dir).select("neighbourhood_cleansed", "room_type"), "raw")
    after = before.filter(F.trim("room_type") == "Private room")
    return summary.reconcile(before, after, "neighbourhood_cleansed")


def _profile_sql() -> str:
    rows = [
        f"SELECT {i} AS position, '{c}' AS \"column\", 'string' AS type, COUNT(*) AS rows, "
        f"COUNT(*) - COUNT({c}) AS nulls FROM raw"
        for i, c in enumerate(RAW_COLUMNS)
    ]
    return with_steps("raw", "\nUNION ALL ".join(rows)).replace("raw AS (", "raw AS MATERIALIZED (", 1)


@query(_profile_sql())
def table_profile(spark, sf_dir):
    """Every column of the raw table."""
    return summary.profile(raw(spark, sf_dir))
