"""Grouping, joins, derived features, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.listings import clean, feature_rows, with_steps
from checks.registry import query
from checks.summaries import SAMPLE_PLACE, sql_place
from tablefit import listing
from tablefit.functions.hashing import unit_hash
from tablefit.operators import prep
from tablefit.operators.grouping import Group, TopNGrouper, left_join_levels
from tablefit.operators.sampling import sample, sample_n, split
from tablefit.plans.feature_table import filter_ranges, grouper
from tablefit.plans.price_model import split_features

SPEC = listing.LISTING_FEATURES


def filtered(spark, sf_dir):
    return filter_ranges(clean(spark, sf_dir), SPEC)


@query(with_steps("features", """
SELECT listing_id, neighbourhood_cleansed, neighbourhood_grouped, property_type,
       property_type_grouped
FROM features
"""))
def top_n_group(spark, sf_dir):
    rows = filtered(spark, sf_dir).select("listing_id", "neighbourhood_cleansed", "property_type")
    return grouper(SPEC).fit(rows).transform(rows)


@query(with_steps("filtered", """
SELECT f.listing_id, CASE WHEN t.level IS NULL THEN 'other' ELSE f.property_type END AS grouped
FROM filtered f LEFT JOIN (
    SELECT property_type AS level FROM filtered WHERE property_type IS NOT NULL
    GROUP BY property_type ORDER BY COUNT(*) DESC, property_type LIMIT 3
) t ON f.property_type = t.level
"""))
def top_n_group_without_null(spark, sf_dir):
    rows = filtered(spark, sf_dir).select("listing_id", "property_type")
    groups = [Group("property_type", 3, "grouped")]
    model = TopNGrouper(groups, null_takes_place=False).fit(rows)
    return model.transform(rows).select("listing_id", "grouped")


@query(with_steps("levels_neighbourhood_grouped", """
SELECT f.listing_id, f.neighbourhood_cleansed, n.level AS top_level
FROM filtered f LEFT JOIN levels_neighbourhood_grouped n ON f.neighbourhood_cleansed = n.level
"""))
def join_left_top_neighbourhoods(spark, sf_dir):
    return _joined(spark, sf_dir, "neighbourhood_cleansed")


@query(with_steps("levels_property_type_grouped", """
SELECT f.listing_id, f.property_type, p.level AS top_level
FROM filtered f LEFT JOIN levels_property_type_grouped p ON f.property_type = p.level
"""))
def join_left_top_property_types(spark, sf_dir):
    return _joined(spark, sf_dir, "property_type")


def _joined(spark, sf_dir, column):
    rows = filtered(spark, sf_dir).select("listing_id", column)
    group = next(g for g in SPEC.groups if g.column == column)
    table, size = TopNGrouper([group]).fit(rows).tables[group.output]
    return left_join_levels(rows, column, table, size, "top_level")


_ROUNDED = ["log_number_of_reviews", "log_reviews_per_month", "log_minimum_nights",
            "log_host_listings_count"]


def _rounded_sql(names: list[str]) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" if n in _ROUNDED else n for n in names)


def _rounded(names: list[str]):
    return [F.round(n, 9).alias(n) if n in _ROUNDED else F.col(n) for n in names]


_DERIVED = ["listing_id", *SPEC.derived]
_TABLE = [SPEC.label, *SPEC.cats, *SPEC.nums]


@query(with_steps("features", f"SELECT {_rounded_sql(_DERIVED)} FROM features"))
def derived_features(spark, sf_dir):
    rows = filtered(spark, sf_dir)
    made = rows.withColumns({name: make() for name, make in SPEC.derived.items()})
    return made.select(*_rounded(_DERIVED))


@query(with_steps("features", f"SELECT {_rounded_sql(['listing_id', *_TABLE])} FROM features"))
def feature_table(spark, sf_dir):
    return feature_rows(spark, sf_dir).select(*_rounded(["listing_id", *_TABLE]))


@query(with_steps("clean", f"""
SELECT listing_id, price FROM clean WHERE {SAMPLE_PLACE} < 0.1::DOUBLE
"""))
def hash_sample(spark, sf_dir):
    return sample(clean(spark, sf_dir), "listing_id", 0.1).select("listing_id", "price")


@query(with_steps("features", f"""
SELECT listing_id, price, room_type FROM features
ORDER BY {SAMPLE_PLACE}, listing_id LIMIT 5000
"""))
def sample_rows(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select("listing_id", "price", "room_type")
    return sample_n(rows, "listing_id", 5000)


_ORDER_PLACE = sql_place("o_orderkey || ':' || o_custkey", "sample", seed=7)


@query(f"""
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY {_ORDER_PLACE}, o_orderkey LIMIT 1000
""")
def topk_random(spark, sf_dir):
    """A sample by a key of two columns and another seed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    picked = sample_n(orders, ["o_orderkey", "o_custkey"], 1000, seed=7)
    return picked.select("o_orderkey", "o_totalprice")


_TRAINING = f"{sql_place('host_id', 'split')} < 0.8::DOUBLE"


def _train_top(column: str, n: int) -> str:
    return f"""
    SELECT {column} AS level FROM filtered WHERE {_TRAINING} GROUP BY {column}
    ORDER BY COUNT(*) DESC, {column} ASC NULLS LAST LIMIT {n}"""


@query(with_steps("filtered", f"""
WITH places AS ({_train_top('neighbourhood_cleansed', 20)}),
kinds AS ({_train_top('property_type', 12)})
SELECT listing_id, CASE WHEN {_TRAINING} THEN 'train' ELSE 'test' END AS side, price,
       coalesce(places.level, 'outros') AS neighbourhood_grouped,
       coalesce(kinds.level, 'outros') AS property_type_grouped
FROM filtered
LEFT JOIN places ON neighbourhood_cleansed = places.level
LEFT JOIN kinds ON property_type = kinds.level
"""))
def feature_table_by_side(spark, sf_dir):
    """Split by host first, frequent levels from the training rows."""
    sides = split_features(
        clean(spark, sf_dir), SPEC, "listing_id", group_key="host_id", carry=["listing_id"]
    )
    train, test = (
        rows.select(
            "listing_id", F.lit(side).alias("side"), "price",
            "neighbourhood_grouped", "property_type_grouped",
        )
        for rows, side in zip(sides, ["train", "test"])
    )
    return train.unionByName(test)


def _sides(key, group_key=None):
    def run(spark, sf_dir):
        rows = clean(spark, sf_dir).select("listing_id", "host_id", "price")
        train, test = split(rows, key, 0.8, group_key=group_key)
        sides = train.withColumn("side", F.lit("train"))
        return sides.unionByName(test.withColumn("side", F.lit("test")))

    return run


def _sides_sql(key: str) -> str:
    return with_steps("clean", f"""
    SELECT listing_id, host_id, price,
           CASE WHEN {sql_place(key, 'split')} < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS side
    FROM clean
    """)


query(_sides_sql("listing_id"), name="hash_split")(_sides("listing_id"))
query(_sides_sql("host_id"), name="group_split")(_sides("listing_id", "host_id"))


@query(f"""
SELECT l_orderkey, l_linenumber, {sql_place('l_orderkey', 'split')} AS place FROM lineitem
""")
def row_hash(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", unit_hash("l_orderkey").alias("place"))


@query("""
SELECT o_orderkey, CASE WHEN t.level IS NULL THEN 'other' ELSE CAST(o_custkey AS VARCHAR) END AS grouped
FROM orders LEFT JOIN (
    SELECT CAST(o_custkey AS VARCHAR) AS level FROM orders GROUP BY o_custkey
    ORDER BY COUNT(*) DESC, CAST(o_custkey AS VARCHAR) LIMIT 1500
) t ON CAST(o_custkey AS VARCHAR) = t.level
""")
def top_n_group_wide(spark, sf_dir):
    """More than a thousand levels."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    model = TopNGrouper([Group("o_custkey", 1500, "grouped")]).fit(orders)
    return model.transform(orders).select("o_orderkey", "grouped")


@query("""
SELECT l_orderkey, CAST(l.place AS DOUBLE) AS level_index
FROM (SELECT *, l_orderkey || '-' || l_linenumber AS k FROM lineitem) JOIN (
    SELECT k, row_number() OVER (ORDER BY COUNT(*) DESC, k) - 1 AS place
    FROM (SELECT l_orderkey || '-' || l_linenumber AS k FROM lineitem) GROUP BY k
) l USING (k)
""")
def string_index_wide(spark, sf_dir):
    """One level per line: tens of thousands."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = F.concat_ws("-", "l_orderkey", "l_linenumber")
    rows = lines.select("l_orderkey", level.alias("level"))
    return prep.index(["level"]).fit(rows).transform(rows).select("l_orderkey", "level_index")


@query("""
SELECT COUNT(*) AS rows_out, TRUE AS repeatable
FROM (SELECT 1 FROM lineitem LIMIT 100)
""")
def sample_rows_with_nulls(spark, sf_dir):
    """A hot key whose rows differ only in where their nulls are: any layout gives one sample."""
    text = F.concat_ws("", F.lit("v"), (F.col("l_linenumber") % 3).cast("string"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.alias("v"))
    swap = F.col("l_orderkey") % 2 == 0
    rows = lines.select(
        F.lit("same").alias("key"), F.when(swap, F.col("v")).alias("a"), F.when(~swap, F.col("v")).alias("b")
    )
    counted = [
        sample_n(rows.repartition(n), "key", 100).groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("layout", F.lit(n))
        for n in (1, 7)
    ]
    both = counted[0].unionAll(counted[1])
    same = both.groupBy("a", "b").agg((F.countDistinct("n") == 1).alias("one"), F.count("*").alias("layouts"))
    total = F.sum("n").over(Window.partitionBy("layout"))
    rows_out = both.withColumn("total", total).agg(F.max("total")).first()[0]
    return same.agg(
        F.lit(rows_out).cast("bigint").alias("rows_out"),
        F.every((F.col("one")) & (F.col("layouts") == 2)).alias("repeatable"),
    )
