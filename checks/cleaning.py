"""Column cleaners, the clean table, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.listings import ABSENT, clean, derived_clean, raw, table, with_steps
from checks.registry import query
from tablefit import listing
from tablefit.functions import clean as cleaners
from tablefit.functions import features as feat
from tablefit.operators import filters
from tablefit.plans.feature_table import filter_ranges, project


@query(with_steps("raw", """
SELECT TRIM(id) AS id, NULLIF(TRIM(host_since), '') AS host_since,
       NULLIF(TRIM(neighbourhood_cleansed), '') AS neighbourhood,
       NULLIF(TRIM(room_type), '') AS room_type
FROM raw
"""))
def clean_string(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        cleaners.string(df, "id").alias("id"),
        cleaners.string(df, "host_since").alias("host_since"),
        cleaners.string(df, "neighbourhood_cleansed").alias("neighbourhood"),
        cleaners.string(df, "room_type").alias("room_type"),
    )


@query(with_steps("raw", """
SELECT TRIM(id) AS id,
       CASE WHEN TRIM(property_type) = '' THEN 'unknown' ELSE TRIM(property_type) END
           AS property_type,
       COALESCE(NULLIF(TRIM(neighbourhood_cleansed), ''), 'n/a') AS neighbourhood,
       'unknown' AS bed_type
FROM raw
"""))
def clean_category(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        cleaners.string(df, "id").alias("id"),
        cleaners.category(df, "property_type").alias("property_type"),
        cleaners.category(df, "neighbourhood_cleansed", fill="n/a", fill_null=True)
        .alias("neighbourhood"),
        cleaners.category(df, "bed_type").alias("bed_type"),
    )


def _amount(name: str) -> str:
    return f"TRY_CAST(TRIM(REPLACE(REPLACE({name}, '$', ''), ',', '')) AS DOUBLE) AS {name}"


@query(with_steps("raw", f"""
SELECT TRIM(id) AS id, {_amount('price')}, {_amount('weekly_price')}, {_amount('monthly_price')},
       {_amount('security_deposit')}, {_amount('cleaning_fee')}, {_amount('extra_people')}
FROM raw
"""))
def clean_currency(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        cleaners.string(df, "id").alias("id"),
        *[cleaners.currency(df, name).alias(name) for name in listing.CURRENCIES],
    )


# The parsers' own rules, for the columns that the raw table has.
_HAD_FLAGS = [c for c in listing.FLAGS if c not in ABSENT]
_HAD_NUMBERS = [c for c in [*listing.NUMBERS, "month"] if c not in ABSENT]


def _flag_case(name: str) -> str:
    return (
        f"CASE WHEN lower(trim({name})) = 't' THEN 1.0::DOUBLE "
        f"WHEN lower(trim({name})) = 'f' THEN 0.0::DOUBLE END AS {name}"
    )


@query(with_steps("raw", f"SELECT TRIM(id) AS id, {', '.join(map(_flag_case, _HAD_FLAGS))} FROM raw"))
def clean_flag(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        cleaners.string(df, "id").alias("id"), *[cleaners.flag(df, n).alias(n) for n in _HAD_FLAGS]
    )


@query(with_steps("raw", f"""
SELECT TRIM(id) AS id, {', '.join(f'TRY_CAST(TRIM({c}) AS DOUBLE) AS {c}' for c in _HAD_NUMBERS)} FROM raw
"""))
def clean_number(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        cleaners.string(df, "id").alias("id"), *[cleaners.number(df, n).alias(n) for n in _HAD_NUMBERS]
    )


@query(with_steps("raw", """
SELECT TRIM(id) AS id, TRY_CAST(TRIM(last_scraped) AS DATE) AS last_scraped,
       TRY_CAST(host_since AS DATE) AS host_since,
       TRY_CAST(substr(host_since, 1, 7) || '-01' AS DATE) AS host_since_month
FROM raw
"""))
def clean_date(spark, sf_dir):
    df = raw(spark, sf_dir)
    df = df.withColumn("host_since_month", F.substring("host_since", 1, 7))
    names = ["last_scraped", "host_since", "host_since_month"]
    return df.select(
        cleaners.string(df, "id").alias("id"), *[cleaners.date(df, n).alias(n) for n in names]
    )


@query(with_steps("raw", """
SELECT TRIM(id) AS id,
       CAST(year(TRY_CAST(TRIM(last_scraped) AS DATE)) AS DOUBLE) AS snapshot_year,
       COALESCE(TRY_CAST(TRIM(month) AS DOUBLE),
                CAST(month(TRY_CAST(TRIM(last_scraped) AS DATE)) AS DOUBLE)) AS snapshot_month,
       CAST(month(TRY_CAST(TRIM(last_scraped) AS DATE)) AS DOUBLE) AS month_of_date
FROM raw
"""))
def snapshot_parts(spark, sf_dir):
    df = raw(spark, sf_dir)
    day = cleaners.date(df, "last_scraped")
    return df.select(
        cleaners.string(df, "id").alias("id"),
        feat.year(day).alias("snapshot_year"),
        feat.month(day, cleaners.number(df, "month")).alias("snapshot_month"),
        feat.month(day).alias("month_of_date"),
    )


@query(with_steps("raw", """
SELECT TRIM(id) AS id, CAST(NULL AS VARCHAR) AS no_string, 'unknown' AS no_category,
       CAST(NULL AS DOUBLE) AS no_currency, CAST(NULL AS DOUBLE) AS no_flag,
       CAST(NULL AS DOUBLE) AS no_number, CAST(NULL AS DATE) AS no_date
FROM raw
"""))
def missing_columns(spark, sf_dir):
    df = raw(spark, sf_dir)
    kinds = ["string", "category", "currency", "flag", "number", "date"]
    return df.select(
        cleaners.string(df, "id").alias("id"),
        *[getattr(cleaners, kind)(df, f"no_{kind}").alias(f"no_{kind}") for kind in kinds],
    )


@query(with_steps("clean", "SELECT * FROM clean"), name="clean_table")
def whole_clean_table(spark, sf_dir):
    return derived_clean(spark, sf_dir)


@query(with_steps("raw", """
SELECT TRIM(room_type) AS room_type, COUNT(*) AS total, COUNT(price) AS with_price
FROM raw WHERE TRIM(room_type) IN ('Entire home/apt', 'Hotel room') GROUP BY TRIM(room_type)
"""))
def filter_in_list(spark, sf_dir):
    df = raw(spark, sf_dir).withColumn("room_type", F.trim("room_type"))
    kept = filters.keep_in(df, "room_type", ["Entire home/apt", "Hotel room"])
    return kept.groupBy("room_type").agg(
        F.count(F.lit(1)).alias("total"), F.count("price").alias("with_price")
    )


@query(with_steps("clean", """
SELECT listing_id, price, bathrooms FROM clean
WHERE price IS NOT NULL AND bathrooms IS NOT NULL
"""))
def filter_not_null(spark, sf_dir):
    df = clean(spark, sf_dir).select("listing_id", "price", "bathrooms")
    return filters.keep_not_null(df, ["price", "bathrooms"])


@query(with_steps("clean", """
SELECT listing_id, price, accommodates FROM clean
WHERE price BETWEEN 50 AND 5000 AND accommodates BETWEEN 1 AND 20
"""))
def filter_range(spark, sf_dir):
    df = clean(spark, sf_dir).select("listing_id", "price", "accommodates")
    return filters.keep_range(filters.keep_range(df, "price", 50, 5000), "accommodates", 1, 20)


@query(with_steps("clean", """
SELECT listing_id, bathrooms, bedrooms, beds FROM clean
WHERE (bathrooms IS NULL OR bathrooms BETWEEN 0 AND 10)
  AND (bedrooms IS NULL OR bedrooms BETWEEN 0 AND 10)
  AND (beds IS NULL OR beds BETWEEN 0 AND 5)
"""))
def filter_range_or_null(spark, sf_dir):
    df = clean(spark, sf_dir).select("listing_id", "bathrooms", "bedrooms", "beds")
    for name, high in [("bathrooms", 10), ("bedrooms", 10), ("beds", 5)]:
        df = filters.keep_range(df, name, 0, high, allow_null=True)
    return df


@query(with_steps("filtered", "SELECT * FROM filtered"), name="filter_ranges")
def all_ranges(spark, sf_dir):
    return filter_ranges(clean(spark, sf_dir), listing.LISTING_FEATURES)


# What the spec takes from the clean table; the rest of its columns are derived.
_SPEC = listing.LISTING_FEATURES
_CLEAN = listing.LISTING_CLEAN
_PLAIN = {*_CLEAN.order, *_CLEAN.categories, *_CLEAN.numbers, *_CLEAN.flags}
_CATS = [c for c in _SPEC.cats if c in _PLAIN]
_NUMS = [c for c in _SPEC.nums if c in _PLAIN]


@query(with_steps("clean", f"SELECT {', '.join([_SPEC.label, *_CATS, *_NUMS])} FROM clean"))
def feature_projection(spark, sf_dir):
    """The label and every category and number of the spec that is no derived column."""
    return project(clean(spark, sf_dir), _SPEC.label, _CATS, _NUMS)


def _guard_sql() -> str:
    rows = []
    spec = listing.LISTING_FEATURES
    for name in clean_columns():
        role = (
            "excluded" if name in spec.excluded
            else "category" if name in spec.cats
            else "number"
        )
        reason = spec.excluded.get(name)
        shown = "CAST(NULL AS VARCHAR)" if reason is None else f"'{reason}'"
        rows.append(
            f"SELECT '{name}' AS \"column\", '{role}' AS role, {shown} AS reason, "
            f"COUNT({name}) AS non_null FROM clean"
        )
    return with_steps("clean", "\nUNION ALL ".join(rows))


def clean_columns() -> list[str]:
    spec = listing.LISTING_CLEAN
    return [*spec.order, *spec.categories, *spec.numbers, *spec.currencies, *spec.flags]


@query(_guard_sql())
def leakage_guard(spark, sf_dir):
    """Every clean column with its role in the model, after the spec's check."""
    spec, df = listing.LISTING_FEATURES, clean(spark, sf_dir)
    spec.check(df)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "non_null").select(
        "column",
        F.when(F.col("column").isin(list(spec.excluded)), "excluded")
        .when(F.col("column").isin(list(spec.cats)), "category")
        .otherwise("number").alias("role"),
        _lookup("column", spec.excluded).alias("reason"),
        "non_null",
    )


def _lookup(name: str, values: dict[str, str]):
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col(name))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
       lower(trim('  ' || l_returnflag || ' ')) AS trimmed_lower,
       regexp_replace('$' || CAST(l_orderkey AS VARCHAR) || ',' || l_linestatus, '[$,]', '', 'g')
           AS stripped,
       CAST(l_linenumber AS DOUBLE) AS as_double,
       CAST(l_partkey AS VARCHAR) AS as_text,
       CAST(l_shipdate AS DATE) AS ship_day,
       CAST(year(l_shipdate) AS INTEGER) AS ship_year,
       CAST(month(l_shipdate) AS INTEGER) AS ship_month,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS days,
       coalesce(CASE WHEN l_returnflag = 'R' THEN l_quantity END, 0.0::DOUBLE) AS returned,
       CASE WHEN l_quantity > 25 THEN 'many' WHEN l_quantity BETWEEN 10 AND 25 THEN 'some'
            ELSE 'few' END AS amount,
       l_returnflag IN ('A', 'N') AS listed,
       l_quantity / l_linenumber AS per_line,
       round(ln(1.0::DOUBLE + greatest(l_quantity - 10.0::DOUBLE, 0.0::DOUBLE)), 9) AS logged,
       abs(l_quantity - 25.0::DOUBLE) AS distance,
       round(l_quantity / 8.0::DOUBLE, 2) AS rounded
FROM lineitem
""")
def scalar_functions(spark, sf_dir):
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    day = F.col("l_shipdate").cast("date")
    priced = F.concat(F.lit("$"), F.col("l_orderkey"), F.lit(","), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate",
        F.lower(F.trim(F.concat(F.lit("  "), "l_returnflag", F.lit(" ")))).alias("trimmed_lower"),
        F.regexp_replace(priced, "[$,]", "").alias("stripped"),
        line.cast("double").alias("as_double"),
        F.col("l_partkey").cast("string").alias("as_text"),
        F.try_to_date(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("ship_day"),
        F.year(day).alias("ship_year"),
        F.month(day).alias("ship_month"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.coalesce(F.when(F.col("l_returnflag") == "R", quantity), F.lit(0.0)).alias("returned"),
        F.when(quantity > 25, "many").when(quantity.between(10, 25), "some").otherwise("few")
        .alias("amount"),
        F.col("l_returnflag").isin("A", "N").alias("listed"),
        (quantity / line).alias("per_line"),
        F.round(F.ln(1.0 + F.greatest(quantity - 10.0, F.lit(0.0))), 9).alias("logged"),
        F.abs(quantity - 25.0).alias("distance"),
        F.round(quantity / 8.0, 2).alias("rounded"),
    )
