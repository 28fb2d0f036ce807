"""Vector preparation, the three regressors, errors and examples.

Models are checked where a closed form exists: ridge on one feature, and trees
of one split.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.features import SPEC, filtered
from checks.listings import ABSENT, feature_rows, with_steps
from checks.registry import query
from checks.summaries import sql_place
from tablefit.operators import evaluate, models, prep, trees
from tablefit.operators.sampling import split, split_kept
from tablefit.plans.price_model import train_and_compare
from tablefit.sources.tables import written
from tablefit.specs import FeatureSpec

TRAIN = f"{sql_place('listing_id', 'split')} < 0.8::DOUBLE"
CATS = list(SPEC.cats)


def _index_sql(name: str) -> str:
    return f"""
    {name}_levels AS (
        SELECT {name} AS level, row_number() OVER (ORDER BY COUNT(*) DESC, {name}) - 1 AS place
        FROM features WHERE {TRAIN} AND {name} IS NOT NULL GROUP BY {name}
    )"""


def _index_joins(columns: str, template: str) -> str:
    joins = " ".join(f"LEFT JOIN {c}_levels ON f.{c} = {c}_levels.level" for c in CATS)
    shown = ", ".join(template.format(c=c) for c in CATS)
    levels = ",".join(_index_sql(c) for c in CATS)
    return with_steps("features", f"WITH {levels} SELECT {columns}, {shown} FROM features f {joins}")


@query(_index_joins(
    "listing_id",
    "CAST(coalesce({c}_levels.place, (SELECT COUNT(*) FROM {c}_levels)) AS DOUBLE) AS {c}_index",
))
def string_index(spark, sf_dir):
    """Indices of all rows, from the frequencies of the training rows."""
    rows = feature_rows(spark, sf_dir)
    model = prep.index(CATS).fit(split(rows, "listing_id")[0])
    return model.transform(rows).select("listing_id", *[f"{c}_index" for c in CATS])


@query(_index_joins(
    "listing_id",
    "CAST(coalesce({c}_levels.place, (SELECT COUNT(*) FROM {c}_levels)) AS INTEGER) "
    "AS {c}_place, CAST((SELECT COUNT(*) FROM {c}_levels) + 1 AS INTEGER) AS {c}_width",
))
def one_hot_width(spark, sf_dir):
    """Where each row's 1.0 stands, and how wide its vector is."""
    rows = feature_rows(spark, sf_dir)
    stages = Pipeline(stages=[prep.index(CATS), prep.one_hot(CATS)])
    encoded = stages.fit(split(rows, "listing_id")[0]).transform(rows)
    shown = []
    for c in CATS:
        values = vector_to_array(f"{c}_encoded")
        shown.append((F.array_position(values, 1.0) - 1).cast("int").alias(f"{c}_place"))
        shown.append(F.size(values).alias(f"{c}_width"))
    return encoded.select("listing_id", *shown)


NUMS = list(SPEC.nums)


# The medians of all numbers, one row.
_MEDIANS = f"""medians AS MATERIALIZED (
    SELECT {', '.join(f"CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median_{c}" for c in NUMS)}
    FROM features WHERE {TRAIN}
)"""


def _median_sql(name: str) -> str:
    # The column without any value is filled with 0.
    return f"coalesce(CAST({name} AS DOUBLE), median_{name}, 0.0::DOUBLE)"


def _rounded_imputed():
    return [F.round(f"{c}_imputed", 9).alias(f"{c}_imputed") for c in NUMS]


@query(with_steps("features", f"""
WITH {_MEDIANS}
SELECT listing_id, {', '.join(f"round({_median_sql(c)}, 9) AS {c}_imputed" for c in NUMS)}
FROM features, medians WHERE NOT ({TRAIN})
"""))
def impute_median(spark, sf_dir):
    """Test rows filled with the exact medians of the training rows, every number."""
    train, test = split(feature_rows(spark, sf_dir).select("listing_id", *NUMS), "listing_id")
    model = prep.impute(NUMS, rel_error=0.0).fit(train)
    return model.transform(test).select("listing_id", *_rounded_imputed())


def _within(value: Column, column: str, share: float, error: float) -> Column:
    """Whether the rank of `value` in the column is within `error` of the rows of `share`."""
    known = F.col(column).isNotNull()
    n = F.count_if(known)
    below, upto = F.count_if(known & (F.col(column) < value)), F.count_if(known & (F.col(column) <= value))
    # and one row, as a rank is a whole number
    slack = error * n + 1
    return F.coalesce((below <= share * n + slack) & (upto >= share * n - slack), F.lit(True))


@query(with_steps("features", "\nUNION ALL ".join(f"SELECT '{c}' AS name, TRUE AS close FROM (SELECT 1)" for c in NUMS)))
def impute_median_approximate(spark, sf_dir):
    """The default medians are within their rank error, every number."""
    train, _ = split(feature_rows(spark, sf_dir).select("listing_id", *NUMS), "listing_id")
    fills = prep.impute(NUMS).fit(train).fills
    close = train.agg(*(_within(F.lit(fills[c]), c, 0.5, prep.REL_ERROR).alias(c) for c in NUMS))
    return close.unpivot([], NUMS, "name", "close")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_tax,
       CAST(l_quantity AS DOUBLE) AS whole
FROM lineitem
""")
def cast_numeric(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax",
        F.col("l_quantity").cast("decimal(12,2)").alias("whole"),
    )
    return prep.to_double(["l_linenumber", "l_tax", "whole"]).transform(lines)


# Numbers that some rows lack, but every column has.
ASSEMBLED = [c for c in NUMS if c not in ABSENT]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ASSEMBLED)


@query(with_steps("features", f"""
SELECT listing_id, CAST({len(ASSEMBLED)} AS INTEGER) AS width,
       round({' + '.join(f'CAST({c} AS DOUBLE)' for c in ASSEMBLED)}, 6) AS total
FROM features WHERE {_COMPLETE}
"""))
def assembled_rows(spark, sf_dir):
    """Rows that survive assembly of the spec's numbers, with the sum of their vector."""
    stage = prep.assemble(ASSEMBLED)
    values = vector_to_array("features_raw")
    return stage.transform(feature_rows(spark, sf_dir)).select(
        "listing_id",
        F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda total, v: total + v), 6).alias("total"),
    )


@query(with_steps("features", f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE NOT ({_COMPLETE})) AS skipped FROM features
"""))
def filter_assembled(spark, sf_dir):
    return prep.skipped_rows(feature_rows(spark, sf_dir), ASSEMBLED)


_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS {c}" for c in NUMS)
_DEVIATIONS = ", ".join(f"stddev_samp({c}) AS deviation_{c}" for c in NUMS)


def _scaled_sql(name: str) -> str:
    return f"coalesce(round({name} / nullif(deviation_{name}, 0), 6), 0.0::DOUBLE) AS {name}"


@query(with_steps("features", f"""
WITH filled AS MATERIALIZED (SELECT listing_id, {_FILLED} FROM features),
deviations AS MATERIALIZED (SELECT {_DEVIATIONS} FROM filled WHERE {TRAIN})
SELECT listing_id, {', '.join(_scaled_sql(c) for c in NUMS)} FROM filled, deviations
"""))
def standardize(spark, sf_dir):
    """All rows scaled by the training rows, every number of the spec (null: 0); a constant column becomes 0."""
    rows = feature_rows(spark, sf_dir)
    rows = rows.select("listing_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMS])
    stages = Pipeline(stages=[prep.assemble(NUMS), prep.scale()])
    scaled = stages.fit(split(rows, "listing_id")[0]).transform(rows)
    # one array per row: taken from the vector once, not once a column
    values = scaled.select("listing_id", vector_to_array("features").alias("values"))
    return values.select("listing_id", *[F.round(F.col("values")[i], 6).alias(c) for i, c in enumerate(NUMS)])


def _levels_sql() -> str:
    counts = " + ".join(f"COUNT(DISTINCT {c}) + 1" for c in SPEC.cats)
    return with_steps("features", f"""
    SELECT CAST((SELECT {counts} FROM features WHERE {TRAIN}) + {len(SPEC.nums)} AS BIGINT)
               AS feature_count,
           COUNT(*) FILTER (WHERE {TRAIN}) AS train_rows,
           COUNT(*) FILTER (WHERE NOT ({TRAIN})) AS test_rows
    FROM features
    """)


@query(_levels_sql())
def vector_size(spark, sf_dir):
    """Vector width and rows per side after the whole preparation."""
    train, test = split(written(feature_rows(spark, sf_dir), "features"), "listing_id")
    model = prep.build(SPEC).fit(train)
    prepared = model.transform(train)
    rows = prepared.select(F.lit("train").alias("side")).unionAll(
        model.transform(test).select(F.lit("test").alias("side"))
    )
    return rows.agg(
        F.lit(prep.width(prepared, "features")).cast("bigint").alias("feature_count"),
        F.count_if(F.col("side") == "train").alias("train_rows"),
        F.count_if(F.col("side") == "test").alias("test_rows"),
    )


def _vector_sql() -> str:
    """Every non-zero entry of the vectors of test rows, unscaled and scaled."""
    levels = ",".join(_index_sql(c) for c in CATS)
    entries, offset = [], "0"
    for c in CATS:
        entries.append(
            f"SELECT listing_id, train, {offset} + coalesce(l.place, (SELECT COUNT(*) FROM {c}_levels)) AS place, "
            f"1.0::DOUBLE AS value FROM sides f LEFT JOIN {c}_levels l ON f.{c} = l.level"
        )
        offset += f" + (SELECT COUNT(*) FROM {c}_levels) + 1"
    numbers = ", ".join(f"{_median_sql(c)} AS n{i}" for i, c in enumerate(NUMS))
    entries.append(
        f"SELECT listing_id, train, {offset} + CAST(name[2:] AS BIGINT) AS place, value FROM "
        f"(UNPIVOT (SELECT listing_id, train, {numbers} FROM sides, medians) ON "
        f"{', '.join(f'n{i}' for i in range(len(NUMS)))} INTO NAME name VALUE value)"
    )
    return with_steps("features", f"""
    WITH sides AS MATERIALIZED (SELECT *, {TRAIN} AS train FROM features), {_MEDIANS}, {levels},
    entries AS MATERIALIZED ({' UNION ALL '.join(entries)}),
    moments AS (
        SELECT place, sum(value) / n AS mean, n, sum(value) AS total, sum(value * value) AS squares
        FROM entries, (SELECT COUNT(*) AS n FROM sides WHERE train) WHERE train GROUP BY place, n
    ),
    spread AS (
        SELECT e.place, sqrt((sum((e.value - m.mean) ** 2) + (m.n - COUNT(*)) * m.mean ** 2) / (m.n - 1)) AS deviation
        FROM entries e JOIN moments m ON e.place = m.place WHERE e.train GROUP BY e.place, m.mean, m.n
    )
    SELECT listing_id, CAST(e.place AS INTEGER) AS place, round(value, 6) AS raw,
           round(CASE WHEN coalesce(deviation, 0) > 1e-12 THEN value / deviation ELSE 0.0::DOUBLE END, 6) AS scaled
    FROM entries e LEFT JOIN spread s ON e.place = s.place WHERE NOT train AND value != 0
    """)


@query(_vector_sql())
def whole_vector(spark, sf_dir):
    """All entries of the test rows' vectors that are not 0, with exact medians."""
    rows = feature_rows(spark, sf_dir).select("listing_id", *SPEC.cats, *SPEC.nums)
    train, test = split(written(rows, "features"), "listing_id")
    prepared = prep.build(SPEC, rel_error=0.0).fit(train).transform(test)
    both = F.arrays_zip(
        vector_to_array("features_raw").alias("raw"), vector_to_array("features").alias("scaled")
    )
    return prepared.select("listing_id", F.posexplode(both).alias("place", "entry")).where("entry.raw != 0").select(
        "listing_id", "place", F.round("entry.raw", 6).alias("raw"), F.round("entry.scaled", 6).alias("scaled")
    )


def _one_feature(spark, sf_dir):
    rows = filtered(spark, sf_dir).select("listing_id", "price", "accommodates")
    return split(prep.assemble(["accommodates"]).transform(rows), "listing_id")


@query(with_steps("filtered", f"""
WITH fitted AS (
    SELECT regr_slope(price, accommodates) / (1 + 100.0::DOUBLE / stddev_pop(price)) AS slope,
           avg(price) AS y, avg(accommodates) AS x
    FROM filtered WHERE {TRAIN}
)
SELECT listing_id, price, round(y + slope * (accommodates - x), 4) AS prediction
FROM filtered, fitted WHERE NOT ({TRAIN})
"""))
def ridge_one_feature(spark, sf_dir):
    train, test = _one_feature(spark, sf_dir)
    model = models.linear("price", reg=100.0, features="features_raw").fit(train)
    predictions = model.transform(test)
    return predictions.select("listing_id", "price", F.round("prediction", 4).alias("prediction"))


@query(with_steps("filtered", f"""
WITH train AS (
    SELECT price AS y, accommodates AS a, minimum_nights AS b FROM filtered WHERE {TRAIN}
),
moments AS (
    SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(y) AS sy, stddev_pop(a) AS sa,
           stddev_pop(b) AS sb, corr(a, y) AS ray, corr(b, y) AS rby, corr(a, b) AS rab,
           1 + 50.0::DOUBLE / stddev_pop(y) AS d
    FROM train
),
fitted AS (
    SELECT *, sy / sa * (ray * d - rab * rby) / (d * d - rab * rab) AS slope_a,
           sy / sb * (rby * d - rab * ray) / (d * d - rab * rab) AS slope_b
    FROM moments
)
SELECT listing_id, price,
       round(my + slope_a * (accommodates - ma) + slope_b * (minimum_nights - mb), 4)
           AS prediction
FROM filtered, fitted WHERE NOT ({TRAIN})
"""))
def ridge_two_features(spark, sf_dir):
    """The penalised normal equations of two standardised features."""
    rows = filtered(spark, sf_dir).select("listing_id", "price", "accommodates", "minimum_nights")
    vectors = prep.assemble(["accommodates", "minimum_nights"]).transform(rows)
    train, test = split(vectors, "listing_id")
    predictions = models.linear("price", reg=50.0, features="features_raw").fit(train).transform(test)
    return predictions.select("listing_id", "price", F.round("prediction", 4).alias("prediction"))


_STUMP = f"""
WITH levels AS (
    SELECT accommodates AS x, COUNT(*) AS n, SUM(price) AS s
    FROM filtered WHERE {TRAIN} GROUP BY accommodates
),
sides AS (
    SELECT x, lead(x) OVER (ORDER BY x) AS next_x,
           SUM(n) OVER (ORDER BY x) AS n_left, SUM(s) OVER (ORDER BY x) AS s_left,
           SUM(n) OVER () AS n_all, SUM(s) OVER () AS s_all
    FROM levels
),
best AS (
    SELECT (x + next_x) / 2 AS cut, s_left / n_left AS below,
           (s_all - s_left) / (n_all - n_left) AS above
    FROM sides WHERE next_x IS NOT NULL AND n_left >= 10 AND n_all - n_left >= 10
    ORDER BY s_left * s_left / n_left
             + (s_all - s_left) * (s_all - s_left) / (n_all - n_left) DESC
    LIMIT 1
)
SELECT listing_id, price,
       round(CASE WHEN accommodates <= cut THEN below ELSE above END, 4) AS prediction
FROM filtered, best WHERE NOT ({TRAIN})
"""


def _predicted(spark, sf_dir, estimator):
    train, test = _one_feature(spark, sf_dir)
    predictions = estimator.fit(train).transform(test)
    return predictions.select("listing_id", "price", F.round("prediction", 4).alias("prediction"))


@query(with_steps("filtered", _STUMP))
def tree_stump(spark, sf_dir):
    return _predicted(spark, sf_dir, models.tree("price", depth=1, min_rows=10))


@query(with_steps("filtered", _STUMP))
def forest_of_stumps(spark, sf_dir):
    """Three trees on all rows are three times the same tree."""
    estimator = models.forest("price", trees=3, depth=1, min_rows=10, subsample=1.0)
    return _predicted(spark, sf_dir, estimator.setBootstrap(False))


def _best_cut(rows: str, name: str) -> str:
    """The cut of each node of `rows` (node, x, y) that lowers its variance most."""
    return f"""
    {name} AS (
        SELECT node, cut FROM (
            SELECT node, (x + next_x) / 2 AS cut, row_number() OVER (
                PARTITION BY node
                ORDER BY s_left * s_left / n_left
                         + (s_all - s_left) * (s_all - s_left) / (n_all - n_left) DESC
            ) AS place
            FROM (
                SELECT node, x, lead(x) OVER (PARTITION BY node ORDER BY x) AS next_x,
                       SUM(n) OVER (PARTITION BY node ORDER BY x) AS n_left,
                       SUM(s) OVER (PARTITION BY node ORDER BY x) AS s_left,
                       SUM(n) OVER (PARTITION BY node) AS n_all,
                       SUM(s) OVER (PARTITION BY node) AS s_all
                FROM (SELECT node, x, COUNT(*) AS n, SUM(y) AS s FROM {rows} GROUP BY node, x)
            ) WHERE next_x IS NOT NULL AND n_left >= 10 AND n_all - n_left >= 10
        ) WHERE place = 1
    )"""


@query(with_steps("filtered", f"""
WITH sides AS (
    SELECT listing_id, price AS y, accommodates AS x, 0 AS node, {TRAIN} AS train FROM filtered
),
first_rows AS (SELECT * FROM sides WHERE train), {_best_cut('first_rows', 'first_cut')},
halves AS (
    SELECT s.* REPLACE (CAST(s.x > c.cut AS INTEGER) AS node) FROM sides s, first_cut c
),
second_rows AS (SELECT * FROM halves WHERE train), {_best_cut('second_rows', 'second_cut')},
leaves AS (
    SELECT h.* REPLACE (h.node * 2 + coalesce(CAST(h.x > c.cut AS INTEGER), 0) AS node)
    FROM halves h LEFT JOIN second_cut c ON h.node = c.node
),
means AS (SELECT node, avg(y) AS mean FROM leaves WHERE train GROUP BY node)
SELECT listing_id, y AS price, round(mean, 4) AS prediction
FROM leaves JOIN means ON leaves.node = means.node WHERE NOT train
"""))
def tree_of_two_levels(spark, sf_dir):
    return _predicted(spark, sf_dir, models.tree("price", depth=2, min_rows=10))


# Inputs of few values, so that all midpoints between values are cuts to choose from.
CUT_INPUTS = ["accommodates", "guests_included", "minimum_nights", "availability_30"]
DEPTH = 8


def _grown_sql() -> str:
    """A tree of DEPTH levels, grown a level at a time; nodes are numbered from 1, children of i are 2i and 2i + 1."""
    levels = []
    for level in range(DEPTH):
        levels.append(f"""
        sums_{level} AS (
            SELECT node, feature, x, COUNT(*) AS n, SUM(y) AS s
            FROM (UNPIVOT (SELECT node, y, {', '.join(CUT_INPUTS)} FROM rows_{level} WHERE train)
                  ON {', '.join(CUT_INPUTS)} INTO NAME feature VALUE x)
            WHERE node >= {2 ** level} GROUP BY node, feature, x
        ),
        sides_{level} AS (
            SELECT s.node, s.feature, c.cut, SUM(n) FILTER (WHERE x <= cut) AS n_left, SUM(s) FILTER (WHERE x <= cut) AS s_left,
                   SUM(n) AS n_all, SUM(s) AS s_all
            FROM sums_{level} s JOIN cuts c ON s.feature = c.feature GROUP BY s.node, s.feature, c.cut
        ),
        best_{level} AS (
            SELECT node, feature, cut FROM sides_{level} WHERE n_left >= 10 AND n_all - n_left >= 10
            QUALIFY row_number() OVER (
                PARTITION BY node
                ORDER BY s_left * s_left / n_left + (s_all - s_left) * (s_all - s_left) / (n_all - n_left) DESC,
                         list_position({CUT_INPUTS}, feature), cut
            ) = 1
        ),
        rows_{level + 1} AS MATERIALIZED (
            SELECT r.* REPLACE (CASE WHEN b.node IS NULL THEN r.node ELSE 2 * r.node + CAST(CASE b.feature
                {' '.join(f"WHEN '{c}' THEN r.{c}" for c in CUT_INPUTS)} END > b.cut AS BIGINT) END AS node)
            FROM rows_{level} r LEFT JOIN best_{level} b ON r.node = b.node
        )""")
    return f"""
    WITH rows_0 AS MATERIALIZED (
        SELECT listing_id, price AS y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CUT_INPUTS)},
               CAST(1 AS BIGINT) AS node, {TRAIN} AS train
        FROM filtered
    ),
    cuts AS MATERIALIZED (
        SELECT feature, (x + next_x) / 2 AS cut FROM (
            SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS next_x FROM (
                SELECT DISTINCT feature, x
                FROM (UNPIVOT (SELECT {', '.join(CUT_INPUTS)} FROM rows_0 WHERE train)
                      ON {', '.join(CUT_INPUTS)} INTO NAME feature VALUE x)
            )
        ) WHERE next_x IS NOT NULL
    ),
    {','.join(levels)},
    means AS (SELECT node, avg(y) AS mean FROM rows_{DEPTH} WHERE train GROUP BY node)
    SELECT listing_id, y AS price, round(mean, 4) AS prediction
    FROM rows_{DEPTH} r JOIN means ON r.node = means.node WHERE NOT train
    """


@query(with_steps("filtered", _grown_sql()))
def tree_of_eight_levels(spark, sf_dir):
    """The tree of its real depth and smallest leaf, on four inputs whose every cut is tried."""
    rows = filtered(spark, sf_dir).select("listing_id", "price", *CUT_INPUTS)
    train, test = split(prep.assemble(CUT_INPUTS).transform(written(rows, "inputs")), "listing_id")
    predictions = models.tree("price").fit(train).transform(test)
    return predictions.select("listing_id", "price", F.round("prediction", 4).alias("prediction"))


def _routed(spark, sf_dir, estimator):
    """Node table of a model fitted on the whole vector of all training rows, and both sides with their routes."""
    rows = feature_rows(spark, sf_dir).select("listing_id", "price", *SPEC.cats, *SPEC.nums)
    train, test = split_kept(rows, lambda made: written(made, "features"), "listing_id")
    preparation, fitted_on = prep.fit_on_kept(prep.build(SPEC), train, ["price"], lambda raw: written(raw, "vectors"))
    model = estimator.fit(fitted_on)
    nodes = trees.tree_nodes(spark, model)
    routes = trees.route(nodes, F.col("x")).alias("routes")
    said = model.transform(preparation.transform(test)).select(
        "listing_id", "prediction", vector_to_array("features_raw").alias("x")
    )
    reached = fitted_on.select("price", vector_to_array("features_raw").alias("x")).select("price", routes)
    return nodes, reached, said.select("listing_id", "prediction", routes)


@query(with_steps("features", f"""
SELECT COUNT(*) AS rows, TRUE AS counts, TRUE AS means, TRUE AS impurities, TRUE AS gains, TRUE AS deep
FROM features WHERE {TRAIN}
"""))
def tree_nodes(spark, sf_dir):
    """The tree of the whole vector: what its nodes say is what the rows routed to them give."""
    nodes, reached, _ = _routed(spark, sf_dir, models.tree("price"))
    # routes and facts are read several times
    reached = written(reached, "reached")
    both = trees.with_facts(nodes, written(trees.node_facts(reached, "routes", "price"), "facts"))

    def equal(a: str, b: str) -> Column:
        return F.bool_and(F.abs(F.col(a) - F.col(b)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(b)))

    deepest = reached.select(F.max(F.size(F.col("routes")[0]["path"]))).first()[0]
    return both.agg(
        F.max("found_rows").alias("rows"),
        F.bool_and(F.col("rows") == F.col("found_rows")).alias("counts"),
        equal("prediction", "found_mean").alias("means"),
        equal("impurity", "found_impurity").alias("impurities"),
        equal("gain", "found_gain").alias("gains"),
        F.lit(deepest == DEPTH + 1).alias("deep"),
    )


@query(with_steps("features", f"SELECT listing_id, CAST(40 AS INTEGER) AS trees, TRUE AS same FROM features WHERE NOT ({TRAIN})"))
def forest_routes(spark, sf_dir):
    """The forest of 40 bagged trees says of each test row the mean of the leaves that the row is routed to."""
    _, _, said = _routed(spark, sf_dir, models.forest("price"))
    return said.select(
        "listing_id", F.size("routes").alias("trees"),
        (F.abs(trees.average("routes") - F.col("prediction")) <= 1e-9 * F.abs("prediction")).alias("same"),
    )


def _priced(spark, sf_dir):
    """A made prediction, so that the errors have a closed form."""
    rows = filtered(spark, sf_dir)
    guess = 900.0 + 25.0 * F.col("accommodates") + F.coalesce("bedrooms", F.lit(0.0))
    return rows.withColumn("prediction", guess)


_PRICED = """
priced AS (
    SELECT *, 900.0::DOUBLE + 25.0::DOUBLE * accommodates + coalesce(bedrooms, 0) AS prediction
    FROM filtered
)"""


def _metrics_sql(name: str, guess: str) -> str:
    return f"""
    SELECT {name} AS model, round(sqrt(avg((price - {guess}) ** 2)), 6) AS rmse,
           round(avg(abs(price - {guess})), 6) AS mae,
           round(1 - sum((price - {guess}) ** 2) / (var_pop(price) * COUNT(*)), 6) AS r2,
           COUNT(*) AS n
    FROM priced"""


def _rounded_metrics(df):
    return [F.round(m, 6).alias(m) for m in ("rmse", "mae", "r2")] + [F.col("n")]


@query(with_steps("filtered", f"""
WITH {_PRICED} SELECT rmse, mae, r2, n FROM ({_metrics_sql("''", 'prediction')})
"""))
def metrics(spark, sf_dir):
    found = evaluate.metrics(_priced(spark, sf_dir), "price")
    return found.select(*_rounded_metrics(found))


@query(with_steps("filtered", f"""
WITH {_PRICED} {_metrics_sql("'made'", 'prediction')}
UNION ALL {_metrics_sql("'constant'", '1000.0::DOUBLE')}
"""))
def compared_metrics(spark, sf_dir):
    rows = _priced(spark, sf_dir).withColumn("constant", F.lit(1000.0))
    found = evaluate.compared_metrics(rows, "price", {"made": "prediction", "constant": "constant"})
    return found.select("model", *_rounded_metrics(found))


CONTEXT = ["room_type", "neighbourhood_cleansed", "accommodates", "bedrooms", "bathrooms"]


def _examples_sql(direction: str) -> str:
    return with_steps("filtered", f"""
    WITH {_PRICED}
    SELECT listing_id, round(price, 2) AS actual, round(prediction, 2) AS predicted,
           round(abs(price - prediction), 2) AS abs_error, {', '.join(CONTEXT)}
    FROM priced ORDER BY abs_error {direction}, listing_id LIMIT 12
    """)


@query(_examples_sql("ASC"))
def prediction_examples(spark, sf_dir):
    return evaluate.examples(_priced(spark, sf_dir), "price", "listing_id", context=CONTEXT)


@query(_examples_sql("DESC"))
def worst_predictions(spark, sf_dir):
    rows = _priced(spark, sf_dir)
    return evaluate.examples(rows, "price", "listing_id", context=CONTEXT, worst=True)


_ONE = FeatureSpec(
    label="price", cats=[], nums=["accommodates"], excluded={"price": "label", "listing_id": "identifier"}
)


def _stump_body() -> str:
    return _STUMP.strip().removeprefix("WITH").rsplit("SELECT listing_id, price,", 1)[0]


@query(with_steps("filtered", f"""
WITH {_stump_body()},
line AS (
    SELECT regr_slope(price, accommodates) / (1 + 100.0::DOUBLE / stddev_pop(price)) AS slope,
           avg(price) AS y, avg(accommodates) AS x
    FROM filtered WHERE {TRAIN}
),
priced AS (
    SELECT price, y + slope * (accommodates - x) AS by_line,
           CASE WHEN accommodates <= cut THEN below ELSE above END AS by_stump
    FROM filtered, best, line WHERE NOT ({TRAIN})
)
{_metrics_sql("'linear'", 'by_line')} UNION ALL {_metrics_sql("'tree'", 'by_stump')}
UNION ALL {_metrics_sql("'forest'", 'by_stump')}
"""))
def train_compare(spark, sf_dir):
    """Split, fit on all training rows, predict and compare on all test rows."""
    rows = filtered(spark, sf_dir).select("listing_id", "price", "accommodates")
    estimators = {
        "linear": models.linear("price", reg=100.0),
        "tree": models.tree("price", depth=1, min_rows=10),
        "forest": models.forest("price", trees=3, depth=1, min_rows=10, subsample=1.0).setBootstrap(False),
    }
    found = train_and_compare(rows, _ONE, "listing_id", estimators, max_train_rows=0).comparison
    return found.select("model", *_rounded_metrics(found))


@query(with_steps("features", f"""
SELECT model, COUNT(*) AS n
FROM features, (VALUES ('linear_regression'), ('decision_tree'), ('random_forest')) AS m(model)
WHERE NOT ({TRAIN}) GROUP BY model
"""))
def compared_rows(spark, sf_dir):
    """However few rows are fitted on, all test rows are compared."""
    return _fitted(spark, sf_dir, 500).comparison.select("model", "n")


@query(with_steps("features", "SELECT TRUE AS holds, TRUE AS centred"))
def ridge_normal_equations(spark, sf_dir):
    """Ridge on the whole scaled vector, regParam 0.1: its gradient vanishes.

    For every column x that varies, covar(x, residual) is regParam / sd(price) *
    var(x) * coefficient, and residuals have mean 0, to 1e-4 of a deviation.
    """
    train, _ = split(feature_rows(spark, sf_dir).select("listing_id", "price", *SPEC.cats, *SPEC.nums), "listing_id")
    vectors = written(
        prep.build(SPEC).fit(train).transform(train).select("price", vector_to_array("features").alias("x")), "vectors"
    )
    as_vector = vectors.withColumn("features", array_to_vector("x"))
    model = models.linear("price", reg=0.1).fit(as_vector)
    found = model.transform(as_vector)
    residual = F.col("price") - F.col("prediction")
    weights = F.array(*map(F.lit, model.coefficients.toArray().tolist()))
    spread = found.agg(F.stddev_pop("price").alias("sy"), F.avg(residual).alias("mean")).first()
    entries = found.select(residual.alias("r"), F.posexplode("x").alias("place", "x")).groupBy("place").agg(
        F.covar_pop("x", "r").alias("along"), F.stddev_pop("x").alias("sx")
    )
    gap = F.abs(F.col("along") - 0.1 / spread.sy * weights[F.col("place")] * F.col("sx") * F.col("sx"))
    return entries.where("sx > 1e-9").agg(
        (F.max(gap / F.col("sx")) < 1e-4 * spread.sy).alias("holds"),
        F.lit(abs(spread.mean) < 1e-4 * spread.sy).alias("centred"),
    )


def _fitted(spark, sf_dir, max_train_rows):
    keys = ["listing_id", "host_id"]
    features = feature_rows(spark, sf_dir).select(*keys, SPEC.label, *SPEC.cats, *SPEC.nums)
    return train_and_compare(features, SPEC, "listing_id", max_train_rows=max_train_rows)


@query()
def model_comparison(spark, sf_dir):
    """The three regressors fitted on 5000 training rows."""
    return _fitted(spark, sf_dir, 5000).comparison


@query()
def model_comparison_all_rows(spark, sf_dir):
    return _fitted(spark, sf_dir, 0).comparison


@query()
def topk_best_predictions(spark, sf_dir):
    """The forest's twelve best predictions of test rows."""
    fitted = _fitted(spark, sf_dir, 5000)
    context = ["room_type", "neighbourhood_grouped", "accommodates", "bedrooms", "bathrooms"]
    return fitted.examples("random_forest", SPEC.label, "listing_id", context)
