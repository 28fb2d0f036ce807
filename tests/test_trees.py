"""Node tables of fitted trees, rows routed through them, and what reaches a node."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablefit.operators import models, prep
from tablefit.operators.trees import average, node_facts, route, tree_nodes, with_facts


@pytest.fixture(scope="module")
def vectors(spark):
    i = F.col("id")
    rows = spark.range(3000).select(
        "id", F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (i * 31 % 3 + 1).cast("int")).alias("kind"),
        (i * 7919 % 97).cast("double").alias("u"), (i * 104729 % 11).cast("double").alias("v"),
    )
    price = F.when(F.col("kind") == "b", 300.0).otherwise(0.0) + F.col("u") * F.col("v") + i % 5
    stages = [prep.index(["kind"]), prep.one_hot(["kind"]), prep.assemble(["kind_encoded", "u", "v"])]
    rows = rows.withColumn("price", price)
    for stage in stages:
        rows = (stage.fit(rows) if hasattr(stage, "fit") else stage).transform(rows)
    return rows.select("id", "price", "features_raw", vector_to_array("features_raw").alias("x"))


@pytest.mark.parametrize("name", ["tree", "forest"])
def test_same_predictions(spark, vectors, name):
    estimator = {"tree": models.tree("price", depth=5), "forest": models.forest("price", trees=4, depth=4)}[name]
    model = estimator.fit(vectors)
    nodes = tree_nodes(spark, model)
    assert nodes.count() == (model.numNodes if name == "tree" else model.totalNumNodes)
    assert nodes.where("choices is not null").count() > 0 and nodes.where("cut is not null").count() > 0
    found = model.transform(vectors).withColumn("routes", route(nodes, "x")).select(
        "prediction", average("routes").alias("mean"), F.size("routes").alias("trees")
    ).collect()
    assert {r.trees for r in found} == {1 if name == "tree" else 4}
    assert np.allclose([r.prediction for r in found], [r["mean"] for r in found], rtol=1e-12)


def test_plan_holds_nodes_as_a_constant(spark, vectors):
    nodes = tree_nodes(spark, models.tree("price", depth=3).fit(vectors))
    plan = vectors.select(route(nodes, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.split("AS ")[0] and "Join" not in plan


def test_facts(spark, vectors):
    nodes = tree_nodes(spark, models.tree("price", depth=4).fit(vectors))
    routed = vectors.withColumn("routes", route(nodes, "x"))
    rows = routed.select("price", F.col("routes")[0]["path"].alias("path")).collect()
    for r in with_facts(nodes, node_facts(routed, "routes", "price")).collect():
        prices = np.array([x.price for x in rows if r.node in x.path])
        assert r.rows == r.found_rows == len(prices)
        assert np.allclose([r.prediction, r.found_mean], prices.mean())
        assert np.isclose(r.found_impurity, prices.var())
        if r.left >= 0:
            sides = [np.array([x.price for x in rows if child in x.path]) for child in (r.left, r.right)]
            gain = prices.var() - sum(len(s) * s.var() for s in sides) / len(prices)
            assert np.allclose([r.gain, r.found_gain], gain)
        else:
            assert r.found_gain is None and r.gain is None
    nothing = with_facts(nodes, node_facts(routed.limit(0), "routes", "price")).collect()
    assert {(r.found_rows, r.found_mean, r.found_gain) for r in nothing} == {(0, None, None)}


def test_single_leaf_and_missing_values(spark, vectors):
    flat = vectors.withColumn("price", F.lit(7.0))
    leaf = tree_nodes(spark, models.tree("price").fit(flat))
    assert [(r.left, r.prediction) for r in leaf.collect()] == [(-1, 7.0)]
    found = spark.createDataFrame([([1.0],), ([],), (None,)], "x array<double>").select(route(leaf, "x").alias("routes"))
    assert [[(t.path, t.prediction) for t in r.routes] for r in found.collect()] == [[([0], 7.0)]] * 3
    nodes = tree_nodes(spark, models.tree("price", depth=3).fit(vectors))
    by_node = {r.node: r for r in nodes.collect()}
    at = 0
    while by_node[at].left >= 0:
        at = by_node[at].right
    lost = spark.createDataFrame([([None] * 5,), (None,)], "x array<double>").select(route(nodes, "x").alias("routes"))
    assert {r.routes[0].path[-1] for r in lost.collect()} == {at}


def test_routes_are_those_of_a_walk_row_by_row(spark):
    """Trees of different depths, arrays of different lengths, choices, nulls, NaN and infinities."""
    shape = "tree int, node int, feature int, cut double, choices array<double>, left int, right int, prediction double"
    rows = [
        (0, 0, 0, 0.1 + 0.2, None, 1, 2, 5.0), (0, 1, 2, None, [0.0, 2.0], 3, 4, 4.0), (0, 2, None, None, None, -1, -1, 1.5),
        (0, 3, None, None, None, -1, -1, -0.0), (0, 4, 7, -1.0, None, 5, 6, 2.0), (0, 5, None, None, None, -1, -1, 8.0),
        (0, 6, None, None, None, -1, -1, 9.0), (1, 0, None, None, None, -1, -1, 0.25),
    ]
    nodes = spark.createDataFrame(rows, shape)
    inf, nan = float("inf"), float("nan")
    given = [None, [], [None, 1.0, 2.0], [0.1 + 0.2, 0.0, 2.0], [0.3, 0.0, 1.0], [-inf, 0.0, -0.0], [nan, 0.0, 0.0],
             [inf, 0.0, 0.0], [0.0, 0.0, nan], [0.0, 0.0, None], [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0]] * 3
    by_node = {r[:2]: r for r in rows}

    def walked(tree, x):
        path = [0]
        while by_node[tree, path[-1]][5] >= 0:
            _, _, feature, cut, choices, left, right, _ = by_node[tree, path[-1]]
            value = x[feature] if x is not None and feature < len(x) else None
            below = value is not None and (value in choices if choices else value <= cut)
            path.append(left if below else right)
        return path, by_node[tree, path[-1]][7]

    df = spark.createDataFrame(list(enumerate(given)), "id int, x array<double>").repartition(2)
    found = df.select("id", route(nodes, "x").alias("routes"))
    assert found.schema["routes"].dataType.simpleString() == "array<struct<path:array<int>,prediction:double>>"
    for r in found.collect():
        assert [(t.path, t.prediction) for t in r.routes] == [walked(tree, given[r.id]) for tree in (0, 1)]


def test_routing_runs_no_expression_row_by_row(spark, vectors):
    nodes = tree_nodes(spark, models.tree("price", depth=3).fit(vectors))
    plan = vectors.select(route(nodes, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
