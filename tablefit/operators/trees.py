"""Fitted trees as a table of nodes, and rows routed through it.

`tree_nodes` reads what a fitted tree or forest saves, a row per node.  `route`
sends rows through such a table by one expression that holds the nodes: batches
of rows go down each tree as arrays, and no row moves to another task.  `node_facts` gathers what reaches each node, so that
counts, means, impurities and gains are known for any rows, the ones fitted on
or others.

A node table is as bounded as its model, which the driver holds already: fewer
than 2^(depth + 1) nodes a tree.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.sources.tables import read_table, shared_path

_ROUTES = "array<struct<path:array<int>,prediction:double>>"


def tree_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """(tree, node, feature, cut, choices, left, right, prediction, impurity, gain, rows) of a fitted tree or forest.

    Node 0 is the root.  A row goes left where its feature is at most `cut`, or,
    for a feature of categories, among `choices`.  Leaves have neither, and -1
    as `left` and `right`; the impurity of one that was never tried is null.  The model is saved to the shared folder, and the
    table reads it there.
    """
    path = shared_path(spark, "trees")
    model.write().save(path)
    saved = read_table(spark, f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    ordered = F.col("split.numCategories") < 0
    values = F.col("split.leftCategoriesOrThreshold")
    return saved.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ordered, F.get(values, F.lit(0))).alias("cut"),
        F.when(inner & ~ordered, values).alias("choices"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        "prediction",
        F.when(F.col("impurity") >= 0, F.col("impurity")).alias("impurity"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.col("rawCount").alias("rows"),
    )


class _Tree:
    """The nodes of one tree as arrays by node; a leaf is its own child, so rows stay there."""

    def __init__(self, nodes: list[dict]):
        at = np.arange(len(nodes))

        def column(name: str, missing: float, kind: type) -> np.ndarray:
            found = (n.get(name) for n in nodes)
            return np.array([missing if v is None else float(v) for v in found]).astype(kind)

        inner = column("left", -1, np.int32) >= 0
        self.left = np.where(inner, column("left", -1, np.int32), at).astype(np.int32)
        self.right = np.where(inner, column("right", -1, np.int32), at).astype(np.int32)
        self.feature = column("feature", 0, np.int64)
        self.cut = column("cut", np.nan, np.float64)
        self.prediction = column("prediction", np.nan, np.float64)
        choices = [[float(v) for v in n.get("choices") or ()] for n in nodes]
        # the values that any node chooses by, and which of them each node sends left
        self.known = np.unique(np.array([v for own in choices for v in own], np.float64))
        self.chosen = np.array([np.isin(self.known, own) for own in choices]).reshape(len(nodes), len(self.known))
        self.steps, level = 0, [0]
        while level := [int(c) for i in level if inner[i] for c in (self.left[i], self.right[i])]:
            self.steps += 1

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The nodes of each row of `x`, a column per step; NaN is below no cut and in no choice, and the last
        column of `x` is NaN for features that the rows lack."""
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int32)
        path = [at]
        for _ in range(self.steps):
            value = x[rows, np.minimum(self.feature[at], x.shape[1] - 1)]
            goes_left = value <= self.cut[at]
            if len(self.known):
                place = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
                goes_left |= (self.known[place] == value) & self.chosen[at, place]
            at = np.where(goes_left, self.left[at], self.right[at])
            path.append(at)
        return np.stack(path, axis=1)


def _matrix(values: pa.Array) -> np.ndarray:
    """Arrays of doubles as rows of a matrix, NaN where a value or an array is null or short, and one more column of NaN."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = np.full((len(values), lengths.max(initial=0) + 1), np.nan)
    # flatten leaves null arrays out
    x[np.arange(x.shape[1]) < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return x


def _routes(trees: list[_Tree], values: pa.Array) -> pa.Array:
    x = _matrix(values)
    steps = max(t.steps for t in trees)
    paths = np.empty((len(x), len(trees), steps + 1), np.int32)
    said = np.empty((len(x), len(trees)))
    for i, tree in enumerate(trees):
        path = tree.paths(x)
        paths[:, i, : path.shape[1]] = path
        paths[:, i, path.shape[1] :] = path[:, -1:]
        said[:, i] = tree.prediction[path[:, -1]]
    # a path ends where it stays
    new = np.ones(paths.shape, bool)
    new[:, :, 1:] = paths[:, :, 1:] != paths[:, :, :-1]
    ends = np.concatenate([[0], np.cumsum(new.sum(axis=2).ravel())]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(paths[new]))
    each = pa.StructArray.from_arrays([listed, pa.array(said.ravel())], ["path", "prediction"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(trees)), each)


def route(nodes: DataFrame, values: str | Column) -> Column:
    """Per tree a struct (path, prediction): the nodes that a row passes, root first, and what its leaf says.

    `values` is an array of doubles, by place of the feature.  A null value is
    in no choice and below no cut, so it goes right.  A batch of rows goes down
    a tree together, a step at a time.
    """
    names = ("feature", "cut", "choices", "left", "right", "prediction")
    node = F.struct("node", *names)
    found = nodes.groupBy("tree").agg(F.to_json(F.sort_array(F.collect_list(node))).alias("nodes")).orderBy("tree")
    trees = [_Tree(json.loads(r.nodes)) for r in found.collect()]

    @F.arrow_udf(_ROUTES)
    def routed(batch: pa.Array) -> pa.Array:
        return _routes(trees, batch)

    values = F.col(values) if isinstance(values, str) else values
    return routed(values.cast("array<double>"))


def average(routes: str) -> Column:
    """The mean prediction of all trees, from a column of `route`."""
    said = F.col(f"{routes}.prediction")
    return F.aggregate(said, F.lit(0.0), lambda total, p: total + p) / F.size(said)


def node_facts(df: DataFrame, routes: str, label: str) -> DataFrame:
    """(tree, node, found_rows, found_mean, found_impurity) of the rows of `df` that reach each node.

    A row adds to every node of its paths, as partial sums before the shuffle;
    the shuffle holds a row per node and task.
    """
    reached = df.select(F.col(label).cast("double").alias("y"), F.posexplode(f"{routes}.path").alias("tree", "path"))
    return reached.select("tree", "y", F.explode("path").alias("node")).groupBy("tree", "node").agg(
        F.count("y").alias("found_rows"), F.avg("y").alias("found_mean"), F.var_pop("y").alias("found_impurity")
    )


def with_facts(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """The node table beside `node_facts`, and the `found_gain` of each cut: the impurity that it takes away.

    A node that no row reaches has 0 rows and nulls.
    """
    both = nodes.join(facts, ["tree", "node"], "left").withColumn("found_rows", F.coalesce("found_rows", F.lit(0)))

    def child(side: str) -> DataFrame:
        share = F.col("found_rows") * F.coalesce("found_impurity", F.lit(0.0))
        return facts.select("tree", F.col("node").alias(side), share.alias(f"{side}_spread"))

    both = both.join(child("left"), ["tree", "left"], "left").join(child("right"), ["tree", "right"], "left")
    left = F.coalesce("left_spread", F.lit(0.0)) + F.coalesce("right_spread", F.lit(0.0))
    gain = F.when(F.col("left") >= 0, F.col("found_impurity") - left / F.col("found_rows"))
    return both.select(*nodes.columns, "found_rows", "found_mean", "found_impurity", gain.alias("found_gain"))
