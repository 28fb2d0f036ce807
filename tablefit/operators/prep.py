"""Feature vectors: index, encode, impute, assemble and scale.

The stages are Spark ML's own wherever their fit holds at scale.  Two fits are
replaced: levels are counted by an ordinary aggregate, and those of a wide column
stay a table; medians survive a column without values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.operators.quantiles import approximate_quantiles, exact_quantiles
from tablefit.sources.tables import scratch, written
from tablefit.specs import FeatureSpec

REL_ERROR = 0.001

#: Up to so many levels a column's labels are held by the driver and by each task.
MODEL_LEVELS = 10_000


class LevelIndexer(Estimator):
    """Levels to indices by falling frequency, equal ones by name.

    A null or unseen level gets the index after the last.  All columns are
    counted in one scan.  A column of at most MODEL_LEVELS levels fits to Spark's
    StringIndexerModel, whose labels the driver and each task hold; the levels of
    a wider one are numbered on Spark and stay a table (see `LevelTable`).  With
    `max_levels` a column of more levels fails instead.
    """

    def __init__(self, cats: Sequence[str], suffix: str = "_index", max_levels: int | None = None):
        super().__init__()
        self.cats, self.suffix, self.max_levels = list(cats), suffix, max_levels

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        # the counts go at the end; tables of wide columns belong to the model
        with scratch(dataset.sparkSession, "levels"):
            return self._counted(dataset)

    def _counted(self, dataset: DataFrame) -> PipelineModel:
        counts = written(
            dataset.select(*[F.col(c).cast("string").alias(c) for c in self.cats])
            .unpivot([], self.cats, "column", "level")
            .filter(F.col("level").isNotNull())
            .groupBy("column", "level")
            .agg(F.count(F.lit(1)).alias("n")),
            "level-counts",
        )
        sizes = {r.column: r.levels for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("levels")).collect()}
        if self.max_levels is not None:
            wide = sorted(c for c, levels in sizes.items() if levels > self.max_levels)
            if wide:
                raise ValueError(f"more than {self.max_levels} levels in {wide}; group them first")
        tables = {c: numbered(counts, c) for c, levels in sizes.items() if levels > MODEL_LEVELS}
        found: dict[str, list] = {c: [] for c in self.cats}
        # bounded by MODEL_LEVELS a column
        for row in counts.filter(~F.col("column").isin(list(tables))).collect():
            found[row.column].append((-row.n, row.level))
        # One model per column: PySpark pads label lists of unequal length that
        # it passes together.
        return PipelineModel(
            [
                LevelTable(tables[c], sizes[c], c, c + self.suffix)
                if c in tables
                else StringIndexerModel.from_labels(
                    [level for _, level in sorted(found[c])], c, c + self.suffix, "keep"
                )
                for c in self.cats
            ]
        )


def numbered(counts: DataFrame, column: str) -> DataFrame:
    """(level, place) of one column of (column, level, n): places from 0 by falling n, then by level.

    The table is a result of the scope it is numbered in.  Ranges of the order are numbered apart; only the number of levels of each
    range comes to the driver.
    """
    spark = counts.sparkSession
    ordered = (
        counts.filter(F.col("column") == column)
        .select("level", (-F.col("n")).alias("rank"))
        .repartitionByRange("rank", "level")
        .sortWithinPartitions("rank", "level")
    )
    # the id holds the task in its upper bits and the row's place in the task in the lower 33
    row = F.monotonically_increasing_id()
    placed = written(ordered.select("level", row.alias("row")), "level-places", result=True).select(
        "level", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")
    )
    starts, start = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.part, start))
        start += r.n
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    return placed.join(offsets, "part").select("level", (F.col("start") + F.col("within")).alias("place"))


class LevelTable(Model):
    """Indices of one column from a table (level, place) of `levels` rows, by a join; rows may change their order."""

    def __init__(self, table: DataFrame, levels: int, column: str, output: str):
        super().__init__()
        self.table, self.levels, self.column, self.output = table, levels, column, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        level, place = f"{self.output}_level", f"{self.output}_place"
        table = self.table.select(F.col("level").alias(level), F.col("place").alias(place))
        joined = dataset.join(table, F.col(self.column).cast("string") == F.col(level), "left")
        index = F.coalesce(place, F.lit(self.levels)).cast("double")
        # one more for null and unseen levels
        known = {"ml_attr": {"type": "nominal", "name": self.output, "num_vals": self.levels + 1}}
        return joined.withColumn(self.output, index.alias(self.output, metadata=known)).drop(level, place)


class ToDouble(Transformer):
    """Numeric features of any type as doubles, in place."""

    def __init__(self, nums: Sequence[str]):
        super().__init__()
        self.nums = list(nums)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.col(c).cast("double") for c in self.nums})


class MedianImputer(Estimator):
    """Null and NaN become the median (the lower middle value) of the column.

    With `rel_error` above 0 the median is within that share of the rows, all
    columns in one pass; 0 takes more passes and gives the exact one.  A
    column without any value gets `empty_value`, and the fitted model lists it in `empty`.
    """

    def __init__(
        self,
        nums: Sequence[str],
        rel_error: float = REL_ERROR,
        empty_value: float = 0.0,
        suffix: str = "_imputed",
    ):
        super().__init__()
        self.nums, self.rel_error = list(nums), rel_error
        self.empty_value, self.suffix = empty_value, suffix

    def _fit(self, dataset: DataFrame) -> MedianModel:
        doubles = dataset.select(*[F.col(c).cast("double").alias(c) for c in self.nums])
        if self.rel_error > 0:
            found = approximate_quantiles(doubles, self.nums, [0.5], self.rel_error)
        else:
            found = exact_quantiles(doubles, {c: [0.5] for c in self.nums})
        medians = {c: v[0] for c, v in found.items()}
        empty = [c for c, v in medians.items() if v is None]
        fills = {c: self.empty_value if v is None else v for c, v in medians.items()}
        return MedianModel(fills, empty, self.suffix)


class MedianModel(Model):
    def __init__(self, fills: dict[str, float], empty: list[str], suffix: str):
        super().__init__()
        self.fills, self.empty, self.suffix = fills, empty, suffix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {}
        for name, fill in self.fills.items():
            value = F.col(name).cast("double")
            present = value.isNotNull() & ~F.isnan(value)
            filled[name + self.suffix] = F.when(present, value).otherwise(F.lit(fill))
        return dataset.withColumns(filled)


def index(cats: Sequence[str], max_levels: int | None = None) -> LevelIndexer:
    return LevelIndexer(cats, max_levels=max_levels)


def one_hot(cats: Sequence[str]) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[f"{c}_index" for c in cats],
        outputCols=[f"{c}_encoded" for c in cats],
        handleInvalid="keep",
    )


def to_double(nums: Sequence[str]) -> ToDouble:
    return ToDouble(nums)


def impute(
    nums: Sequence[str], strategy: str = "median", rel_error: float = REL_ERROR
) -> MedianImputer:
    if strategy != "median":
        raise ValueError(f"no such strategy: {strategy}")
    return MedianImputer(nums, rel_error)


def assemble(
    inputs: Sequence[str], output: str = "features_raw", complete: bool = False
) -> VectorAssembler:
    """One vector per row; rows with a null or NaN input are left out (see
    `skipped_rows`).

    `complete` inputs hold neither, and are not looked at for it: the filter
    would make every input that a row's own functions make a second time.
    """
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="keep" if complete else "skip")


def scale(
    input: str = "features_raw",
    output: str = "features",
    with_std: bool = True,
    with_mean: bool = False,
) -> StandardScaler:
    """Division by the sample standard deviation; without centring, sparse
    vectors stay sparse."""
    return StandardScaler(inputCol=input, outputCol=output, withStd=with_std, withMean=with_mean)


def assembled_inputs(spec: FeatureSpec) -> list[str]:
    return [f"{c}_encoded" for c in spec.cats] + [f"{c}_imputed" for c in spec.nums]


def build(
    spec: FeatureSpec, rel_error: float = REL_ERROR, max_levels: int | None = None
) -> Pipeline:
    """All preparation stages; fit it on the training rows only.

    `max_levels` bounds the levels of a category (see `LevelIndexer`).
    """
    categories = [index(spec.cats, max_levels), one_hot(spec.cats)] if spec.cats else []
    numbers = [impute(spec.nums, rel_error=rel_error)] if spec.nums else []
    # null and unseen levels are encoded, null and NaN numbers filled
    vectors = assemble(assembled_inputs(spec), complete=True)
    return Pipeline(stages=[*categories, *numbers, vectors, scale()])


def fit_on_kept(
    pipeline: Pipeline, df: DataFrame, columns: Sequence[str], keep: Callable[[DataFrame], DataFrame]
) -> tuple[PipelineModel, DataFrame]:
    """`pipeline.fit(df)` for stages as those of `build`, and the unscaled vectors it was fitted on beside `columns`.

    `keep` writes the vectors and reads them back, so that rows become vectors
    once: the scaler, the last stage, is fitted on what is kept.
    """
    *earlier, scaler = pipeline.getStages()
    fitted = Pipeline(stages=earlier).fit(df)
    output = scaler.getInputCol()
    raw = fitted.transform(df).select(*columns, output)
    vectors = keep(raw).withMetadata(output, raw.schema[output].metadata)
    return PipelineModel([*fitted.stages, scaler.fit(vectors)]), vectors


def _invalid(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def skipped_rows(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """How many rows `assemble` leaves out because of a null or NaN input."""
    bad = F.lit(False)
    for name in inputs:
        bad = bad | _invalid(df, name)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("skipped"))


def width(df: DataFrame, name: str) -> int:
    """Length of a vector column, from its metadata or else from one row."""
    known = df.schema[name].metadata.get("ml_attr", {}).get("num_attrs")
    if known is not None:
        return int(known)
    row = df.select(name).filter(F.col(name).isNotNull()).first()
    if row is None:
        raise ValueError(f"no vector in {name}")
    return int(row[0].size)
