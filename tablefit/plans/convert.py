"""CSV files to a clean Parquet table, with a count of what went in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.operators.summary import reconcile_counts, row_digest, value_digest
from tablefit.plans.clean_table import clean_table
from tablefit.sources.csv import read_text_csv, with_source_file
from tablefit.sources.records import read_split_csv
from tablefit.sources.tables import read_table, write_table
from tablefit.specs import CleanSpec

MALFORMED, DIGEST = "_malformed", "_digest"


def convert_csv(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    spec: CleanSpec,
    partitions: int | None = None,
    partition_by: Sequence[str] = (),
    multiline: bool = True,
    split: bool = False,
    digest: bool = False,
) -> DataFrame:
    """Write the clean table and return rows per kept value, handed to the
    writer and read back, with their difference, and how many of them had more
    or fewer cells than the header (`malformed`).

    The rows handed over are counted by the write itself, so the CSV is parsed
    once.  Unless `partitions` fixes the number of files, rows are rebalanced
    to files of even size, however uneven the CSV files are.  With `split` each
    multi-line file is read by many tasks, and files may differ in their headers.

    With `digest` values are verified too: `same_values` says whether the rows
    read back have the values that were handed over.  Columns of `partition_by`
    are left out of it, as their type is inferred when read.
    """
    if split:
        raw = read_split_csv(spark, source, malformed=MALFORMED, source_file="source_file")
    else:
        raw = with_source_file(read_text_csv(spark, source, multiline, malformed=MALFORMED))
    key, values = spec.keep_column, list(spec.keep_values)
    per_value = [F.count_if(F.col(key) == v).alias(f"n{i}") for i, v in enumerate(values)]
    odd = [
        F.count_if((F.col(key) == v) & F.col(MALFORMED)).alias(f"m{i}") for i, v in enumerate(values)
    ]
    clean = clean_table(raw, spec, carry=[MALFORMED])
    names = [c for c in clean.columns if c != MALFORMED and c not in partition_by]
    sums, unwritten = [], [MALFORMED]
    if digest:
        # a column of its own, as observed aggregates are not compiled
        clean = clean.withColumn(DIGEST, row_digest(names))
        sums = [F.sum(F.when(F.col(key) == v, F.col(DIGEST))).alias(f"d{i}") for i, v in enumerate(values)]
        unwritten.append(DIGEST)
    counts = write_table(
        clean, target, partitions, partition_by, True, [*per_value, *odd, *sums], unwritten
    )
    before = {v: counts[f"n{i}"] for i, v in enumerate(values)}
    found = reconcile_counts(before, read_table(spark, target), key)
    malformed = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, counts[f"m{i}"])))
    found = found.withColumn("malformed", F.coalesce(malformed[F.col(key)], F.lit(0)).cast("bigint"))
    if not digest:
        return found
    # a row per kept value on both sides
    handed = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(v).alias(key), F.lit(counts[f"d{i}"]).cast("decimal(30,0)").alias("handed")) for i, v in enumerate(values)
    ))))
    read = value_digest(read_table(spark, target), key, names).select(key, "digest")
    return found.join(F.broadcast(handed), key, "left").join(read, key, "left").select(
        *found.columns, F.col("handed").eqNullSafe(F.col("digest")).alias("same_values")
    )
