"""Parquet tables, views, and ways to keep an intermediate table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tablefit.sources.layout import clustered

# A method of more bytes than this is never compiled to machine code by the JVM.
COMPILED_METHOD_BYTES = 8000
# Tasks a core that a wide pass over a table is cut into.
TASKS_PER_CORE = 3


def tune(spark: SparkSession) -> SparkSession:
    """Set what the wide projections here need, and return the session.

    A projection of some sixty parsed columns becomes one generated method that
    is too long for the JVM to compile and runs interpreted.  With this limit
    Spark splits such a projection into short methods instead; it took less
    than half the time.

    Spark cuts a scan or a merged shuffle into about as many tasks as there are
    cores, often a few more, so that most cores wait for a second round of few
    tasks.  With several tasks a core they end at about the same time; files and
    partitions of a few megabytes stay whole.  A number that is already set stays
    if it is larger.  Nothing but speed depends on these settings.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.minPartitionNum"):
        spark.conf.set(name, max(tasks, int(spark.conf.get(name, None) or 0)))
    return spark


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partitions: int | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
    observed: Sequence[Column] = (),
    unwritten: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
) -> Mapping[str, object]:
    """Overwrite `path` with snappy Parquet.

    A given number of `partitions` spreads rows evenly over that many files;
    with `rebalance` Spark chooses the number from the size of the data.
    Otherwise rows stay in the tasks they are in, except that a partitioned
    table is always rebalanced on its partition columns: each value lands in
    few files, and Spark splits a value that holds a large part of all rows
    over several tasks.  With `cluster_by` rows close in all those columns are
    written close together, so that filters on any of them skip row groups (see
    `layout.clustered`); it goes with `partitions`, not with `partition_by`.
    That reads the rows three times, for quantiles, for ranges and to deal them,
    so they are kept in the shared folder meanwhile and made only once.

    Named aggregates in `observed` are computed by the write itself and
    returned.  They sit behind the shuffle, in the tasks that write, so a
    recomputed shuffle task does not count twice.  Columns in `unwritten` are
    there for them alone.
    """
    by = list(partition_by)
    if cluster_by:
        if by:
            raise ValueError("a table is either partitioned or clustered")
        with stored(df, "unclustered") as rows:
            layout = clustered(rows, cluster_by, partitions)
            return write_table(layout, path, observed=observed, unwritten=unwritten)
    elif partitions is not None:
        df = df.repartition(partitions)
    elif by or rebalance:
        df = df.hint("rebalance", *by)
    observation = Observation()
    if observed:
        df = df.observe(observation, *observed)
    df = df.drop(*unwritten)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return observation.get if observed else {}


#: Names the folder of the published version of a table.
POINTER = "_current"


def _folder(spark: SparkSession, path: str):
    """Hadoop's path and the file system it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_table(df: DataFrame, path: str, keep: int = 1, **write) -> Mapping[str, object]:
    """Write a new version of the table beside the old one, then make it the one that `read_published` reads.

    A version is a folder of its own under `path`.  Only when it is whole does
    the pointer file change, by one rename; a job that fails before leaves the
    old rows in place.  `keep` older versions stay for readers that have begun;
    those before them go.  Of two publishers at once the last one wins.  The
    other arguments and the result are those of `write_table`.
    """
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    folder, files = _folder(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    found = write_table(df, f"{path.rstrip('/')}/{version}", **write)
    fresh = jvm.org.apache.hadoop.fs.Path(folder, f"{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(fresh, False)
    stream.write(bytearray(version.encode()))
    stream.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kinds, 1)
    overwrite[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    pointer = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), overwrite)
    versions = [s for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName() != version]
    for old in sorted(versions, key=lambda s: -s.getModificationTime())[keep:]:
        files.delete(old.getPath(), True)
    return found


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version of the table that was published last."""
    folder, files = _folder(spark, path)
    reader = spark._jvm.java.io.BufferedReader(
        spark._jvm.java.io.InputStreamReader(files.open(spark._jvm.org.apache.hadoop.fs.Path(folder, POINTER)))
    )
    try:
        version = reader.readLine()
    finally:
        reader.close()
    return read_table(spark, f"{path.rstrip('/')}/{version}")


def register(df: DataFrame, name: str) -> DataFrame:
    """Name the table for SQL."""
    df.createOrReplaceTempView(name)
    return df


#: Folders of the scopes around the running code, the innermost last.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_path(spark: SparkSession, name: str, result: bool = False) -> str:
    """A new path in a folder that all executors see: that of the scope (see
    `scratch`; for a `result` of the scope the folder around it), or without one
    spark.checkpoint.dir, or where it is unset a folder of the warehouse."""
    scopes = _SCOPES.get()
    scopes = scopes[:-1] if result else scopes
    base = scopes[-1] if scopes else spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/kept"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A scope that owns all tables kept while its `with` block runs, and deletes them at its end.

    Scopes nest.  What must outlive the block is written with `result=True`, or
    read before the end; a DataFrame that still reads a deleted table fails.  A
    scope is that of its thread: tables of threads started inside are not its own.
    """
    path = shared_path(spark, name)
    token = _SCOPES.set((*_SCOPES.get(), path))
    try:
        yield path
    finally:
        _SCOPES.reset(token)
        folder, files = _folder(spark, path)
        files.delete(folder, True)


def written(df: DataFrame, name: str = "table", result: bool = False) -> DataFrame:
    """Write the table to the shared folder and read it back.

    The result no longer depends on its inputs, nor on any executor.  It stays
    until its scope ends (see `scratch`; a `result` stays beyond it), or without
    one until the folder is emptied; see `stored`.
    """
    path = shared_path(df.sparkSession, name, result)
    write_table(df, path)
    return read_table(df.sparkSession, path)


@contextmanager
def stored(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """`written` for the length of a `with` block; the files go at its end."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    write_table(df, path)
    try:
        yield read_table(spark, path)
    finally:
        folder, files = _folder(spark, path)
        files.delete(folder, True)


@contextmanager
def cached(
    df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> Iterator[DataFrame]:
    """Keep a reused table for the length of a `with` block.

    Lost blocks are recomputed from the plan, so the plan must be repeatable;
    all operators here are.
    """
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()
