"""Shared helpers on the driver: picking input columns and keeping intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.sources.tables import shared_path


#: Lets a finished write's shuffle files go at once; nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: lineage ends here.

    The session's setting for shuffle files is put back after the write.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as a long) and the text (null: empty); other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; an unknown id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: Column, most: int, rows: int) -> DataFrame:
    """About `most` of `rows` rows (all, if fewer), chosen by a hash of the key."""
    if rows <= most:
        return df
    return df.where(F.abs(F.xxhash64(key, F.lit(17)) % F.lit(1 << 40)) < int((1 << 40) * most / rows))
