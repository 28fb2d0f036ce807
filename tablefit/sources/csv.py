"""CSV files read as text, with a usable header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_names(names: Sequence[str | None]) -> list[str]:
    """Trimmed names; a blank one gets its position, a repeat the next free `_n`.

    Names are told apart without regard to case, as Spark does when it looks
    them up, and a suffix never collides with a name of the header itself.
    """
    trimmed = [(name or "").strip() or f"_c{i}" for i, name in enumerate(names)]
    first_use = {name.lower() for name in trimmed}
    seen: dict[str, int] = {}
    result = []
    for name in trimmed:
        repeat = seen.get(name.lower(), 0) + 1
        chosen = name
        if repeat > 1:
            while f"{name}_{repeat}".lower() in first_use:
                repeat += 1
            chosen = f"{name}_{repeat}"
            first_use.add(chosen.lower())
        seen[name.lower()] = repeat
        result.append(chosen)
    return result


def read_text_csv(
    spark: SparkSession, path: str | list[str], multiline: bool = True, malformed: str | None = None
) -> DataFrame:
    """Read CSV files with every column a string, under normalised names.

    `path` may be a file, a directory or a list of them.  With `multiline` a
    quoted field may hold line breaks, and each file is one task: give it many
    files.  Without it files are split by size, but a quoted line break ends
    the row, so use it only where fields hold none.

    All files must carry the header of the first; a file with another one fails
    the read.  Spark compares them itself unless names are repeated or blank;
    then the first rows of all files are compared beforehand, which reads the
    files once more.  `malformed` names a boolean column to add: whether the row
    had more or fewer cells than the header.
    """
    reader = spark.read.options(
        quote='"', escape='"', mode="PERMISSIVE", multiLine=multiline, encoding="UTF-8"
    )
    header = reader.csv(path).head()
    if header is None:
        raise ValueError(f"no header row in {path}")
    names = normalize_names(header)
    written = [name or "" for name in header]
    comparable = all(written) and len({n.lower() for n in written}) == len(written)
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in (written if comparable else names)]
    )
    if not comparable:
        _same_headers(reader, path, len(header))
    if malformed is None:
        table = reader.options(header=True, enforceSchema=not comparable).schema(schema).csv(path)
        return table.toDF(*names)
    corrupt = "_corrupt"
    while corrupt in names or corrupt in written:
        corrupt += "_"
    table = (
        reader.options(header=True, enforceSchema=not comparable, columnNameOfCorruptRecord=corrupt)
        .schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]))
        .csv(path)
    )
    return table.toDF(*names, corrupt).withColumn(malformed, F.col(corrupt).isNotNull()).drop(corrupt)


def _same_headers(reader: DataFrameReader, path: str | list[str], width: int) -> None:
    """Fail unless the first row of every file is the same."""
    cells = [f"c{i}" for i in range(width)]
    # one cell more, so that a longer header differs
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "more"]])
    rows = reader.schema(schema).csv(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # ids rise within a task, and a file's first block is in one
        F.monotonically_increasing_id().alias("place"),
        F.struct(*cells, "more").alias("cells"),
    )
    first = rows.where("block = 0").groupBy("file").agg(F.min_by("cells", "place").alias("cells"))
    if first.select("cells").distinct().limit(2).count() > 1:
        raise ValueError(f"files with different headers in {path}")


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the name of the file each row came from; for a table just read."""
    return df.withColumn(name, F.col("_metadata.file_name"))
