"""Raw text table to clean typed table, without moving a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions import clean, features
from tablefit.specs import CleanSpec


def clean_table(
    df: DataFrame, spec: CleanSpec, source_file: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """The spec's columns for the rows whose kept column is listed.

    The schema does not depend on which columns `df` has; only the column that
    chooses the rows must be there.  `source_file` is the file name to record;
    without it a `source_file` column of `df` is used.  `carry` adds columns of
    `df` as they are.
    """
    if not clean.has(df, spec.source(spec.keep_column)):
        raise ValueError(f"no column {spec.source(spec.keep_column)}, which chooses the rows")
    day = clean.date(df, spec.source(spec.snapshot_date))
    file_name = clean.string(df, "source_file") if source_file is None else F.lit(source_file)
    built = {
        "source_file": file_name,
        "snapshot_year": features.year(day),
        "snapshot_month": features.month(day, clean.number(df, spec.snapshot_month)),
    }
    kinds = [
        (clean.string, spec.strings),
        (clean.date, spec.dates),
        (clean.category, spec.categories),
        (clean.parsed_number, spec.numbers),
        (clean.parsed_currency, spec.currencies),
        (clean.flag, spec.flags),
    ]
    for cleaner, names in kinds:
        built |= {name: cleaner(df, spec.source(name)) for name in names}
    ordered = [*spec.order, *[n for n in built if n not in spec.order]]
    kept = clean.string(df, spec.source(spec.keep_column)).isin(list(spec.keep_values))
    # `finite` looks at a value twice: a second projection, so that the text is parsed once
    read = df.filter(kept).select(*[built[n].alias(n) for n in ordered], *carry)
    doubles = {*spec.numbers, *spec.currencies}
    values = [clean.finite(clean.column(n)).alias(n) if n in doubles else clean.column(n) for n in ordered]
    return read.select(*values, *carry)
