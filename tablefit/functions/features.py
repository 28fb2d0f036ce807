"""Feature expressions over typed columns (names or Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def year(day: ColumnLike) -> Column:
    return F.year(_col(day)).cast("double")


def month(day: ColumnLike, override: ColumnLike | None = None) -> Column:
    """Month of the date, unless the overriding number is there."""
    from_date = F.month(_col(day)).cast("double")
    return from_date if override is None else F.coalesce(_col(override), from_date)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not or is unknown."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def missing(value: ColumnLike) -> Column:
    return flag(_col(value).isNull())


def ratio(value: ColumnLike, constant: float) -> Column:
    if constant == 0:
        raise ValueError("ratio needs a constant other than zero")
    return _col(value) / F.lit(float(constant))


def safe_ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, or null unless the denominator is above zero."""
    below = _col(denominator)
    return F.when(below > 0, _col(numerator) / below)


def days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Days from start to end; negative when end comes first."""
    return F.datediff(_col(end), _col(start))


def log1p_clipped(value: ColumnLike) -> Column:
    """Natural log of 1 + value, with null and negative values taken as 0."""
    at_least_zero = F.greatest(F.coalesce(_col(value), F.lit(0.0)), F.lit(0.0))
    return F.ln(F.lit(1.0) + at_least_zero)
