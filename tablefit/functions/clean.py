"""Column cleaners: text in, typed value out.

Every cleaner takes the table and a column name, so that a column the input
lacks becomes a typed null (or the fill level, for a category).  Parsing never
raises: text that cannot be read becomes null, also with ANSI mode on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(df: DataFrame, name: str) -> bool:
    """Whether the session would find a column of this name."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return name in df.columns
    return name.lower() in {c.lower() for c in df.columns}


def finite(value: Column) -> Column:
    """NaN and infinities, which text may spell, are no numbers here."""
    return F.when(F.abs(value) < float("inf"), value)


def parsed(text: Column) -> Column:
    """The text as a double, which need not be finite.

    The parser raises and catches an error for each text that is no number,
    which takes many times as long as to read one.  Text that cannot be one is
    told by its first character: numbers begin with a digit, a sign or a point,
    and the parser skips control characters.  Spelt NaN and infinities without a
    sign are left out with the rest.
    """
    start = F.ltrim(text)
    number = (start >= "+") & (start < ":")
    control = (start != "") & (start < "!")
    return F.when(number | control, text.try_cast("double"))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def absent(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def string(df: DataFrame, name: str) -> Column:
    """Trimmed text; blank text is null."""
    if not has(df, name):
        return absent("string")
    text = F.trim(column(name))
    # a conditional, not nullif: that would be a projection of its own, as wide as the table
    return F.when(text != "", text)


def category(df: DataFrame, name: str, fill: str = "unknown", fill_null: bool = False) -> Column:
    """Trimmed level; blank text and an absent column are `fill`.

    A null cell stays null unless `fill_null` is set.
    """
    if not has(df, name):
        return F.lit(fill)
    level = F.trim(column(name))
    filled = F.when(level == "", F.lit(fill)).otherwise(level)
    return F.coalesce(filled, F.lit(fill)) if fill_null else filled


def parsed_currency(df: DataFrame, name: str, symbols: str = "$,") -> Column:
    """`currency` that need not be finite."""
    if not has(df, name):
        return absent("double")
    # a text without the character is left as it is; translate looks up every
    # character of every cell, and a regular expression runs its matcher on it
    bare = column(name)
    for symbol in symbols:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    return parsed(bare)


def currency(df: DataFrame, name: str, symbols: str = "$,") -> Column:
    """Amount after removal of every character of `symbols`."""
    return finite(parsed_currency(df, name, symbols))


def flag(df: DataFrame, name: str, true: str = "t", false: str = "f") -> Column:
    """1.0 / 0.0 for the two marks in either case, null for anything else."""
    if not has(df, name):
        return absent("double")
    mark = F.lower(F.trim(column(name)))
    return F.when(mark == true, F.lit(1.0)).when(mark == false, F.lit(0.0))


def parsed_number(df: DataFrame, name: str) -> Column:
    """`number` that need not be finite."""
    return parsed(column(name)) if has(df, name) else absent("double")


def number(df: DataFrame, name: str) -> Column:
    return finite(parsed_number(df, name))


def date(df: DataFrame, name: str) -> Column:
    """ISO-like date; `2020` and `2020-01` are the first day of the period."""
    return string(df, name).try_cast("date")
