"""What a table is cleaned into and what a model is fed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tablefit.operators.grouping import Group


@dataclass(frozen=True)
class CleanSpec:
    """Columns of the clean table, by kind, and the rows to keep.

    `renamed` maps an output name to its input name where they differ.  Year
    and month of the snapshot come from `snapshot_date`; a readable number in
    the `snapshot_month` column of the input goes before the date's month.
    """

    strings: Sequence[str]
    dates: Sequence[str]
    categories: Sequence[str]
    numbers: Sequence[str]
    currencies: Sequence[str]
    flags: Sequence[str]
    snapshot_date: str
    snapshot_month: str
    keep_column: str
    keep_values: Sequence[str]
    order: Sequence[str] = ()
    renamed: Mapping[str, str] = field(default_factory=dict)

    def source(self, name: str) -> str:
        return self.renamed.get(name, name)


@dataclass(frozen=True)
class Range:
    column: str
    low: float
    high: float
    allow_null: bool = False


@dataclass(frozen=True)
class FeatureSpec:
    """Label, features, and every column that must stay out, with the reason.

    `derived` builds features that the clean table lacks; `groups` names the
    categories reduced to their most frequent levels.
    """

    label: str
    cats: Sequence[str]
    nums: Sequence[str]
    excluded: Mapping[str, str]
    ranges: Sequence[Range] = ()
    groups: Sequence[Group] = ()
    other: str = "other"
    derived: Mapping[str, Callable[[], Column]] = field(default_factory=dict)

    def features(self) -> list[str]:
        return [*self.cats, *self.nums]

    def made(self) -> set[str]:
        return {g.output for g in self.groups} | set(self.derived)

    def check(self, df: DataFrame) -> None:
        """Fail if a column is used twice, used although excluded, missing, or
        neither used nor excluded."""
        features, columns = self.features(), set(df.columns)
        problems = {
            "used twice": {f for f in features if features.count(f) > 1},
            "excluded but used": set(features) & set(self.excluded),
            "label not excluded": {self.label} - set(self.excluded),
            "not in the table": (set(features) - self.made()) - columns,
            "neither used nor excluded": columns - set(features) - set(self.excluded),
        }
        found = {reason: sorted(names) for reason, names in problems.items() if names}
        if found:
            raise ValueError(f"feature lists do not fit the table: {found}")
