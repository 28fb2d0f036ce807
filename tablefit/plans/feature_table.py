"""Clean table to feature table: filter, group, derive, project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablefit.operators.filters import in_range, keep_not_null
from tablefit.operators.grouping import TopNGrouper, TopNModel
from tablefit.specs import FeatureSpec


def filter_ranges(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    for r in spec.ranges:
        df = df.filter(in_range(r.column, r.low, r.high, r.allow_null))
    return df


def grouper(spec: FeatureSpec) -> TopNGrouper:
    return TopNGrouper(spec.groups, spec.other)


def project(
    df: DataFrame, label: str, cats: Sequence[str], nums: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    return df.select(*carry, label, *cats, *nums)


def build_features(
    df: DataFrame,
    spec: FeatureSpec,
    carry: Sequence[str] = (),
    groups: TopNModel | None = None,
) -> DataFrame:
    """Label and features of the rows within the spec's ranges.

    `carry` adds columns that are no features, such as the key of a split.  The
    frequent levels are those of the filtered table unless `groups` brings
    levels found elsewhere, for instance on training rows only.
    """
    spec.check(df)
    rows = filter_ranges(df, spec)
    grouped = (groups or grouper(spec).fit(rows)).transform(rows)
    derived = grouped.withColumns({name: make() for name, make in spec.derived.items()})
    return keep_not_null(project(derived, spec.label, spec.cats, spec.nums, carry), spec.label)
