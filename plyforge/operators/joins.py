"""Joins with a reason for every row that doesn't match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; raises if a key occurs twice. Looks at once, by a job of its own."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"repeated key {twice.first().asDict()}")
    return df


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The label of the first rule that holds; null if none does."""
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))


def without(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't blocked; rows without a key stay. The planner broadcasts
    the keys if they are few."""
    return df.join(blocked.select(F.col(key)).distinct(), key, "left_anti")


def with_neighbours(df: DataFrame, sampled: DataFrame, key: str, group: str) -> DataFrame:
    """Distinct keys of the sampled rows and of all rows of df in their groups."""
    groups = sampled.select(group).filter(F.col(group).isNotNull()).distinct()
    return sampled.select(key).union(df.join(groups, group, "left_semi").select(key)).distinct()


def missing_from(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(actual.select(*keys).distinct(), keys, "left_anti")
