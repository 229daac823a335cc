"""Keep-first, keep-best and merge by key. All are aggregates with map-side
combination: a key with very many rows moves one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order (insert-or-ignore)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(_rows(df, rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by order (insert-or-replace, and keep-best where
    order begins with the quality; end it with a falling ordinal so that ties keep
    the earlier row)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(_rows(df, rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


keep_best = keep_last


def upsert_best(cache: DataFrame, scan: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep-best over what is cached and what is new; both have the same columns."""
    return keep_best(cache.unionByName(scan), keys, order)


def merge_tags(df: DataFrame, keys: list[str], ordinal: str, first: list[str], any_of: list[str] = (), count: str | None = None) -> DataFrame:
    """One row per key: the first row's ordinal, for each of ``first`` the first
    non-null value, whether any of the flags is set and, under the name ``count``, how
    many rows there were."""
    tags = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in first]
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of]
    return df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal), *tags, *flags, *([F.count("*").alias(count)] if count else []))
