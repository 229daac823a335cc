"""Ranks that no single task has to compute for a whole group.

Rows fall into radix buckets of the order; buckets are counted, the counts summed up
per group (a small table), and rows ranked within their bucket. A group that holds a
third of all rows is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import radix


def with_rank(df: DataFrame, keys: list[str], order: Column, name: str, bucket: Column | None = None, then: list | None = None) -> DataFrame:
    """df with a 1-based rank (long) per group of keys by order, then by ``then``.
    ``bucket`` must rise with order; without one, order is a hash order."""
    then = then or []
    marked = df.withColumn("_order", order).withColumn("_bucket", radix(F.col("_order")) if bucket is None else bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = _before(sizes, keys, cascade=bucket is not None)
    on = marked["_bucket"].eqNullSafe(before["_b"])
    for i, k in enumerate(keys):
        on = on & marked[k].eqNullSafe(before[f"_k{i}"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_order", *then))
    return (
        marked.join(before, on).withColumn(name, (F.col("_before") + inside).cast("long"))
        .drop("_order", "_bucket", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
    )


def _before(sizes: DataFrame, keys: list[str], cascade: bool) -> DataFrame:
    """(_k0, _k1, ..., _b, _before): the sum of _n over all buckets before each of its
    group. Radix buckets are a few thousand. Numbered ones grow with the data: they are
    summed within runs of 4,096 buckets, and only the runs' sums pass one task."""
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_n")
    own = [f"_k{i}" for i in range(len(keys))]
    back = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not cascade:
        return named.select(*own, "_b", back(Window.partitionBy(*own).orderBy("_b")).alias("_before"))
    named = named.withColumn("_run", F.floor(F.col("_b") / 4096))
    runs = named.groupBy(*own, "_run").agg(F.sum("_n").alias("_n")).withColumn("_past", back(Window.partitionBy(*own).orderBy("_run")))
    runs = runs.select(*[F.col(c).alias(f"{c}r") for c in own], F.col("_run").alias("_r"), "_past")
    on = named["_run"].eqNullSafe(runs["_r"])
    for c in own:
        on = on & named[c].eqNullSafe(runs[f"{c}r"])
    inside = named.withColumn("_inside", back(Window.partitionBy(*own, "_run").orderBy("_b")))
    return inside.join(runs, on).select(*own, "_b", (F.col("_past") + F.col("_inside")).alias("_before"))


def with_running_sum(df: DataFrame, order: Column, value: str, name: str, bucket: Column | None = None) -> DataFrame:
    """df with the sum of ``value`` over all rows up to each in an order, itself
    included; as in with_rank, buckets are summed up first."""
    marked = df.withColumn("_order", order).withColumn("_bucket", radix(F.col("_order")) if bucket is None else bucket)
    sums = marked.groupBy("_bucket").agg(F.sum(value).alias("_n"))
    run = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    before = sums.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.join(before, marked["_bucket"] == before["_b"])
    return joined.withColumn(name, F.col("_before") + inside).drop("_order", "_bucket", "_b", "_before")


def number_bucket(column: str, width: int) -> Column:
    """Buckets of ``width`` consecutive numbers."""
    return F.floor(F.col(column) / width)


def hash_sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n first rows of a hash order: a top-n heap per task, no sort of all rows."""
    return df.withColumn("_order", order).orderBy("_order").limit(n).drop("_order")
