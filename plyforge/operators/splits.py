"""Held-out splits, quotas and group holdouts by seeded hash orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_order, radix
from ..store import stash
from .ranking import with_rank, with_running_sum


def stratified_sample(df: DataFrame, split: str, key: str, text: str, n: int, seed: int) -> DataFrame:
    """n rows of each split, no text twice: a text belongs to the first split and
    key that has it."""
    owner = df.groupBy(text).agg(F.min(F.struct(F.col(split).alias("s"), F.col(key).alias("k"))).alias("o"))
    distinct = owner.select(F.col("o.s").alias(split), F.col("o.k").alias(key))
    return with_rank(distinct, [split], hash_order(seed, key), "rank").filter(F.col("rank") <= n)


def quota_fill(df: DataFrame, bucket: str, key: str, quotas: dict[str, int], target: int, seed: int) -> DataFrame:
    """target rows: from each bucket its quota, then the best-placed left over. Counts
    those within the quotas by a job while the plan is built."""
    order = hash_order(seed, key)
    ranked = with_rank(df, [bucket], order, "_rank")
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(bucket) == name, n).otherwise(quota)
    marked = ranked.withColumn("filled", F.when(F.col("_rank") <= quota, "quota").otherwise("backfill")).drop("_rank")
    # two groups: those within their quotas stand before all others
    placed = with_rank(marked, ["filled"], order, "_place")
    n_quota = marked.filter("filled = 'quota'").count()
    return placed.filter((F.col("filled") == "quota") | (F.col("_place") <= max(0, target - n_quota))).drop("_place")


def group_holdout(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """df with ``side``: whole groups go to eval, max(1, int(n * share)) of them;
    rows without a group stay in train. Counts the groups by a job while the plan is
    built."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    n = groups.count()
    take = min(n, max(1, int(n * share))) if n else 0
    held = with_rank(groups, [], hash_order(seed, group), "_rank").filter(F.col("_rank") <= take).select(F.col(group).alias("_held"))
    return df.join(held, F.col(group) == F.col("_held"), "left").withColumn("side", F.when(F.col("_held").isNotNull(), "eval").otherwise("train")).drop("_held")


def split_by_key(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with ``side``; all rows of a key are on one side."""
    first = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("side", F.when(first < share, "eval").otherwise("train"))


def greedy_keys(counts: DataFrame, key: str, task: str, n: str, share: float, seed: int, existing: DataFrame | None = None) -> DataFrame:
    """(key, task) of the eval keys, chosen task by task in order of their names: keys
    with few rows first, equal ones in hash order, as long as taking one more overshoots
    the task's share of rows (one at least) by no more than it would fall short. As
    keys come in rising size, that is the start of the order. Keys of ``existing`` and
    keys chosen for an earlier task count for a task but aren't chosen again; a task
    that would have none gets its smallest key if it has two. Tasks are few; keys may
    be any number. Runs jobs for each task while the plan is built."""
    spark = counts.sparkSession
    rows = counts.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(task).cast("string"), F.lit("")).alias("task"), F.col(n).cast("long").alias("n")).filter("key is not null")
    rows = rows.groupBy("key", "task").agg(F.sum("n").alias("n"))
    chosen = spark.createDataFrame([], "key string, task string")
    if share <= 0:
        return chosen
    known = (existing.select(F.col("key").cast("string").alias("key")) if existing is not None else chosen.select("key")).distinct()
    for t in sorted(rows.groupBy("task").agg(F.sum("n").alias("total")).collect(), key=lambda r: r["task"]):
        own = rows.filter(F.col("task") == t["task"])
        held = known.union(chosen.select("key")).distinct()
        before = own.join(held, "key", "left_semi").agg(F.sum("n")).first()[0] or 0
        goal = max(1, int(t["total"] * share))
        rest = stash(own.join(held, "key", "left_anti").withColumn("order", F.concat(F.lpad(F.col("n").cast("string"), 20, "0"), hash_order(seed, "key"))), "groups")
        # sizes first, and within a size the hash's first digits: buckets rise with the order
        bucket = F.col("n") * 4096 + radix(F.substring("order", 21, 64))
        summed = with_running_sum(rest, F.col("order"), "n", "upto", bucket).withColumn("taken", F.col("upto") - F.col("n") + before)
        fits = (F.col("taken") < goal) & (2 * F.col("taken") + F.col("n") <= 2 * goal)
        more = stash(summed.filter(fits).select("key", "task"), "more")
        if not before and more.isEmpty() and len(rest.limit(2).collect()) == 2:
            more = rest.orderBy("order").limit(1).select("key", "task")
        chosen = stash(chosen.unionByName(more), "keys")
    return chosen


def labels_of(conditions: list[tuple[Column, str]]) -> Column:
    """Every label whose condition holds: one row to many."""
    return F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in conditions])))
