"""Scores per split and task, paired comparison and gates, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mcnemar_p
from .reports import nearest_ranks


def score_split(examples: DataFrame, scores: DataFrame, key: str, split: str, task: str, primary: str, secondary: str) -> DataFrame:
    """(split, task, n, covered, primary_mean, secondary_mean, p50, p90): per task
    and, with task null, per split. A missing primary counts as 0, a missing
    secondary not at all; a split without any score is left out."""
    joined = examples.select(key, split, task).join(scores.select(key, primary, secondary, F.lit(1).alias("has")), key, "left")
    return (
        joined.withColumn("p", F.coalesce(F.col(primary), F.lit(0)).cast("double")).withColumn("s", F.col(secondary).cast("double"))
        .groupingSets([[F.col(split), F.col(task)], [F.col(split)]], F.col(split), F.col(task))
        .agg(
            F.count("*").alias("n"), F.count("has").alias("covered"), F.round(F.avg("p"), 6).alias("primary_mean"),
            F.round(F.avg("s"), 6).alias("secondary_mean"),
            F.expr("percentile_disc(0.5) within group (order by p)").alias("p50"),
            F.expr("percentile_disc(0.9) within group (order by p)").alias("p90"),
        )
        .filter("covered > 0")
    )


def nearest_rank(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, mean, p50, p90, p95) of each group's values."""
    return nearest_ranks(df, groups, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95}).withColumn("mean", F.round("mean", 6))


def paired_summary(df: DataFrame, groups: list[str], base: Column, cand: Column) -> DataFrame:
    """2 x 2 counts of hits (exactly 1), accuracies, their difference and the exact
    McNemar p, per group."""
    b, c = F.coalesce(base, F.lit(0.0)) == 1.0, F.coalesce(cand, F.lit(0.0)) == 1.0
    out = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(b & c).alias("both_correct"), F.count_if(~b & ~c).alias("both_wrong"),
        F.count_if(b & ~c).alias("baseline_only"), F.count_if(~b & c).alias("candidate_only"),
    )
    return out.withColumn("delta", F.round((F.col("candidate_only") - F.col("baseline_only")) / F.col("n"), 6)).withColumn(
        "p_value", F.round(mcnemar_p(F.col("baseline_only"), F.col("candidate_only")), 6)
    )


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def gate(metrics: DataFrame, criteria: DataFrame, keys: list[str]) -> DataFrame:
    """criteria(keys, low, high) with the value and status of each: pass, fail or
    missing. Null bounds don't bind."""
    ok = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return criteria.join(metrics, keys, "left").withColumn("status", F.when(F.col("value").isNull(), "missing").when(ok, "pass").otherwise("fail"))


def regressions(current: DataFrame, baseline: DataFrame, keys: list[str], drop: float = 0.05) -> DataFrame:
    """Metrics that fell by more than ``drop``; counts (names ending in _count) are
    compared not at all."""
    base = baseline.select(*keys, F.col("value").alias("baseline"))
    return current.join(base, keys).filter(~F.endswith("metric", F.lit("_count")) & (F.col("baseline") - F.col("value") > drop))


def best_baseline(history: DataFrame, keys: list[str]) -> DataFrame:
    """The best value so far: highest, but lowest for losses and counts."""
    lower = F.startswith("metric", F.lit("acpl")) | F.endswith("metric", F.lit("_count"))
    return history.groupBy(*keys).agg(F.when(F.first(lower), F.min("value")).otherwise(F.max("value")).alias("value"))
