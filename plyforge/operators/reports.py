"""Summaries of losses, win probabilities, generated rows and gates, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank

# What a measurement must reach before training is gated by it, and the
# fields by which verifier answers have to be broken down.
WPD_MEANS = ("wpd", "best_expectation", "predicted_expectation", "reward")
WPD_RATES = {"multipv_hit": "multipv_hit_rate", "postmove_hit": "postmove_hit_rate", "cache_hit": "cache_hit_rate"}
STEP_FIELDS = ("source_task", "error_type", "corruption_kind")
# Fixed values end.


def nearest_ranks(df: DataFrame, groups: list[str], value: str, cuts: dict[str, float]) -> DataFrame:
    """(groups, n, mean, cuts...): of each group's values that aren't null, the value at
    rank ceil(cut * n). Equal values are counted first, and running counts are summed
    over buckets of values, so no task holds a group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    whole = counts.groupBy(*groups).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    named = whole.select(*[F.col(g).alias(f"_w{i}") for i, g in enumerate(groups)], "n", "mean", "_lo", "_hi")
    marked = counts.join(named, [counts[g].eqNullSafe(named[f"_w{i}"]) for i, g in enumerate(groups)]).drop(*[f"_w{i}" for i in range(len(groups))])
    width = F.greatest((F.col("_hi") - F.col("_lo")) / 4096, F.lit(1e-300))
    marked = marked.withColumn("_b", F.floor((F.col("_v") - F.col("_lo")) / width).cast("long"))
    ranked = _running(marked, groups)
    picked = [F.min(F.when(F.col("_upto") >= F.ceil(F.lit(c) * F.col("n")), F.col("_v"))).alias(name) for name, c in cuts.items()]
    return ranked.groupBy(*groups, "n", "mean").agg(*picked)


def _running(marked: DataFrame, groups: list[str]) -> DataFrame:
    """marked with the count of all values up to each: buckets first, then within them."""
    from pyspark.sql import Window

    sums = marked.groupBy(*groups, "_b").agg(F.sum("_c").alias("_s"))
    run = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4097 rows at most
    before = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(run), F.lit(0)).alias("_before"))
    same = marked["_b"] == before["_bb"]
    for i, g in enumerate(groups):
        same = same & marked[g].eqNullSafe(before[f"_g{i}"])
    inside = F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy("_v"))
    return marked.join(before, same).withColumn("_upto", F.col("_before") + inside)


def acpl_summary(losses: DataFrame, groups: list[str], value: str, prefix: str = "acpl") -> DataFrame:
    """(groups, metric, value): mean, median, 90th and 95th nearest rank of losses, one
    row each, for the groups and, where they are null, for all."""
    cuts = {f"{prefix}_median": 0.5, f"{prefix}_p90": 0.9, f"{prefix}_p95": 0.95}
    parts = [nearest_ranks(losses, groups, value, cuts)]
    none = losses.select(*[F.lit(None).cast(losses.schema[g].dataType).alias(g) for g in groups], value)
    parts.append(nearest_ranks(none, groups, value, cuts))
    both = parts[0].unionByName(parts[1]).withColumnRenamed("mean", prefix)
    return both.unpivot(groups, [prefix, *cuts], "metric", "value")


def wpd_summary(scores: DataFrame, groups: list[str], prompt: str) -> DataFrame:
    """(groups, metric, value) of scores(prompt, wpd, best_expectation, ..., hits): means
    of the numbers, rates of the hits, and the mean over prompts of the population's
    standard deviation of rewards; what no row has is left out."""
    have = set(scores.columns)
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in WPD_MEANS if c in have]
    rates = [F.avg(F.col(c).cast("int").cast("double")).alias(name) for c, name in WPD_RATES.items() if c in have]
    own = scores.groupBy(*groups).agg(*means, *rates)
    out = own.unpivot(groups, [c for c in own.columns if c not in groups], "metric", "value")
    if "reward" in have:
        spread = scores.filter("reward is not null").groupBy(*groups, prompt).agg(F.stddev_pop("reward").alias("_s")).groupBy(*groups).agg(F.avg("_s").alias("value"))
        out = out.unionByName(spread.select(*groups, F.lit("reward_std_per_prompt").alias("metric"), "value"))
    return out.filter("value is not null")


def task_stats(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(task, target, total, passed, failed, chess960_share) of rows(task, is_chess960,
    passed), with 0 as the target of a task that targets(task, target) lacks."""
    counts = rows.groupBy("task").agg(
        F.count("*").alias("total"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg(F.col("is_chess960").cast("int")), 4).alias("chess960_share"),
    )
    return counts.join(targets, "task", "left").select("task", F.coalesce("target", F.lit(0)).cast("long").alias("target"), "total", "passed", "failed", "chess960_share")


def chess960_mix(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(tier, target, actual, delta): each tier's share of Chess960 rows against
    ratios(tier, ratio); the tier is the number that a task's name begins with."""
    tier = F.split("task", r"\.")[0].cast("int")
    own = rows.groupBy(tier.alias("tier")).agg(F.avg(F.col("is_chess960").cast("int")).alias("_a"))
    ratio = F.coalesce("ratio", F.lit(0.0))
    return own.join(ratios, "tier", "left").select("tier", ratio.alias("target"), F.round("_a", 4).alias("actual"), F.round(F.col("_a") - ratio, 4).alias("delta"))


def readiness(counts: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, rows, needed, ready) of needs(source, needed): which sources have enough."""
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    return needs.join(counts, "source", "left").select("source", rows.alias("rows"), F.col("needed").cast("long").alias("needed"), (rows >= F.col("needed")).alias("ready"))


def find_metric(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, metric, value) of wanted(name, metric) from metrics(key, value): the value
    of the key that is called so, or of the first key in order that ends in _metric or
    .metric; null without one. Both tables are a report's, not the data's."""
    keyed = metrics.groupBy("key").agg(F.first("value").alias("value"))
    fits = (F.col("key") == F.col("metric")) | F.col("key").endswith(F.concat(F.lit("_"), F.col("metric"))) | F.col("key").endswith(F.concat(F.lit("."), F.col("metric")))
    order = F.struct((F.col("key") != F.col("metric")).alias("a"), F.col("key"))
    hit = wanted.join(F.broadcast(keyed), fits, "left").groupBy("name", "metric").agg(F.min_by("value", F.when(F.col("key").isNotNull(), order)).alias("value"))
    return hit


def gate_report(metrics: DataFrame, checks: DataFrame, breakdowns: DataFrame) -> DataFrame:
    """(name, metric, value, passed, reason) of checks(name, metric, at_least, at_most):
    a check without bounds asks for the metric alone. Besides, verifier answers must be
    broken down by all STEP_FIELDS in breakdowns(field, n)."""
    found = find_metric(metrics, checks.select("name", "metric")).join(checks, ["name", "metric"])
    fine = F.coalesce(F.col("value") >= F.col("at_least"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("at_most"), F.lit(True))
    passed = F.col("value").isNotNull() & fine
    reason = F.when(F.col("value").isNull(), "missing_metric").when(passed, "present").otherwise("threshold")
    numeric = found.select("name", "metric", "value", passed.alias("passed"), reason.alias("reason"))
    have = breakdowns.filter("n > 0").agg(F.collect_set("field").alias("have"))
    wanted = F.array(*[F.lit(f) for f in STEP_FIELDS])
    missing = F.array_except(wanted, F.col("have"))
    step = have.select(
        F.lit("step_verification_metadata_breakdowns").alias("name"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"),
        (F.size(missing) == 0).alias("passed"), F.when(F.size(missing) == 0, "present").otherwise(F.concat(F.lit("missing: "), F.array_join(missing, ", "))).alias("reason"),
    )
    return numeric.unionByName(step)


def ranked_failures(rows: DataFrame, groups: list[str], order: Column, most: int = 5) -> DataFrame:
    """The first failures of each group by a hash order, ``most`` of them at most."""
    return with_rank(rows, groups, order, "rank").filter(F.col("rank") <= most)
