"""Exact apportionment, fractions, upsampling and cyclic drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_order
from .ranking import with_rank


def largest_remainder(df: DataFrame, weight: str, total: Column | int, order: list, groups: list[str] = (), name: str = "n") -> DataFrame:
    """df, one row per class, with integer shares of total in proportion to weight:
    floors, and one more for the largest remainders (ties by order). Classes are
    few; with groups, each group's total is apportioned on its own."""
    total = F.lit(total) if isinstance(total, int) else total
    whole = Window.partitionBy(*groups)
    quota = total * F.col(weight) / F.nullif(F.sum(weight).over(whole), F.lit(0))
    marked = df.withColumn("_t", total.cast("long")).withColumn("_q", quota).withColumn("_f", F.floor("_q"))
    marked = marked.withColumn("_left", F.col("_t") - F.sum("_f").over(whole))
    by = Window.partitionBy(*groups).orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), *order)
    more = F.when(F.row_number().over(by) <= F.col("_left"), 1).otherwise(0)
    return marked.withColumn(name, (F.col("_f") + more).cast("long")).drop("_t", "_q", "_f", "_left")


def sampled_count(n: Column, fraction: Column | float) -> Column:
    """round-half-even(n * fraction), 1 at least and n at most."""
    fraction = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.greatest(F.lit(1), F.least(n, F.bround(n * fraction))).cast("long")


def fraction_sample(df: DataFrame, group: str, key: str, fraction: float, seed: int) -> DataFrame:
    """A fraction of each group's rows, the first by hash order."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_take", sampled_count(F.col("_n"), fraction))
    ranked = with_rank(df, [group], hash_order(seed, key), "_rank")
    return ranked.join(counts.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).filter("_rank <= _take").drop("_rank", "_n", "_take", "_g")


def upsample(df: DataFrame, factor: Column) -> DataFrame:
    """Each row factor times, with its copy number; a factor below 1 or null counts as 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(factor, F.lit(1)), F.lit(1)))))


def cyclic_draw(pool: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, epoch, pool columns): ``draws`` rows in a new hash order each time the
    pool runs out. Each row is copied once per epoch and keeps its place in it; the
    order of an epoch comes from its own hash. Counts the pool by a job while the plan
    is built."""
    n = pool.count()
    if not n or draws <= 0:
        return pool.select(F.lit(0).cast("long").alias("draw"), F.lit(0).alias("epoch"), "*").limit(0)
    last = (draws - 1) // n
    copies = pool.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<int>")))
    ranked = with_rank(copies, ["epoch"], hash_order(seed, "epoch", key), "_rank")
    return ranked.withColumn("draw", F.col("epoch") * F.lit(n).cast("long") + F.col("_rank") - 1).filter(F.col("draw") < draws).drop("_rank")


def plan_segments(schedule: DataFrame, total: int) -> DataFrame:
    """schedule(segment, name, fraction, tier, weight): rows per segment, then per
    tier of each segment, both exact, with the segment's first and last row."""
    segments = largest_remainder(schedule.select("segment", "name", "fraction").distinct(), "fraction", total, ["segment"], name="segment_rows")
    upto = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    segments = segments.withColumn("last_row", F.sum("segment_rows").over(upto)).withColumn("first_row", F.col("last_row") - F.col("segment_rows"))
    tiers = schedule.select("segment", "tier", "weight").join(segments, "segment")
    return largest_remainder(tiers, "weight", F.col("segment_rows"), ["tier"], ["segment"], "tier_rows")


def checked_fractions(fractions: dict[str, float]) -> dict[str, float]:
    """The fractions; raises unless each is above 0 and all are 1 at most together."""
    if any(not 0 < f <= 1 for f in fractions.values()) or sum(fractions.values()) > 1 + 1e-9:
        raise ValueError(f"fractions of tasks must lie in (0, 1] and sum up to 1 at most: {fractions}")
    return dict(fractions)


def checked_schedule(segments: list[tuple[str, float, dict[int, float]]]) -> list[tuple[int, str, float, int, float]]:
    """Rows (segment, name, fraction, tier, weight) of segments (name, fraction, weights
    by tier); raises on repeated names, fractions that don't sum up to 1, weights below
    0, or a segment without weight."""
    names = [n for n, _, _ in segments]
    if not segments or len(set(names)) < len(names):
        raise ValueError("a schedule needs segments of different names")
    if abs(sum(f for _, f, _ in segments) - 1) > 1e-6 or any(f <= 0 for _, f, _ in segments):
        raise ValueError("fractions of the run must be above 0 and sum up to 1")
    if any(min(w.values(), default=-1) < 0 or not sum(w.values()) for _, _, w in segments):
        raise ValueError("a segment's weights must be 0 or more, and one above 0")
    return [(i, n, f, t, x) for i, (n, f, w) in enumerate(segments) for t, x in sorted(w.items()) if x]


def replay_share(weights: dict[int, float]) -> float:
    """The share of tiers 1 and 2."""
    return sum(w for t, w in weights.items() if t in (1, 2)) / sum(weights.values())
