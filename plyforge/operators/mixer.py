"""Training mixes: evaluation keys that stay held out, phases, schedules.

Rows are rows(id, tier, task, key, ...): ``id`` tells rows of a tier apart and ``key``
is the position's variant key. Every draw follows hashes of a seed, so a mix is the
same in each run. Tasks, tiers and segments are few; rows may be any number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import hash_order
from ..store import stash
from .mix import checked_fractions, upsample
from .ranking import with_rank
from .splits import greedy_keys

# Fields that a training row must have, in the order they are asked for;
# what a move-only row says instead of its thoughts; the label of all other tasks.
REQUIRED = ("messages", "task", "tier", "fen")
MOVE_ONLY_THOUGHT = "Choose the final legal move."
TARGETS = ("target_move", "best_move", "solution_first_move")
OTHER = "__other__"
# Fixed values end.


# --- rows of training files -------------------------------------------------------


def check_required(rows: DataFrame) -> DataFrame:
    """The rows; those without a required field raise when they are read."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])), ", ")
    fine = F.when(missing == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a training row is missing required keys: "), missing)).cast("boolean"))
    return rows.filter(fine)


def move_only_target(metadata: Column, messages: Column) -> Column:
    """The move that a row is about: of its metadata (a map), else of the first tag in
    an assistant's message; null if there is none."""
    named = [F.nullif(X.normalize(metadata[k]), F.lit("")) for k in TARGETS]
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].rlike(f"(?i){X.MOVE_TAG}"))
    return F.coalesce(*named, F.lower(X.found(F.get(said, F.lit(0))["content"], f"(?i){X.MOVE_TAG}")))


def transform_rows(rows: DataFrame, include: list[str] | None = None, exclude: list[str] = (), move_only: list[str] = ()) -> DataFrame:
    """The rows of the included tasks but not the excluded ones; rows of move_only tasks
    answer with their move alone and raise when they have none or no answer."""
    kept = rows
    if include is not None:
        kept = kept.filter(F.col("task").isin(*include) if include else F.lit(False))
    if exclude:
        kept = kept.filter(~F.col("task").isin(*exclude))
    if not move_only:
        return kept
    target = move_only_target(F.col("metadata"), F.col("messages"))
    answers = F.exists("messages", lambda m: m["role"] == "assistant")
    known = F.when(target.isNotNull() & answers, target).otherwise(F.raise_error(F.concat(F.lit("no move-only target for task "), F.col("task"))))
    said = F.concat(F.lit(f"<think>{MOVE_ONLY_THOUGHT}</think>\n<move>"), known, F.lit("</move>"))
    new = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", said).otherwise(m["content"]).alias("content")))
    return kept.withColumn("messages", F.when(F.col("task").isin(*move_only), new).otherwise(F.col("messages")))


# --- evaluation keys --------------------------------------------------------------


def load_or_extend_eval_keys(spark: SparkSession, state: str, rows: DataFrame, share: float, seed: int) -> DataFrame:
    """(key) of the evaluation side: what ``state`` (a folder) keeps, and keys chosen for
    tiers that it hasn't seen; keys that are there count towards their share. State is
    written as whole versions, so a build that dies leaves the one before it."""
    path, fs = _versions(spark, state)
    done = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.isDirectory() and fs.exists(_path(spark, f"{state}/{s.getPath().getName()}/tiers/_SUCCESS"))) if fs.exists(path) else []
    if done:
        last = f"{state}/v{done[-1]}"
        keys, seen = spark.read.schema("key string").parquet(f"{last}/keys"), {r["tier"] for r in spark.read.schema("tier int").parquet(f"{last}/tiers").collect()}
    else:
        keys, seen = spark.createDataFrame([], "key string"), set()
    tiers = {r["tier"] for r in rows.select(F.col("tier").cast("int").alias("tier")).distinct().collect()}
    if not tiers - seen:
        return keys
    counts = rows.filter(~F.col("tier").isin(*seen) if seen else F.lit(True)).groupBy("key", "task").agg(F.count("*").alias("n"))
    added = greedy_keys(counts, "key", "task", "n", share, seed, keys).select("key")
    target = f"{state}/v{done[-1] + 1 if done else 1}"
    keys.union(added).distinct().write.mode("overwrite").parquet(f"{target}/keys")
    # the tiers come last: a version without them doesn't count
    spark.createDataFrame([(int(t),) for t in sorted(seen | tiers)], "tier int").coalesce(1).write.mode("overwrite").parquet(f"{target}/tiers")
    return spark.read.schema("key string").parquet(f"{target}/keys")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def with_side(rows: DataFrame, eval_keys: DataFrame) -> DataFrame:
    """rows with ``side``: eval where the key is held out, else train."""
    held = eval_keys.select(F.col("key").alias("_held")).distinct()
    return rows.join(held, rows["key"] == held["_held"], "left").withColumn("side", F.when(F.col("_held").isNotNull(), "eval").otherwise("train")).drop("_held")


# --- counts -----------------------------------------------------------------------


def apportion(total: int, weights: list[float]) -> list[int]:
    """Whole numbers in proportion to the weights that sum up to total: floors, and one
    more for the largest remainders, the first of equal ones."""
    if total < 0 or sum(weights) <= 0:
        raise ValueError(f"can't share {total} rows by the weights {weights}")
    quotas = [total * w / sum(weights) for w in weights]
    out = [math.floor(q) for q in quotas]
    more = sorted(range(len(weights)), key=lambda i: (out[i] - quotas[i], i))[: total - sum(out)]
    return [n + (i in more) for i, n in enumerate(out)]


def sampled(n: int, fraction: float) -> int:
    """A rounded share of n rows, one at least; none of none."""
    return 0 if n <= 0 or fraction <= 0 else n if fraction >= 1 else max(1, min(n, round(n * fraction)))


def factors(by_task: dict[str, int] | None) -> dict[str, int]:
    """Those factors that add copies."""
    return {t: int(f) for t, f in (by_task or {}).items() if t and int(f) > 1}


def _factor(by_task: dict[str, int]) -> Column:
    out = F.lit(1)
    for task, n in by_task.items():
        out = F.when(F.col("task") == task, n).otherwise(out)
    return out


def _missing(fractions: dict[str, float], observed: set[str], what: str) -> None:
    if lost := sorted(set(fractions) - observed):
        raise ValueError(f"{what}: task fraction target(s) not found after data transforms: {', '.join(lost)}")


def _labels(tasks: dict[str, int], fractions: dict[str, float], tier: int) -> dict[str, float] | None:
    """The shares of a tier's targeted tasks and of all others; None without targets."""
    wanted = {t: fractions[t] for t in sorted(fractions) if tasks.get(t)}
    if not wanted:
        return None
    rest = 1.0 - sum(wanted.values())
    if rest > 1e-9:
        if not any(n for t, n in tasks.items() if t not in wanted):
            raise ValueError(f"tier {tier}: targets {', '.join(wanted)} leave a remainder, but no other rows are there")
        wanted[OTHER] = rest
    return wanted


def _draw(pools: DataFrame, sizes: dict[tuple[int, str], int], needs: dict[tuple[int, str], int], seed: int) -> DataFrame:
    """pools(tier, label, id, copy, ...) with ``draw``, from 0 up to what each pool
    (tier, label) needs: in a new hash order each time the pool runs out."""
    spark = pools.sparkSession
    table = spark.createDataFrame(
        [(t, label, n, -(-n // sizes[t, label])) for (t, label), n in needs.items() if n > 0 and sizes.get((t, label))], "tier int, label string, _need long, _epochs long"
    )
    copies = pools.join(F.broadcast(table), ["tier", "label"]).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)))
    ranked = with_rank(copies, ["tier", "label", "_epoch"], hash_order(seed, "tier", "label", "_epoch", "id", "copy"), "_rank")
    size = F.lit(None).cast("long")
    for (t, label), n in sizes.items():
        size = F.when((F.col("tier") == t) & (F.col("label") == label), n).otherwise(size)
    return ranked.withColumn("draw", F.col("_epoch") * size + F.col("_rank") - 1).filter(F.col("draw") < F.col("_need")).drop("_need", "_epochs", "_epoch", "_rank")


def _label(fractions: dict[str, dict | None]) -> Column:
    out = F.lit(OTHER)
    for tier, labels in fractions.items():
        own = [t for t in labels or {} if t != OTHER]
        if own:
            out = F.when((F.col("tier") == tier) & F.col("task").isin(*own), F.col("task")).otherwise(out)
    return out


def _counts(rows: DataFrame) -> dict[int, dict[str, int]]:
    out: dict[int, dict[str, int]] = {}
    for r in rows.groupBy("tier", "task").count().collect():  # tiers and tasks are few
        out.setdefault(int(r["tier"]), {})[str(r["task"])] = r["count"]
    return out


# --- phases and schedules ---------------------------------------------------------


@dataclass(frozen=True)
class TierMix:
    tier: int
    fraction: float = 1.0
    upsample: int = 1


def _sampled_side(rows: DataFrame, side: str, mix: list[TierMix], counts: dict[int, dict[str, int]], seed: int) -> DataFrame:
    """The first rows of each tier by hash order, as many as its fraction of the side."""
    own = rows.filter(F.col("side") == side)
    takes = {m.tier: sampled(sum(counts.get(m.tier, {}).values()), m.fraction) for m in mix}
    if all(m.fraction >= 1 for m in mix):
        return own
    limit = F.lit(0)
    for tier, n in takes.items():
        limit = F.when(F.col("tier") == tier, n).otherwise(limit)
    return with_rank(own, ["tier"], hash_order(seed, F.lit(side), "tier", "id"), "_rank").filter(F.col("_rank") <= limit).drop("_rank")


def build_phase(
    rows: DataFrame, mix: list[TierMix], eval_keys: DataFrame, seed: int = 42, task_upsample: dict[str, int] | None = None, task_fractions: dict[str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) of one phase from rows(id, tier, task, key, ...): each tier's two
    sides sampled, then on the train side tasks upsampled, redrawn to their target
    fractions, and the tier upsampled. train has ``position``, a hash order over all.
    Raises for targets that no row has and for a phase without training rows. Counts
    run jobs while the plan is built."""
    fractions, more = checked_fractions(task_fractions or {}), factors(task_upsample)
    tiers = [m.tier for m in mix]
    sided = with_side(rows.filter(F.col("tier").isin(*tiers)), eval_keys).withColumn("tier", F.col("tier").cast("int"))
    sided = stash(sided, "sided")
    held = _sampled_side(sided, "eval", mix, _counts(sided.filter("side = 'eval'")), seed).drop("side")
    own = _sampled_side(sided, "train", mix, _counts(sided.filter("side = 'train'")), seed).drop("side")
    train = stash(upsample(own, _factor(more)), "train")
    counts = _counts(train)
    _missing(fractions, {t for c in counts.values() for t in c}, "phase")
    if not counts:
        raise ValueError("the phase has no training examples after data transforms")
    labels = {tier: _labels(c, fractions, tier) for tier, c in counts.items()}
    if any(labels.values()):
        sizes, needs = _sizes_and_needs(counts, labels, {tier: sum(c.values()) for tier, c in counts.items()})
        pools = train.withColumn("label", _label(labels))
        drawn = _draw(pools, sizes, needs, seed)
    else:
        drawn = train.withColumn("label", F.lit(OTHER)).withColumn("draw", F.col("copy").cast("long"))
    times = F.lit(1)
    for m in mix:
        times = F.when(F.col("tier") == m.tier, max(1, m.upsample)).otherwise(times)
    copies = drawn.withColumn("_times", F.explode(F.sequence(F.lit(1), times)))
    order = hash_order(seed, "tier", "label", "id", "copy", "draw", "_times")
    return with_rank(copies, [], order, "position").drop("_times", "label", "draw", "copy"), held


def _sizes_and_needs(counts: dict, labels: dict, totals: dict[int, int]):
    sizes, needs = {}, {}
    for tier, own in labels.items():
        shares = own or {OTHER: 1.0}
        for label, n in zip(shares, apportion(totals[tier], list(shares.values())), strict=True):
            sizes[tier, label] = counts[tier][label] if label != OTHER else sum(c for t, c in counts[tier].items() if not own or t not in own)
            needs[tier, label] = n
    return sizes, needs


@dataclass(frozen=True)
class Segment:
    name: str
    fraction: float
    weights: tuple[tuple[int, float], ...]


@dataclass(frozen=True)
class Plan:
    index: int
    name: str
    start: int
    end: int
    tier_rows: tuple[tuple[int, int], ...]


def plan(segments: list[Segment], total: int) -> list[Plan]:
    """Rows of each segment and, within it, of each tier with a weight; both exact."""
    if total <= 0 or not segments:
        raise ValueError("a schedule needs segments and rows")
    out, start = [], 0
    for i, (s, n) in enumerate(zip(segments, apportion(total, [s.fraction for s in segments]), strict=True)):
        own = [(t, w) for t, w in s.weights if w > 0]
        out.append(Plan(i, s.name, start, start + n, tuple(zip((t for t, _ in own), apportion(n, [w for _, w in own]), strict=True))))
        start += n
    return out


def boundary_steps(plans: list[Plan], batch: int = 32) -> list[int]:
    return [-(-p.end // batch) for p in plans]


def build_schedule(
    rows: DataFrame, segments: list[Segment], eval_keys: DataFrame, seed: int = 42, task_upsample: dict[str, int] | None = None,
    task_fractions: dict[str, float] | None = None, total: int | None = None,
) -> tuple[DataFrame, DataFrame, list[Plan]]:
    """(train, eval, plans): one training set in the order of the segments, with
    ``position`` (from 0) and ``segment``. A tier's rows are drawn through all segments
    and repeat only when they have all been drawn; within a segment a hash order mixes
    the tiers. Raises for targets that no row has and for tiers that are needed and
    empty. Counts run jobs while the plan is built."""
    fractions, more = checked_fractions(task_fractions or {}), factors(task_upsample)
    tiers = sorted({t for s in segments for t, w in s.weights if w > 0})
    sided = stash(with_side(rows.filter(F.col("tier").isin(*tiers)), eval_keys).withColumn("tier", F.col("tier").cast("int")), "sided")
    held = sided.filter("side = 'eval'").drop("side")
    train = stash(upsample(sided.filter("side = 'train'").drop("side"), _factor(more)), "train")
    counts = _counts(train)
    _missing(fractions, {t for c in counts.values() for t in c}, "schedule")
    plans = plan(segments, total if total is not None else sum(sum(c.values()) for c in counts.values()))
    labels = {t: _labels(counts.get(t, {}), fractions, t) for t in tiers}
    cells, needs, sizes = [], {}, {}
    for p in plans:
        for tier, n in p.tier_rows:
            if n and not counts.get(tier):
                raise ValueError(f"the schedule needs {n} train rows from tier {tier}, but its train pool is empty after the eval split")
            if not n:
                continue
            own_sizes, own_needs = _sizes_and_needs(counts, {tier: labels[tier]}, {tier: n})
            sizes.update(own_sizes)
            for key, k in own_needs.items():
                needs[key] = needs.get(key, 0) + k
                cells.append((*key, needs[key], p.index))
    drawn = _draw(train.withColumn("label", _label(labels)), sizes, needs, seed)
    # a pool's draws belong to the first segment whose share they don't pass
    bounds = train.sparkSession.createDataFrame(cells, "tier int, label string, upto long, segment int").groupBy("tier", "label").agg(F.array_sort(F.collect_list(F.struct("upto", "segment"))).alias("_bounds"))
    placed = drawn.join(F.broadcast(bounds), ["tier", "label"])
    placed = placed.withColumn("segment", F.get(F.filter("_bounds", lambda b: b["upto"] > F.col("draw")), F.lit(0))["segment"])
    ranked = with_rank(placed, ["segment"], hash_order(seed, "segment", "tier", "label", "draw"), "_rank")
    start = F.lit(None).cast("long")
    for p in plans:
        start = F.when(F.col("segment") == p.index, p.start).otherwise(start)
    train_rows = ranked.withColumn("position", start + F.col("_rank") - 1).drop("_rank", "_bounds", "label", "draw", "copy")
    return train_rows, held, plans


def summarize_phase(rows: DataFrame, mix: list[TierMix], task_upsample: dict[str, int] | None = None, task_fractions: dict[str, float] | None = None) -> dict[str, int]:
    """Expected rows of each tier of a phase, before any split."""
    counts, more = _counts(rows), factors(task_upsample)
    _missing(checked_fractions(task_fractions or {}), {t for m in mix for t in counts.get(m.tier, {})}, "phase summary")
    out = {}
    for m in mix:
        own = counts.get(m.tier, {})
        out[f"tier_{m.tier}"] = (sampled(sum(own.values()), m.fraction) + extra_rows(own, more, m.fraction)) * m.upsample
    return {**out, "total": sum(out.values())}


def extra_rows(tasks: dict[str, int], more: dict[str, int], fraction: float) -> int:
    """Rows that upsampling adds to a share of a tier, rounded down for each task."""
    return sum((int(tasks.get(t, 0) * fraction) if fraction < 1 else tasks.get(t, 0)) * (f - 1) for t, f in more.items())


def summarize_schedule(rows: DataFrame, segments: list[Segment], task_upsample: dict[str, int] | None = None, task_fractions: dict[str, float] | None = None, total: int | None = None) -> dict:
    """What a schedule will draw: pools by tier, rows by segment and tier, boundaries."""
    counts, more = _counts(rows), factors(task_upsample)
    tiers = sorted({t for s in segments for t, w in s.weights if w > 0})
    _missing(checked_fractions(task_fractions or {}), {x for t in tiers for x in counts.get(t, {})}, "schedule summary")
    pools = {t: sum(counts.get(t, {}).values()) + extra_rows(counts.get(t, {}), more, 1.0) for t in tiers}
    plans = plan(segments, total if total is not None else sum(pools.values()))
    return {
        "total_examples": plans[-1].end, "tier_pool_sizes": {f"tier_{t}": n for t, n in pools.items()}, "boundary_steps": boundary_steps(plans),
        "segments": [{"index": p.index, "name": p.name, "start_row": p.start, "end_row": p.end, "rows": p.end - p.start, "tier_rows": {f"tier_{t}": n for t, n in p.tier_rows}} for p in plans],
    }
