"""Held-out splits of positions: sizes, sources, exclusion in order, states of play."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chess_udfs as U
from ..functions.keys import hash_order
from ..store import stash
from .joins import without
from .ranking import hash_sample, with_rank

# Shares of states that a rules split should have; sources that never
# enter a split; tasks that rated positions are dealt to.
STATE_SHARES = {"check": 0.10, "checkmate": 0.05, "stalemate": 0.05}
EXCLUDED_SOURCES = ("self_play",)
RATED_TASKS = ("candidate_ratings", "best_line_trace", "step_verification")
# Fixed values end.


def effective_sizes(sizes: dict[str, int], cap: int | None = None) -> dict[str, int]:
    return dict(sizes) if cap is None else {name: min(n, cap) for name, n in sizes.items()}


def reserve(sizes: dict[str, int], shared: list[tuple[tuple[str, ...], int]], keep: int | None) -> dict[str, int]:
    """The sizes with ``keep`` rows of each shared source left for training: splits that
    draw from one source take from what is over in their order."""
    out = dict(sizes)
    if keep is None:
        return out
    for names, rows in shared:
        left = max(0, rows - keep)
        for name in names:
            if name in out:
                out[name] = min(out[name], left)
                left -= out[name]
    return out


def eligible(rows: DataFrame) -> DataFrame:
    """Rows that may enter a split: not those of a source that follows a model."""
    return rows.filter(~F.coalesce(F.col("source").isin(*EXCLUDED_SOURCES), F.lit(False))) if "source" in rows.columns else rows


def state(fen: Column, chess960: Column | bool = False) -> Column:
    """checkmate, stalemate, check or quiet; null for no position."""
    found = U.check_state(fen, chess960=chess960)
    return F.when(found == "none", "quiet").otherwise(found)


def generate_splits(sources: dict[str, DataFrame], sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """(split, pos_key, fen) of the splits in their order from sources of (pos_key, fen):
    of each, rows of new positions in hash order up to its size; a position is in one
    split at most. The rules split is stratified. Runs jobs for each split while the
    plan is built."""
    some = next(iter(sources.values()))
    out = some.select(F.lit("").alias("split"), "pos_key", "fen").limit(0)
    for name, n in sizes.items():
        if name not in sources:
            continue
        fresh = sources[name].filter("fen is not null and fen <> ''").groupBy("pos_key").agg(F.min("fen").alias("fen"))
        fresh = without(fresh, out, "pos_key")
        own = hash_sample(fresh, hash_order(seed, F.lit(name), "pos_key"), n)
        if name == "rules":
            own = stratified_rules(stash(own, "rules"), fresh, seed)
        out = stash(out.unionByName(own.select(F.lit(name).alias("split"), "pos_key", "fen")), "splits")
    return out


def stratified_rules(sampled: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """sampled(pos_key, fen) with quiet positions replaced by checks, mates and
    stalemates of the pool, as many as STATE_SHARES ask for and the pool and the quiet
    positions allow; both are taken in hash order."""
    marked = stash(sampled.withColumn("state", state(F.col("fen"))), "states")
    counts = {r["state"]: r["count"] for r in marked.groupBy("state").count().collect()}  # four states
    total = sum(counts.values())
    missing = {s: max(0, math.ceil(share * total) - counts.get(s, 0)) for s, share in STATE_SHARES.items()}
    if not total or not any(missing.values()):
        return sampled.select("pos_key", "fen")
    spare = without(pool.select("pos_key", "fen"), sampled, "pos_key").withColumn("state", state(F.col("fen"))).filter(F.col("state").isin(*missing))
    limit = F.lit(0)
    for s, n in missing.items():
        limit = F.when(F.col("state") == s, n).otherwise(limit)
    new = with_rank(spare, ["state"], hash_order(seed, F.lit("rules"), "pos_key"), "_r").filter(F.col("_r") <= limit).drop("_r")
    new = hash_sample(new, hash_order(seed, F.lit("kept"), "pos_key"), counts.get("quiet", 0))
    new = stash(new, "new")
    quiet = marked.filter("state = 'quiet'")
    gone = hash_sample(quiet, hash_order(seed, F.lit("gone"), "pos_key"), new.count())
    kept = without(marked, gone, "pos_key")
    return kept.select("pos_key", "fen").unionByName(new.select("pos_key", "fen"))


def planning_sources(rated: DataFrame, ordinal: str) -> DataFrame:
    """Rows with five rated moves at least, of an array ``candidate_ratings``, dealt in
    turn to the tasks that rated positions serve."""
    own = rated.filter(F.coalesce(F.size("candidate_ratings"), F.lit(0)) >= 5)
    turn = with_rank(own, [], hash_order("turn", ordinal), "_r")
    task = F.element_at(F.array(*[F.lit(t) for t in RATED_TASKS]), (F.pmod(F.col("_r") - 1, F.lit(len(RATED_TASKS))) + 1).cast("int"))
    return turn.withColumn("task_type", task).drop("_r")


def opening_sources(openings: DataFrame, held_eco: DataFrame, book_moves: DataFrame) -> DataFrame:
    """Openings of the held-out codes with the moves that books know after them:
    ``book_moves`` is null where they know none."""
    own = openings.join(held_eco.select("eco").distinct(), "eco", "left_semi")
    listed = book_moves.groupBy("fen").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "uci", "weight"))).alias("_m"))
    return own.join(listed, "fen", "left").withColumn("book_moves", F.transform("_m", lambda m: F.struct(m["uci"].alias("uci"), m["weight"].alias("weight")))).drop("_m")


def build_sources(pool: DataFrame, puzzles: DataFrame, evals: DataFrame, openings: DataFrame, endgames: DataFrame, mates: DataFrame, planning: DataFrame, min_depth: int) -> dict[str, DataFrame]:
    """The source of each split, as frames of (pos_key, fen): pool(pos_key, fen,
    is_chess960, source) serves the standard splits and Chess960's own; evaluations
    count from ``min_depth`` on."""
    own, keep = eligible(pool), ["pos_key", "fen"]
    standard, other = own.filter("not coalesce(is_chess960, false)").select(*keep), own.filter("is_chess960").select(*keep)
    return {
        "perception": standard, "rules": standard, "tactics": puzzles.select(*keep), "evaluation": evals.filter(F.coalesce("depth", F.lit(0)) >= min_depth).select(*keep),
        "openings": openings.select(*keep), "endgames": endgames.select(*keep), "planning": planning.select(*keep), "chess960": other, "mate": mates.select(*keep),
    }
