"""Failures to refresh rows: judgments with their rollouts and prompts, a reason for
each that is skipped, and a running cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stash
from .joins import first_reason
from .ranking import with_rank

# Buckets of judgments, tasks of refresh rows, tasks they come from.
PARSE_FAILURE, ILLEGAL_MOVE, MISSING_FEN, INVALID_FEN, LEGAL_UNSCORED = "parse_failure", "illegal_move", "missing_fen", "invalid_fen", "legal_unscored"
FORMAT_REPAIR, MOVE_CORRECTION = "7.4_autodata_format_repair", "7.5_autodata_move_correction"
MOVE_TASKS = ("best_move", "puzzle_solve", "endgame_best_move", "tactical_patterns")
LEAST_REGRET = 100.0
# Fixed values end.


def refresh_task(failure: Column, legal: Column, regret: Column, least: float = LEAST_REGRET) -> Column:
    """What a judgment is refreshed into: the format, the move (illegal, or legal and
    worse by ``least`` centipawns), or nothing (null)."""
    return F.when(failure == PARSE_FAILURE, FORMAT_REPAIR).when((failure == ILLEGAL_MOVE) | (legal & (regret >= least)), MOVE_CORRECTION)


def skip_reason(failure: Column, legal: Column, regret: Column, least: float = LEAST_REGRET) -> Column:
    """Why a judgment isn't refreshed."""
    return (
        F.when(failure.isin(MISSING_FEN, INVALID_FEN, LEGAL_UNSCORED), failure)
        .when(legal & regret.isNull(), "unscored_legal").when(legal & (regret < least), "low_regret").otherwise("unsupported_judgment")
    )


def refresh(
    judgments: DataFrame, rollouts: DataFrame, prompts: DataFrame, rules: list[tuple[Column, str]], ordinal: str, identity: list[str], bucket: Column, cap: int
) -> DataFrame:
    """judgments left-joined to rollouts (rollout_id) and prompts (prompt_id), with
    ``reason``: the first rule that holds, then ``duplicate`` for a later row of the
    same identity, then ``max_examples`` for all that come after ``cap`` accepted
    rows by ordinal; null for the rows to keep. ``bucket`` must rise with ordinal."""
    # read once for each step below, the moves' legality included: written, not joined again
    joined = stash(judgments.join(rollouts, "rollout_id", "left").join(prompts, "prompt_id", "left").withColumn("reason", first_reason(rules)), "refresh")
    open_ = joined.filter("reason is null")
    heads = open_.groupBy(*identity).agg(F.min(ordinal).alias("_first"))
    heads = heads.select(*[F.col(c).alias(f"_i{i}") for i, c in enumerate(identity)], "_first")
    same = F.lit(True)
    for i, c in enumerate(identity):
        same = same & open_[c].eqNullSafe(heads[f"_i{i}"])
    marked = open_.join(heads, same).withColumn("reason", F.when(F.col(ordinal) > F.col("_first"), "duplicate"))
    marked = marked.drop("_first", *[f"_i{i}" for i in range(len(identity))])
    ranked = with_rank(marked.filter("reason is null"), [], F.col(ordinal), "_place", bucket)
    last = ranked.filter(F.col("_place") == cap).select(F.col(ordinal).alias("_last"))
    # once the cap is reached every later judgment counts under it, whatever else holds
    everything = joined.filter("reason is not null").unionByName(marked)
    bound = last.agg(F.max("_last")).scalar()
    return everything.withColumn("reason", F.when(F.col(ordinal) > bound, "max_examples").otherwise(F.col("reason")))
