"""Predictions against frozen examples: scores, diagnostics, losses from engine columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import chess_udfs as U
from ..functions import metrics as M
from ..functions import protocol as P
from ..functions import text as X

# Tasks that are scored by one move, tasks with a trace, the split that
# pays for an engine by itself.
MOVE_TASKS = ("best_move", "puzzle_solve", "endgame_best_move")
TRACE_TASKS = ("best_move", "puzzle_solve", "best_line_trace")
ENGINE_SPLIT = "planning"
# Fixed values end.


def is_960(metadata: Column) -> Column:
    return F.coalesce(F.lower(metadata["is_chess960"]) == "true", F.lit(False)) | metadata["chess960_id"].isNotNull()


def score(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """examples with each of their predictions(example_id, sample_index, prediction,
    raw_prediction), ``primary`` and what else their task is measured by; an example
    without a prediction is scored as an empty one. Which metric counts follows from
    task and metric_type; protocol metrics read the raw text."""
    joined = examples.join(predictions, "example_id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    joined = joined.withColumn("_v", is_960(F.col("metadata"))).withColumn("prediction", F.coalesce("prediction", F.lit(""))).withColumn("raw_prediction", F.coalesce("raw_prediction", "prediction"))
    task, gold, raw, v = F.col("task_type"), F.coalesce("gold_answer", F.lit("")), F.col("raw_prediction"), F.col("_v")
    metric = M.metric_of(task, F.col("metric_type"))
    plain = X.normalize_prediction(raw)
    meta = F.col("metadata")
    fen_task, choice_task, moves = metric == "fen_exact_match", metric == "move_choice", task.isin(*TRACE_TASKS)
    # positions are read only where a metric asks for them
    some = lambda c, when: F.when(when, c)
    fen_score, first4 = P.fen_exact(some(plain, fen_task), some(gold, fen_task), v), P.fen_first4(some(plain, fen_task), some(gold, fen_task), v)
    choice = P.choice_match(some(plain, choice_task), gold, meta["move_a"], meta["move_b"])
    primary = F.when(fen_task, fen_score).when(choice_task, choice).otherwise(M.primary_score(metric, raw, gold))
    own = [
        primary.alias("primary"), F.when(fen_task, first4).alias("fen_first4"), F.when(metric == "material_count", M.material_piece_accuracy(plain, gold)).alias("material_piece_accuracy"),
        F.when(task == "hanging_pieces", M.hanging_f1(plain, gold)).when(metric == "piece_legal_filter", M.legal_filter_f1(plain, gold)).alias("set_f1"),
        F.when(metric == "legal_filter_trace", M.filter_trace_jaccard(plain, gold)).alias("final_jaccard"),
        F.when(metric == "legality_check", M.reason_accuracy(plain, gold, meta["legality_reason_label"])).alias("legality_reason_accuracy"),
        F.when(moves, M.format_compliance(raw)).alias("format_compliance"), F.when(moves, P.legal_move_rate(some(raw, moves), F.col("fen"), v)).alias("legal_move"),
    ]
    return joined.select(*examples.columns, "sample_index", "prediction", "raw_prediction", *own)


def secondary(scored: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, value): means of all scores, rows without one left out."""
    names = ["primary", "fen_first4", "material_piece_accuracy", "set_f1", "final_jaccard", "legality_reason_accuracy", "format_compliance", "legal_move"]
    means = scored.groupBy(*groups).agg(*[F.avg(n).alias(n) for n in names])
    return means.unpivot(groups, names, "metric", "value").filter("value is not null")


def diagnostics(scored: DataFrame) -> DataFrame:
    """scored with struct columns fen_diagnostics, uci_set and legality: what a wrong
    answer got wrong; null for tasks of another kind."""
    v, gold, plain = is_960(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), F.coalesce("gold_answer", F.lit("")), X.normalize_prediction(F.col("raw_prediction"))
    fens, moves = F.col("metric_type") == "fen_exact_match", F.col("metric_type") == "uci_set_jaccard"
    a, b = P.canonical_fen(F.when(fens, F.col("raw_prediction")), chess960=v), P.canonical_fen(F.when(fens, gold), chess960=v)
    marked = scored.withColumn("_a", a).withColumn("_b", b).withColumn("_legal", U.legal_moves(F.when(F.col("task_type").isin("legal_moves", "legal_moves_960"), F.col("fen")), chess960=v))
    a, b, four = F.col("_a"), F.col("_b"), lambda x: F.substring_index(x, " ", 4)
    p, g = X.uci_set(plain), X.uci_set(gold)
    hit = F.size(F.array_intersect(p, g))
    share = lambda n: F.when(n == 0, 0.0).otherwise(hit / F.nullif(n, F.lit(0)))
    said, right = M.legality_yes_no(plain), M.legality_yes_no(gold)
    why, because = M.reason_label(F.col("raw_prediction")), F.coalesce(F.col("metadata")["legality_reason_label"], M.reason_label(gold))
    true = lambda c: F.coalesce(c, F.lit(False))
    out = marked.withColumn("fen_diagnostics", F.when(fens, F.struct(
        a.alias("prediction_fen"), b.alias("gold_fen"), true(four(a) == four(b)).alias("first4_match"), true(a == b).alias("full_match"),
    ))).withColumn("uci_set", F.when(moves, F.struct(
        F.size(p).alias("prediction_count"), F.size(g).alias("gold_count"), hit.alias("true_positive_count"), (F.size(p) - hit).alias("extra_count"), (F.size(g) - hit).alias("missing_count"),
        share(F.size(p)).alias("precision"), share(F.size(g)).alias("recall"), F.when(F.col("_legal").isNotNull(), F.size(F.array_except(p, F.col("_legal")))).alias("illegal_extra_count"),
    ))).withColumn("legality", F.when(F.col("task_type") == "legality_check", F.struct(
        said.alias("prediction_is_legal"), right.alias("gold_is_legal"), true(said == right).alias("binary_match"), why.alias("prediction_reason_label"), because.alias("gold_reason_label"), true(why == because).alias("reason_match"),
    )))
    return out.drop("_a", "_b", "_legal")


def losses(examples: DataFrame, predictions: DataFrame, evals: DataFrame) -> DataFrame:
    """(example_id, split, task_type, loss) of examples of MOVE_TASKS whose metadata has
    white's centipawns: what the predicted move loses against them by evals(fen, move,
    cp) from the mover's side; all of it for no move, an illegal one or one without an
    evaluation."""
    own = examples.filter(F.col("task_type").isin(*MOVE_TASKS)).withColumn("_cp", F.col("metadata")["cp"].try_cast("double")).filter("_cp is not null")
    first = predictions.groupBy("example_id").agg(F.min_by("prediction", "sample_index").alias("prediction"))
    played = own.join(first, "example_id", "left").withColumn("move", X.extract_move(F.coalesce("prediction", F.lit(""))))
    known = evals.select(F.col("fen").alias("_f"), F.col("move").alias("_m"), F.col("cp").alias("_own"))
    joined = played.join(known, (played["fen"] == known["_f"]) & (played["move"] == known["_m"]), "left")
    return joined.select("example_id", "split", "task_type", M.centipawn_loss(B.side_to_move_cp(F.col("fen"), F.col("_cp")), F.col("_own")).alias("loss"))


def compare(examples: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """examples with both runs' primary scores, 0 where a run has no prediction."""
    one = lambda p, name: score(examples, p.filter(F.coalesce("sample_index", F.lit(0)) == 0)).select("example_id", F.col("primary").alias(name))
    return examples.select("example_id", "split", "task_type").join(one(baseline, "baseline"), "example_id", "left").join(one(candidate, "candidate"), "example_id", "left").fillna(0.0, ["baseline", "candidate"])


def needs_refresh(score_keys: Column, task_type: Column, wanted: dict[str, tuple[str, ...]]) -> Column:
    """Whether a stored score (its keys; null: none) lacks what its task is measured by
    now."""
    out = score_keys.isNull()
    for task, names in wanted.items():
        out = out | ((task_type == task) & (F.size(F.array_except(F.array(*[F.lit(n) for n in names]), score_keys)) > 0))
    return F.coalesce(out, F.lit(True))


# --- which splits and tasks ---------------------------------------------------------


def split_names(found: list[str], asked: list[str] | None = None, phase_splits: list[str] | None = None) -> list[str]:
    """The splits to evaluate, in the order they were found: those asked for, else the
    phase's, else all."""
    wanted = asked if asked is not None else phase_splits
    return list(found) if wanted is None else [s for s in found if s in set(wanted)]


def in_scope(examples: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Examples of the tasks that a phase allows in their split; splits that it doesn't
    name are kept whole."""
    out = F.lit(True)
    for split, tasks in allowed.items():
        out = F.when(F.col("split") == split, F.col("task_type").isin(*tasks) if tasks else F.lit(False)).otherwise(out)
    return examples.filter(out)


def engine_splits(found: list[str], phase: str | None, off: bool = False, full: bool = False) -> list[str]:
    """The splits whose losses are worth an engine's time."""
    return [] if off else list(found) if full else [ENGINE_SPLIT] if phase == "c" and ENGINE_SPLIT in found else []
