"""Frozen benchmark splits: tasks in turn, gold answers, prompts, dense ids, coverage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.chess_udfs import _position
from ..functions.keys import hash_order
from ..functions.metrics import metric_of, primary_score
from ..functions.protocol import choice_match, fen_exact
from ..ship import ship
from ..store import spread, stash
from .generators import _column, _said, board_context, render, with_contract
from .joins import missing_from
from .ranking import number_bucket, with_rank

#: Numbers of a split's ranges of ordinals.
_RANGE = 4096

# Tasks of each split in the order they are dealt, metrics that aren't
# what their task is called, tasks that are reported only, tasks whose prompt needs a
# whole FEN and those that start from one; lines of such prompts.
SPLIT_TASKS = {
    "perception": (
        "board_print", "board_to_fen", "piece_id", "material_count", "square_lookup", "rank_lookup", "square_coordinates", "fen_rank_expansion", "fen_rank_cell_edit",
        "fen_board_edit", "move_square_edits", "fen_assembly", "fen_row_application", "state_tracking", "material_inventory", "material_piece_counts",
        "material_value_totals", "material_balance_trace", "multi_state_tracking",
    ),
    "rules": (
        "legal_moves", "side_piece_inventory", "piece_legal_moves", "check_detection", "captures", "special_rules", "legality_check", "piece_pseudo_legal_moves",
        "piece_legal_filter", "king_safety_filter", "legal_moves_by_piece", "ray_walk", "legal_filter_trace",
    ),
    "tactics": ("capture_id", "hanging_pieces", "threats", "tactical_patterns", "hanging_piece_claim_verification"),
    "evaluation": ("material_balance", "eval_bucket", "pawn_structure"), "openings": ("opening_name", "opening_continuation"),
    "endgames": ("endgame_classification", "endgame_wdl", "endgame_best_move"),
    "planning": ("best_move", "puzzle_solve", "candidate_ratings", "best_line_trace", "step_verification"),
    "chess960": ("legal_moves_960", "check_detection_960", "castling_rules_960"), "mate": ("binary_choice",),
}
METRIC_OF = {
    "board_print": "board_exact_match", "board_to_fen": "fen_exact_match", "fen_assembly": "fen_exact_match", "fen_row_application": "fen_exact_match",
    "state_tracking": "fen_exact_match", "multi_state_tracking": "fen_exact_match", "material_count": "material_count", "legal_moves": "uci_set_jaccard",
    "legal_moves_960": "uci_set_jaccard", "piece_legal_moves": "uci_set_jaccard", "captures": "uci_set_jaccard", "capture_id": "uci_set_jaccard",
    "side_piece_inventory": "side_piece_inventory", "check_detection": "check_state", "check_detection_960": "check_state", "special_rules": "special_rules",
    "legality_check": "legality_check", "threats": "threat_f1", "hanging_piece_claim_verification": "hanging_piece_claim_verification", "eval_bucket": "eval_bucket",
    "opening_continuation": "continuation_rank", "best_move": "move_extraction", "puzzle_solve": "move_extraction", "candidate_ratings": "candidate_ratings",
    "best_line_trace": "best_line_trace", "step_verification": "step_verification", "binary_choice": "move_choice",
    **{t: "text_exact_match" for t in (
        "material_inventory", "material_piece_counts", "material_value_totals", "material_balance_trace", "square_lookup", "rank_lookup", "square_coordinates",
        "fen_rank_expansion", "fen_rank_cell_edit", "fen_board_edit", "move_square_edits", "piece_pseudo_legal_moves", "piece_legal_filter", "king_safety_filter",
        "legal_moves_by_piece", "ray_walk", "legal_filter_trace",
    )},
}
DIAGNOSTIC = (
    "square_lookup", "rank_lookup", "square_coordinates", "fen_rank_expansion", "fen_rank_cell_edit", "fen_board_edit", "move_square_edits", "fen_assembly",
    "fen_row_application", "material_inventory", "material_piece_counts", "material_value_totals", "material_balance_trace", "side_piece_inventory",
    "piece_legal_moves", "piece_pseudo_legal_moves", "piece_legal_filter", "king_safety_filter", "legal_moves_by_piece", "ray_walk", "legal_filter_trace",
    "multi_state_tracking", "hanging_piece_claim_verification", "step_verification",
)
FULL_STATE = ("board_to_fen", "fen_assembly", "fen_row_application", "state_tracking", "multi_state_tracking")
STATE_LINES = (
    "State needed for full FEN:", "Side to move: {side_to_move}", "Castling rights: {castling_rights}", "En passant: {en_passant_square}",
    "Halfmove clock: {halfmove_clock}", "Fullmove number: {fullmove_number}",
)
# Fixed values end.


def _is(task: Column, names: tuple) -> Column:
    return task.isin(*names)


def metric_type(task: Column) -> Column:
    out = F.lit("exact_match")
    for metric in sorted(set(METRIC_OF.values())):
        out = F.when(_is(task, tuple(t for t, m in METRIC_OF.items() if m == metric)), metric).otherwise(out)
    return out


def planning_task(requested: Column, extra: Column) -> Column:
    """The one task of a planning row: what it asks for or holds."""
    has = lambda name: F.coalesce(F.get_json_object(extra, f"$.{name}"), F.lit("")) != ""
    return (
        F.when(requested.isin("best_line_trace", "7.10_best_line_trace") | has("best_line_trace"), "best_line_trace").when(has("verification_trace"), "step_verification")
        .when(has("candidate_ratings") | has("move_evaluations"), "candidate_ratings").when(has("puzzle_id"), "puzzle_solve").otherwise("best_move")
    )


def first_answer(fen: Column, tasks: Column, number: Column, extra: Column, chess960: Column | bool = False) -> Column:
    """struct(task_type, gold_answer, fields) of the first of a row's tasks that has an
    answer; null if none has. Later tasks are not looked at."""
    ship()

    @F.pandas_udf("task_type string, gold_answer string, fields map<string,string>")
    def run(variant: pd.Series, fens: pd.Series, names: pd.Series, numbers: pd.Series, extras: pd.Series) -> pd.DataFrame:
        out = []
        for v, f, own, n, more in zip(variant, fens, names, numbers, extras, strict=True):
            try:
                row = json.loads(more) if isinstance(more, str) else {}
            except ValueError:
                row = {}
            found = (None, None, None)
            for task in own if own is not None else ():
                p = _position(f, bool(v) or task.endswith("_960"))
                got = A.answers(p, task, int(n), row if isinstance(row, dict) else {}) if p is not None else []
                if got and got[0][0]:
                    found = (task, got[0][0], {k: _said(x) for k, x in got[0][1].items() if x is not None})
                    break
            out.append(found)
        return pd.DataFrame(out, columns=["task_type", "gold_answer", "fields"], dtype=object)

    return run(F.lit(chess960) if isinstance(chess960, bool) else chess960, fen, tasks, number, extra)


def freeze_split(positions: DataFrame, split: str, tasks: list[str] | None, ordinal: str, seed: int = 42, templates: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """(example_id, split, task_type, metric_type, fen, prompt, gold_answer, metadata) of
    positions(ordinal, fen[, is_chess960, extra, task_type]): the i-th position gets task
    i modulo their number, or the first other one that has an answer; rows of the
    planning split get the one that they ask for. Positions without an answer are left
    out, and ids are dense over those that stay, five digits at least. The prompt fills
    the task's template(task_type, template) (null without one). ``tasks`` None: those
    of the split."""
    names = list(tasks if tasks is not None else SPLIT_TASKS[split])
    rows = positions.select(
        F.col(ordinal), "fen", F.coalesce(_column(positions, "is_chess960", F.lit(False)), F.lit(False)).alias("is_chess960"),
        _column(positions, "extra", F.lit(None).cast("string")).alias("extra"), _column(positions, "task_type", F.lit(None).cast("string")).alias("_asked"),
    )
    turned = spread(with_rank(rows, [], F.col(ordinal), "_i", number_bucket(ordinal, _RANGE)))
    every = F.array(*[F.lit(t) for t in names])
    primary = F.element_at(every, (F.pmod(F.col("_i") - 1, F.lit(len(names))) + 1).cast("int"))
    order = F.array(planning_task(F.col("_asked"), F.col("extra"))) if split == "planning" and tasks is None else F.concat(F.array(primary), F.array_remove(every, primary))
    number = F.pmod(F.xxhash64(F.lit(seed), "fen"), F.lit(1 << 20)).cast("int")
    kept = turned.withColumn("_order", order).withColumn("a", first_answer(F.col("fen"), F.col("_order"), number, F.col("extra"), F.col("is_chess960"))).filter("a.gold_answer is not null")
    # counted and ranked below: written once, not answered for each
    kept = stash(kept.drop("_i", "_order"), "answered")
    ranked = with_rank(kept, [], F.col(ordinal), "_i", number_bucket(ordinal, _RANGE)).select(
        F.concat(F.lit(f"{split}_"), F.format_string("%05d", F.col("_i") - 1)).alias("example_id"), F.lit(split).alias("split"), "a.task_type", "fen", "is_chess960", "a.gold_answer", "a.fields",
    )
    prompted = ranked.withColumn("prompt", F.lit(None).cast("string")) if templates is None else _prompts(ranked, templates, contracts)
    task = F.col("task_type")
    marks = F.create_map(F.lit("diagnostic"), F.when(_is(task, DIAGNOSTIC), "true"), F.lit("hard_gate"), F.when(_is(task, DIAGNOSTIC), "false"))
    metadata = F.map_filter(F.map_concat("fields", marks), lambda k, v: v.isNotNull())
    return prompted.select("example_id", "split", "task_type", metric_type(task).alias("metric_type"), "fen", "prompt", "gold_answer", metadata.alias("metadata"))


def _prompts(rows: DataFrame, templates: DataFrame, contracts: DataFrame | None) -> DataFrame:
    pool = stash(templates.groupBy(F.col("task_type").alias("_t")).agg(F.min("template").alias("_template")), "pool")
    joined = rows.join(pool, rows["task_type"] == pool["_t"], "left").drop("_t")
    if contracts is None:
        joined = joined.withColumn("_contract", F.lit(None).cast("string"))
    else:
        own = stash(contracts.select(F.col("task_type").alias("_t"), F.col("contract").alias("_contract")), "contracts")
        joined = joined.join(own, joined["task_type"] == own["_t"], "left").drop("_t")
    context = F.map_concat(board_context(F.col("fen"), F.col("is_chess960")), F.create_map(F.lit("fen"), F.col("fen")))
    values = F.map_concat(F.map_filter(context, lambda k, v: ~F.map_contains_key("fields", k)), F.col("fields"))
    template = F.when(_is(F.col("task_type"), FULL_STATE), F.concat_ws("\n", F.col("_template"), F.lit("\n".join(STATE_LINES)))).otherwise(F.col("_template"))
    return joined.withColumn("prompt", with_contract(render(template, values), F.col("_contract"))).drop("_template", "_contract")


def coverage_gaps(planned: DataFrame, frozen: DataFrame) -> DataFrame:
    """(split, task_type) that were planned and have no example."""
    return missing_from(planned, frozen, ["split", "task_type"])


def oracle_failures(frozen: DataFrame) -> DataFrame:
    """Examples whose own gold answer doesn't score 1 by their task's metric."""
    gold, task = F.col("gold_answer"), F.col("task_type")
    kind = metric_of(task, F.col("metric_type"))
    score = F.when(kind == "fen_exact_match", fen_exact(gold, gold)).when(kind == "move_choice", choice_match(gold, gold, F.lit(None).cast("string"), F.lit(None).cast("string"))).otherwise(primary_score(kind, gold, gold))
    return frozen.withColumn("score", score).filter("score <> 1.0 or score is null")


def manifest(frozen: DataFrame) -> DataFrame:
    """(split, n, fingerprint): counts and an order-free digest of each split's rows."""
    digest = F.xxhash64("example_id", "task_type", "fen", "gold_answer")
    return frozen.groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(digest).alias("fingerprint"))


def choose_weighted(moves: DataFrame, group: str, move: str, weight: str, seed: int) -> DataFrame:
    """(group, move): one move of each group, drawn in proportion to its weight by the
    smallest -ln(u) / weight, u from a hash; weights of 0 and below are never drawn."""
    u = (F.conv(F.substring(hash_order(seed, group, move), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    return moves.filter(F.col(weight) > 0).groupBy(group).agg(F.min_by(move, -F.log(u) / F.col(weight)).alias(move))
