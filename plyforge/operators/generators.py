"""Training rows of board tasks: block list, answers, prompts, identities, caps."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import chess
from ..functions.chess_udfs import _position
from ..functions.keys import example_identity, hash_order
from ..functions.protocol import valid_fen, variant_key
from ..functions.traces import verification_cases
from ..ship import ship
from ..store import spread, stash
from .decontaminate import ROW_FEN, block_keys
from .ranking import with_rank

# Fields that, beside the position, tell examples of a task apart.
IDENTITY_FIELDS = {
    "1.3_piece_identification": ("query_kind", "square", "color", "piece"), "1.5_state_tracking": ("moves",), "1.6_square_lookup": ("square",),
    "1.7_rank_lookup": ("rank",), "1.8_move_square_edits": ("move",), "1.9_fen_assembly": ("move",), "1.10_fen_row_application": ("move",),
    "1.11_square_coordinates": ("square",), "1.12_fen_rank_expansion": ("rank", "fen_rank_row"), "1.13_fen_rank_cell_edit": ("move", "square", "rank", "file"),
    "1.14_fen_board_edit": ("move",), "1.19_multi_move_state_tracking": ("moves",), "2.2_piece_specific_moves": ("source_square", "square"),
    "2.3_move_legality_check": ("tested_move", "move"), "2.5_special_rules": ("special_rule_bucket", "square"), "2.6_piece_pseudo_legal_moves": ("source_square",),
    "2.7_piece_legal_filter": ("source_square",), "2.8_king_safety_filter": ("tested_move",), "2.10_ray_walk": ("source_square",),
    "3.3_attacked_defended": ("query_square",), "3.6_hanging_piece_status": ("query_square",),
    "3.8_hanging_piece_claim_verification": ("verification_claim", "corruption_kind"), "3.9_static_exchange_evaluation": ("capture_move",),
    "5.1_opening_identification": ("variant", "cycle"), "5.2_opening_continuation": ("variant", "cycle"), "5.3_opening_principles": ("variant", "cycle"),
    "7.8_candidate_ratings": ("candidate_moves",), "7.9_step_verification": ("source_task", "corruption_kind", "faulty_line"),
    "7.10_best_line_trace": ("best_move", "pv_line"), "7.11_history_best_move": ("game_id", "ply", "move_history"),
}
SYSTEM_PROMPT = (
    "You are a chess reasoning engine. You understand chess positions in FEN notation and express all moves in UCI notation "
    "(e.g., e2e4, g1f3, a7a8q for promotion). When analyzing positions, think step by step."
)
STEPS = "7.9_step_verification"
# Fixed values end.

_FOUND = "array<struct<task:string,answer:string,fields:map<string,string>>>"


def _said(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def task_answers(fen: Column, tasks: Column, numbers: Column, extra: Column, chess960: Column | bool = False) -> Column:
    """array<struct<task, answer, fields>> of all tasks of a row: ``numbers`` (one for
    each task) stand for its open choices, ``extra`` is a JSON object of what the row
    knows besides. A position is read once, however many tasks there are; rows that
    aren't positions and unreadable extras give nothing."""
    ship()

    @F.pandas_udf(_FOUND)
    def run(variant: pd.Series, fens: pd.Series, names: pd.Series, choices: pd.Series, extras: pd.Series) -> pd.Series:
        out = []
        for v, f, own, ns, more in zip(variant, fens, names, choices, extras, strict=True):
            p = _position(f, v)
            try:
                row = json.loads(more) if isinstance(more, str) else {}
            except ValueError:
                row = {}
            found = []
            if p is not None and own is not None:
                for task, n in zip(own, ns, strict=True):
                    for text, fields in A.answers(p, task, n, row if isinstance(row, dict) else {}):
                        found.append({"task": task, "answer": text, "fields": {k: _said(x) for k, x in fields.items() if x is not None}})
            out.append(found)
        return pd.Series(out, dtype=object)

    return run(F.lit(chess960) if isinstance(chess960, bool) else chess960, fen, tasks, numbers, extra)


def board_context(fen: Column, chess960: Column | bool = False) -> Column:
    """What prompts say of a position: map of board, side_to_move, castling_rights,
    en_passant_square, halfmove_clock, fullmove_number; empty for no position."""
    ship()

    @F.pandas_udf("map<string,string>")
    def run(variant: pd.Series, fens: pd.Series) -> pd.Series:
        out = []
        for v, f in zip(variant, fens, strict=True):
            p = _position(f, v)
            rights = p.castling_field() if p else "-"
            out.append({} if p is None else {
                "board": A.board_text(p), "side_to_move": "white" if p.white else "black", "castling_rights": "none" if rights == "-" else rights,
                "en_passant_square": "none" if p.ep is None else chess.name(p.ep), "halfmove_clock": str(p.half), "fullmove_number": str(p.full),
            })
        return pd.Series(out, dtype=object)

    return run(F.lit(chess960) if isinstance(chess960, bool) else chess960, fen)


def render(template: Column, values: Column) -> Column:
    """The template with each {name} that the map ``values`` has in its place."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def with_contract(prompt: Column, contract: Column) -> Column:
    """The prompt with the answer's expected form after it, once."""
    return F.when(contract.isNull() | F.contains(prompt, contract), prompt).otherwise(F.concat(F.regexp_replace(prompt, r"\s+$", ""), F.lit("\n\n"), contract))


def messages(user: Column, assistant: Column, system: str | None = None) -> Column:
    """Chat messages: system if there is one, user, assistant."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = [turn("system", F.lit(system))] if system else []
    return F.array(*first, turn("user", user), turn("assistant", assistant))


def identity(task: Column, pos_key: Column, fields: Column) -> Column:
    """example_identity of each row by those of its fields that its task names."""
    names = F.create_map(*[x for t, own in IDENTITY_FIELDS.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in own]))])
    own = F.coalesce(F.try_element_at(names, task), F.array().cast("array<string>"))
    return example_identity(task, pos_key, F.map_filter(fields, lambda k, v: F.array_contains(own, k)))


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def task_rows(positions: DataFrame, tasks: list[str], blocked: DataFrame | None = None, per_task: int | None = None, seed: int = 42) -> DataFrame:
    """(task, tier, fen, is_chess960, pos_key, choice, answer, fields, example_identity)
    for each usable position of positions(fen[, is_chess960, extra]) and each task, one
    row for each of a task's answers. ``extra`` is a JSON object of engine, puzzle or
    opening columns. Left out are rows that aren't positions, and those in which any
    FEN, their own or one in the answer, is in blocked(fen): by its canonical key and
    variant, and across variants where castling is gone. Choices come from a hash of
    seed, task and position; with ``per_task`` each task keeps its first rows by hash
    order."""
    rows = spread(positions).select("fen", F.coalesce(_column(positions, "is_chess960", F.lit(False)), F.lit(False)).alias("is_chess960"), _column(positions, "extra", F.lit(None).cast("string")).alias("extra"))
    # a row that is valid as Chess960 only is one, whatever it says
    rows = rows.withColumn("pos_key", variant_key(F.col("fen"), chess960=F.col("is_chess960"))).withColumn("is_chess960", F.col("pos_key").startswith("960:"))
    keys = None if blocked is None else block_keys(blocked, chess960=_column(blocked, "is_chess960", F.lit(False)))
    if keys is not None:
        rows = rows.join(keys.withColumnRenamed("key", "pos_key"), "pos_key", "left_anti")
    names = F.array(*[F.lit(t) for t in tasks])
    numbers = F.transform(names, lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("fen")), F.lit(1 << 20)).cast("int"))
    rows = rows.withColumn("_tasks", names).withColumn("_numbers", numbers)
    rows = rows.withColumn("_found", task_answers(F.col("fen"), F.col("_tasks"), F.col("_numbers"), F.col("extra"), F.col("is_chess960")))
    # the planner has inline() filter on the answers' number, and takes that filter, and
    # with it the answers, below the distinct and the spreading that positions come from
    rows = rows.select("fen", "is_chess960", "pos_key", F.inline_outer("_found")).filter("task is not null")
    rows = rows.withColumn("choice", F.pmod(F.xxhash64(F.lit(seed), "task", "fen"), F.lit(1 << 20)).cast("int"))
    rows = rows.withColumn("example_identity", identity(F.col("task"), F.col("pos_key"), F.col("fields")))
    if keys is not None:
        rows = _without_blocked_answers(rows, keys)
    if per_task is not None:
        rows = with_rank(rows, ["task"], hash_order(seed, "task", "fen", "example_identity"), "_rank").filter(F.col("_rank") <= per_task).drop("_rank")
    tier = F.split("task", r"\.")[0].cast("int")
    return rows.select("task", tier.alias("tier"), "fen", "is_chess960", "pos_key", "choice", "answer", "fields", "example_identity")


def _without_blocked_answers(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose answer holds no blocked FEN. Only rows whose answer holds any are
    looked up, by the answers' own FENs. The rows are read several times: they are
    written once, not worked out each time."""
    fens = F.regexp_extract_all("answer", F.lit(ROW_FEN), F.lit(0))
    held = stash(rows.withColumn("_fens", fens), "held")
    some = held.filter(F.size("_fens") > 0)
    each = some.select("is_chess960", F.explode("_fens").alias("_fen")).distinct()
    bad = each.withColumn("key", variant_key(F.col("_fen"), chess960=F.col("is_chess960"))).join(keys, "key", "left_semi").select(F.col("is_chess960").alias("_960"), "_fen")
    own = some.withColumn("_fen", F.explode("_fens")).join(bad, "_fen").filter(F.col("is_chess960") == F.col("_960")).select("task", "pos_key", "example_identity").distinct()
    clean = some.join(own, ["task", "pos_key", "example_identity"], "left_anti")
    return held.filter(F.size("_fens") == 0).drop("_fens").unionByName(clean.drop("_fens"))


def step_rows(rows: DataFrame) -> DataFrame:
    """Rows of the task that looks for a trace's broken line, as task_rows gives rows:
    one for each fault that can be put into a trace among task_rows' rows, and one for
    the trace as it is. fields hold the trace, numbered, and the verifier's label."""
    cases = verification_cases(rows)
    names = ("displayed_trace", "verification_trace", "corruption_kind", "difficulty", "verification_verdict", "faulty_line", "error_type", "correction", "expected_answer")
    fields = F.create_map(F.lit("source_task"), F.col("task"), F.lit("source_trace"), F.col("answer"), *[x for c in names for x in (F.lit(c), F.col(c))])
    told = cases.select(F.lit(STEPS).alias("task"), F.lit(7).alias("tier"), "fen", "is_chess960", "pos_key", "choice", F.col("expected_answer").alias("answer"), fields.alias("fields"))
    return told.withColumn("example_identity", identity(F.col("task"), F.col("pos_key"), F.col("fields")))


def training_rows(rows: DataFrame, templates: DataFrame, contracts: DataFrame | None = None, seed: int = 42, system: str = SYSTEM_PROMPT) -> DataFrame:
    """(task, tier, fen, is_chess960, messages, metadata) of task_rows' rows: the prompt
    is one of the task's templates(task, template), drawn by a hash of seed and
    identity and filled with the row's fields and its position, then the task's
    contract(task, contract). Tasks without a template give no row. metadata is a map
    of the fields and the example's identity."""
    # tables of a known size: where they are small no row moves, and rows of one task are many
    pools = stash(templates.groupBy("task").agg(F.array_sort(F.collect_set("template")).alias("_pool")), "pools")
    joined = rows.join(pools, "task")
    if contracts is not None:
        joined = joined.join(stash(contracts.select("task", "contract"), "contracts"), "task", "left")
    else:
        joined = joined.withColumn("contract", F.lit(None).cast("string"))
    at = F.pmod(F.xxhash64(F.lit(seed), "example_identity"), F.size("_pool")).cast("int")
    values = F.map_concat(board_context(F.col("fen"), F.col("is_chess960")), F.create_map(F.lit("fen"), F.col("fen")))
    # a row's own fields go before what its position says
    values = F.map_concat(F.map_filter(values, lambda k, v: ~F.map_contains_key("fields", k)), F.col("fields"))
    prompt = with_contract(render(F.get("_pool", at), values), F.col("contract"))
    metadata = F.map_concat("fields", F.create_map(F.lit("example_identity"), F.col("example_identity")))
    return joined.select("task", "tier", "fen", "is_chess960", messages(prompt, F.col("answer"), system).alias("messages"), metadata.alias("metadata"))


def usable(positions: DataFrame, chess960: Column | bool = False) -> DataFrame:
    """The rows that are positions."""
    return positions.filter(valid_fen(F.col("fen"), chess960=chess960))
