"""Row constraints: an array of what is wrong with each row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import metrics as M
from ..functions import protocol as P
from ..functions import text as X
from ..functions.chess_udfs import _position, legal_moves
from ..functions.traces import step_answer
from ..ship import ship

# Roles of messages, tasks with grammars of their own, the task whose
# answer is a move tag alone, fields that name the move a row is about.
ROLES = ("system", "user", "assistant")
RATINGS, STEPS, BEST_LINE, HISTORY = "7.8_candidate_ratings", "7.9_step_verification", "7.10_best_line_trace", "7.11_history_best_move"
TARGETS = ("target_move", "best_move", "solution_first_move")
# Fixed values end.


def with_errors(df: DataFrame, rules: list[tuple[Column, str]], name: str = "errors") -> DataFrame:
    """df with the labels of all rules that hold; a rule that is null doesn't hold."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules])))


def chat_rules(messages: str) -> list[tuple[Column, str]]:
    m = F.col(messages)
    return [
        (F.size(m) == 0, "no_messages"),
        (F.exists(m, lambda x: ~x["role"].isin(*ROLES)), "unknown_role"),
        (F.exists(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == ""), "empty_content"),
        (~F.exists(m, lambda x: x["role"] == "assistant"), "no_assistant"),
        (F.element_at(m, -1)["role"] != "assistant", "last_not_assistant"),
    ]


def expected_answer(fen: Column, task: Column, fields: Column, chess960: Column) -> Column:
    """The answer that a row's position, task and fields (a map) settle; null if none."""
    ship()

    @F.pandas_udf("string")
    def run(fens: pd.Series, tasks: pd.Series, maps: pd.Series, flags: pd.Series) -> pd.Series:
        out = []
        for fen_, task_, own, flag in zip(fens, tasks, maps, flags, strict=True):
            p = _position(fen_, flag) if task_ in A.SETTLED else None
            out.append(None if p is None else A.expected(p, task_, dict(own) if own is not None else {}))
        return pd.Series(out, dtype=object)

    return run(fen, task, fields, chess960)


def row_errors(rows: DataFrame) -> DataFrame:
    """rows(task, tier, fen, is_chess960, messages, metadata) with ``errors``: labels of
    what is wrong, none for a good row. Answers of tasks that the position and the
    metadata (a map of strings) settle are worked out again; planning answers are held
    to their grammar, the rules of chess and the move the row is about. Null fields
    count as missing."""
    flag = F.coalesce("is_chess960", F.lit(False))
    task, meta = F.coalesce("task", F.lit("")), F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    said = F.transform(F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    marked = (
        rows.withColumn("_said", said).withColumn("_meta", meta).withColumn("_valid", P.valid_fen(F.col("fen"), chess960=flag))
        .withColumn("_want", expected_answer(F.col("fen"), task, F.col("_meta"), flag)).withColumn("_legal", legal_moves(F.col("fen"), chess960=flag))
    )
    said, meta, valid, legal = F.col("_said"), F.col("_meta"), F.coalesce("_valid", F.lit(False)), F.coalesce("_legal", F.array().cast("array<string>"))
    m = F.col("messages")
    target = F.coalesce(*[F.nullif(X.normalize(meta[k]), F.lit("")) for k in TARGETS])
    first = F.get(said, F.lit(0))
    move = X.strict_move(first)
    planning = task.startswith("7.") & ~task.isin(RATINGS, STEPS, BEST_LINE)
    tagged = F.when(task == HISTORY, F.coalesce(first == F.concat(F.lit("<move>"), move, F.lit("</move>")), F.lit(False))).otherwise(X.valid_think_move(first))
    placeholder = F.exists(m, lambda x: x["role"].isin("user", "assistant") & ~X.template_complete(F.coalesce(x["content"], F.lit(""))))
    rated, line, step = M.candidate_ratings(first), M.best_line(first), M.step_label(first)
    ucis = F.transform(rated["candidates"], lambda c: c["uci"])
    want_step = step_answer(meta["verification_verdict"], meta["faulty_line"], meta["error_type"], meta["correction"])
    settled = task.isin(*A.SETTLED) & valid
    marked = marked.withColumn("_line_ok", P.valid_line(F.col("fen"), F.array_join(line["pv"], " "), chess960=flag))
    rules = [
        (task == "", "missing_task"), (F.col("tier").isNull(), "missing_tier"), (F.split(task, r"\.")[0].try_cast("int") != F.col("tier"), "tier_differs_from_task"), (~valid, "invalid_fen"),
        (m.isNull() | (F.size(m) == 0), "missing_messages"), (F.exists(m, lambda x: F.coalesce(x["role"], F.lit("")) == ""), "message_without_role"),
        (F.exists(m, lambda x: ~x["role"].isin(*ROLES)), "unsupported_role"), (F.exists(m, lambda x: x["content"].isNull()), "message_without_content"), (placeholder, "unfilled_placeholder"),
        ((settled | task.startswith("7.")) & (F.size(said) == 0), "missing_assistant_answer"),
        (settled & (F.size(said) > 0) & F.col("_want").isNull(), "fields_do_not_fit_the_position"),
        (settled & F.exists(said, lambda a: X.strip(a) != X.strip(F.col("_want"))), "answer_differs_from_expected"),
        (planning & (first != "") & ~tagged, "bad_move_format"), (planning & valid & move.isNotNull() & ~F.array_contains(legal, move), "illegal_move"),
        (planning & (move != target), "move_differs_from_target"),
        ((task == RATINGS) & (F.size(said) > 0) & rated.isNull(), "bad_ratings_format"), ((task == RATINGS) & valid & (F.size(F.array_except(ucis, legal)) > 0), "illegal_candidate"),
        ((task == RATINGS) & (F.size(F.array_distinct(ucis)) < 5), "repeated_candidate"), ((task == RATINGS) & ~F.array_contains(ucis, rated["best"]), "best_is_no_candidate"),
        ((task == RATINGS) & (rated["best"] != target), "move_differs_from_target"),
        ((task == RATINGS) & meta["candidate_moves"].isNotNull() & (F.array_join(ucis, " ") != meta["candidate_moves"]), "candidates_differ_from_metadata"),
        ((task == BEST_LINE) & (F.size(said) > 0) & line.isNull(), "bad_line_format"), ((task == BEST_LINE) & ((line["root"] != line["best"]) | (line["root"] != line["move"])), "moves_disagree"),
        ((task == BEST_LINE) & (F.get(line["pv"], F.lit(0)) != line["root"]), "line_begins_elsewhere"), ((task == BEST_LINE) & valid & line.isNotNull() & ~F.coalesce("_line_ok", F.lit(False)), "illegal_line"),
        ((task == BEST_LINE) & (line["move"] != target), "move_differs_from_target"), ((task == BEST_LINE) & (F.array_join(line["pv"], " ") != meta["pv_line"]), "line_differs_from_metadata"),
        ((task == BEST_LINE) & (X.strip(first) != X.strip(meta["expected_answer"])), "answer_differs_from_expected"),
        ((task == STEPS) & meta["verification_verdict"].isNull(), "missing_verifier_metadata"), ((task == STEPS) & (F.size(said) > 0) & step.isNull(), "bad_step_format"),
        ((task == STEPS) & meta["verification_verdict"].isNotNull() & (X.strip(first) != X.strip(want_step)), "answer_differs_from_expected"),
    ]
    out = with_errors(marked, rules).withColumn("errors", F.array_distinct("errors"))
    return out.drop("_said", "_meta", "_valid", "_want", "_legal", "_line_ok")
