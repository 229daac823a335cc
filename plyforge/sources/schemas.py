"""Schemas of the artifacts."""

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGES = T.ArrayType(_struct(role=S, content=S))
SFT_ROW = _struct(task=S, tier=I, fen=S, is_chess960=B, messages=MESSAGES, metadata=S)
TRAINING_ROW = _struct(messages=MESSAGES, task=S, tier=L, fen=S, is_chess960=B, chess960_id=L)
POSITION_EVAL = _struct(fen=S, best_move=S, pv_line=S, depth=I, knodes=L, cp=I, mate=I, eval_perspective=S)
PUZZLE = _struct(fen=S, side=S, legal_moves=T.ArrayType(S), solution_first_move=S, solution_full=T.ArrayType(S), themes=T.ArrayType(S), rating=I, puzzle_id=S)
OPENING = _struct(eco_volume=S, eco=S, name=S, pgn=S, uci_moves=T.ArrayType(S), epd=S, fen=S)
BENCHMARK_EXAMPLE = _struct(example_id=S, split=S, task_type=S, fen=S, prompt=S, gold_answer=S, metric_type=S, metadata=S)
PREDICTION = _struct(example_id=S, sample_index=I, prediction=S, raw_prediction=S)
PROMPT = _struct(prompt_id=S, messages=MESSAGES, fen=S, task_type=S, metadata=S)
ROLLOUT = _struct(rollout_id=S, prompt_id=S, model_id=S, raw_output=S, parsed_answer=_struct(raw_text=S, move_uci=S, format_type=S, parse_error=S))
JUDGMENT = _struct(judgment_id=S, rollout_id=S, legal=B, regret_cp=D, failure_bucket=S, teacher_move_uci=S, feedback=S)
