"""Rollouts, judgments, and the rows that repair what was judged wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chess_udfs as U
from ..functions import protocol as P
from ..functions.text import UCI, normalize, parse_answer, strip
from .decontaminate import block_keys
from .generators import SYSTEM_PROMPT, messages
from .joins import first_reason
from .ranking import number_bucket
from .refresh import FORMAT_REPAIR, ILLEGAL_MOVE, INVALID_FEN, LEAST_REGRET, LEGAL_UNSCORED, MISSING_FEN, MOVE_CORRECTION, MOVE_TASKS, PARSE_FAILURE, refresh, refresh_task, skip_reason

# Wording of refresh rows.
REFUSED = "The previous answer was rejected. Reply with the corrected move."
THOUGHTS = {
    FORMAT_REPAIR: "The previous answer did not provide a single parseable UCI move. Use the verified target move.",
    MOVE_CORRECTION: "The previous move was not the verified target for this position. Use the corrected move.",
}
# Fixed values end.


def prompt_is_960(benchmark_flag: Column, benchmark_id: Column, flag: Column, id_: Column, task_type: Column, default: bool = False) -> Column:
    """Whether a prompt is played by Chess960 rules: what its benchmark row says, then
    its own marks, then its task's name."""
    named = F.coalesce(task_type.endswith("_960") | (task_type == "chess960"), F.lit(False)) | F.lit(default)
    return F.coalesce(benchmark_flag, F.when(benchmark_id.isNotNull(), F.lit(True)), flag, F.when(id_.isNotNull(), F.lit(True)), named)


def rollouts(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs(rollout_id, prompt_id, model_id, raw_output) with their parsed answers
    and the prompts' positions; outputs without a prompt are left out."""
    parsed = outputs.withColumn("parsed_answer", parse_answer(F.coalesce("raw_output", F.lit(""))))
    return parsed.join(prompts.select("prompt_id", "fen", "task_type"), "prompt_id")


def judge(played: DataFrame, chess960: Column | bool = False) -> DataFrame:
    """rollouts() with legal, legality_reason and failure_bucket: the first of no
    position, no valid position, no parsed move, an illegal move; else unscored."""
    move = F.col("parsed_answer.move_uci")
    seen = played.withColumn("_state", U.check_state(F.col("fen"), chess960=chess960)).withColumn("legality_reason", U.legality_reason(F.col("fen"), move, chess960=chess960))
    legal = F.when(F.col("_state").isNotNull(), F.coalesce(F.col("legality_reason") == "legal", F.lit(False)) & move.isNotNull())
    bucket = first_reason([
        (F.coalesce(F.trim("fen"), F.lit("")) == "", MISSING_FEN), (F.col("_state").isNull(), INVALID_FEN), (move.isNull(), PARSE_FAILURE),
        (~F.col("legal"), ILLEGAL_MOVE), (F.lit(True), LEGAL_UNSCORED),
    ])
    return seen.withColumn("legal", legal).withColumn("failure_bucket", bucket).drop("_state")


def with_regret(judged: DataFrame, best_cp: str, move_cp: str, teacher: str) -> DataFrame:
    """regret_cp of legal moves from engine columns: 0 for the teacher's own move,
    else what the best evaluation lost, 0 at least. A move with a regret is scored: its
    failure bucket goes."""
    move = F.col("parsed_answer.move_uci")
    regret = F.when(move == F.col(teacher), 0.0).otherwise(F.greatest(F.lit(0.0), (F.col(best_cp) - F.col(move_cp)).cast("double")))
    scored = judged.withColumn("regret_cp", F.when(F.col("legal") & F.col(best_cp).isNotNull() & F.col(move_cp).isNotNull(), regret))
    return scored.withColumn("failure_bucket", F.when(F.col("regret_cp").isNull(), F.col("failure_bucket")))


def _legal_target(move: Column, fen: Column, chess960: Column | bool) -> Column:
    text = normalize(move)
    return F.when(text.rlike(f"^{UCI}$") & P.is_legal(fen, text, chess960), text)


def with_target(judged: DataFrame, teacher: str, gold: str, chess960: Column | bool = False) -> DataFrame:
    """target and target_source: the teacher's move if it is legal, else a gold answer
    that is one legal move and nothing else."""
    own, said = _legal_target(F.col(teacher), F.col("fen"), chess960), _legal_target(F.col(gold), F.col("fen"), chess960)
    marked = judged.withColumn("_own", own).withColumn("_said", said)
    source = F.when(F.col("_own").isNotNull(), "teacher_move_uci").when(F.col("_said").isNotNull(), "gold_answer")
    return marked.withColumn("target", F.coalesce("_own", "_said")).withColumn("target_source", source).drop("_own", "_said")


def refresh_rows(
    judgments: DataFrame, rollouts_: DataFrame, prompts: DataFrame, blocked: DataFrame | None = None, least_regret: float = LEAST_REGRET,
    task_types: tuple[str, ...] = MOVE_TASKS, cap: int | None = None, ordinal: str = "ordinal",
) -> DataFrame:
    """judgments(ordinal, judgment_id, rollout_id, legal, failure_bucket, regret_cp,
    teacher_move_uci) with their rollouts(rollout_id, prompt_id, model_id, raw_output,
    parsed_move) and prompts(prompt_id, fen, is_chess960, task_type, user_prompt,
    gold_answer), each with the reason that it is skipped for, or null: then ``task``,
    ``target``, ``target_source`` say what to learn. Positions of blocked(fen) are left
    out. Rows are taken in order of the ordinal up to ``cap``."""
    joined_prompts = prompts.withColumn("has_prompt", F.lit(True)).withColumn("is_chess960", F.coalesce("is_chess960", F.lit(False)))
    joined_prompts = joined_prompts.withColumn("_valid", P.valid_fen(F.col("fen"), chess960=F.col("is_chess960"))).withColumn("_key", P.variant_key(F.col("fen"), chess960=F.col("is_chess960")))
    if blocked is None:
        joined_prompts = joined_prompts.withColumn("_blocked", F.lit(False))
    else:
        keys = block_keys(blocked).select(F.col("key").alias("_key"), F.lit(True).alias("_blocked"))
        joined_prompts = joined_prompts.join(keys, "_key", "left").withColumn("_blocked", F.coalesce("_blocked", F.lit(False)))
    rolled = rollouts_.withColumn("has_rollout", F.lit(True))
    fields = judgments.join(rolled, "rollout_id", "left").join(joined_prompts, "prompt_id", "left")
    fields = with_target(fields, "teacher_move_uci", "gold_answer", F.coalesce(F.col("is_chess960"), F.lit(False)))
    failure, legal, regret = F.col("failure_bucket"), F.coalesce("legal", F.lit(False)), F.col("regret_cp")
    fields = fields.withColumn("task", refresh_task(failure, legal, regret, least_regret))
    needs_teacher = (F.col("task") == MOVE_CORRECTION) & legal & failure.isNull() & (F.coalesce("target_source", F.lit("")) != "teacher_move_uci")
    rules = [
        (F.col("has_rollout").isNull(), "missing_rollout"), (F.col("has_prompt").isNull(), "missing_prompt"),
        *[(F.col("task").isNull() & (skip_reason(failure, legal, regret, least_regret) == r), r) for r in (MISSING_FEN, INVALID_FEN, LEGAL_UNSCORED, "unscored_legal", "low_regret", "unsupported_judgment")],
        (~F.coalesce(F.col("task_type").isin(*task_types), F.lit(False)), "non_move_task"), (F.coalesce(F.col("fen"), F.lit("")) == "", "missing_fen"),
        (~F.coalesce("_valid", F.lit(False)), "invalid_fen"), (F.col("_blocked"), "blocklisted_fen"), (F.coalesce(strip(F.col("user_prompt")), F.lit("")) == "", "missing_prompt_text"),
        (F.col("target").isNull() | needs_teacher, "missing_target_move"),
        ((F.col("task") == MOVE_CORRECTION) & (F.col("target") == normalize(F.col("parsed_move"))), "target_equals_model_move"),
    ]
    # joins are done: the operator marks reasons, repeats and the cap
    none = fields.sparkSession.createDataFrame([], "rollout_id string, prompt_id string, _none boolean")
    marked = refresh(fields, none.select(F.col("rollout_id"), F.col("_none").alias("_n1")).limit(0), none.select("prompt_id", F.col("_none").alias("_n2")).limit(0), rules, ordinal, ["task", "_key", "target"], number_bucket(ordinal, 4096), cap if cap is not None else 1 << 60)
    return marked.drop("_n1", "_n2", "_valid", "_blocked", "has_rollout", "has_prompt")


def repair_rows(accepted: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Training rows (task, tier, fen, is_chess960, messages, metadata) of refresh_rows'
    rows without a reason: the prompt with the rejected answer, and the target move."""
    rows = accepted.filter("reason is null")
    thought = F.when(F.col("task") == FORMAT_REPAIR, THOUGHTS[FORMAT_REPAIR]).otherwise(THOUGHTS[MOVE_CORRECTION])
    user = F.concat(F.col("user_prompt"), F.lit("\n\nPrevious answer:\n"), F.coalesce("raw_output", F.lit("")), F.lit(f"\n\n{REFUSED}"))
    assistant = F.concat(F.lit("<think>"), thought, F.lit("</think>\n<move>"), F.col("target"), F.lit("</move>"))
    metadata = {
        "source": F.lit("autodata_sft_refresh"), "source_prompt_id": F.col("prompt_id"), "source_rollout_id": F.col("rollout_id"), "source_judgment_id": F.col("judgment_id"),
        "model_id": F.col("model_id"), "failure_bucket": F.col("failure_bucket"), "regret_cp": F.col("regret_cp").cast("string"), "parsed_model_move_uci": F.col("parsed_move"),
        "target_move_uci": F.col("target"), "target_source": F.col("target_source"),
    }
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select("task", F.lit(7).alias("tier"), "fen", "is_chess960", messages(user, assistant, system).alias("messages"), F.create_map(*pairs).alias("metadata"))


def judgment_id(prompt_id: Column, rollout_id: Column) -> Column:
    return F.concat(F.lit("judgment-"), F.substring(F.sha2(F.concat_ws("\n", prompt_id, rollout_id), 256), 1, 16))


def review(rollouts_: DataFrame, prompts: DataFrame, judgments: DataFrame, ordinal: str) -> DataFrame:
    """rollouts with their prompts and last judgments, each null where there is none."""
    last = judgments.groupBy("rollout_id").agg(F.max_by(F.struct("judgment_id", "legal", "failure_bucket", "regret_cp"), ordinal).alias("judgment"))
    return rollouts_.join(prompts.select("prompt_id", F.struct("fen", "task_type").alias("prompt")), "prompt_id", "left").join(last, "rollout_id", "left")
