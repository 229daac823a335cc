"""Answers that come from engine and tablebase columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import WDL
from ..functions.board import EVAL_BUCKETS, eval_bucket

# Sentences of the evaluation buckets.
SENTENCES = {"slight edge": "has a slight edge.", "clear advantage": "has a clear advantage.", "winning": "is winning.", "decisive": "has a decisive advantage."}
MATE_SENTENCE = "has a decisive advantage (forced mate)."
# Fixed values end.


def wdl_label(wdl: Column) -> Column:
    out = F.concat(F.lit("WDL value: "), wdl.cast("string"))
    for value, text in WDL.items():
        out = F.when(wdl == value, text).otherwise(out)
    return out


def evaluation_sentence(cp: Column, mate: Column) -> Column:
    """From white's point of view; a forced mate goes before centipawns."""
    side = lambda x: F.when(x > 0, F.lit("White ")).otherwise(F.lit("Black "))
    bucket, text = eval_bucket(cp), F.lit(None).cast("string")
    for name, words in SENTENCES.items():
        text = F.when(bucket == name, F.concat(side(cp), F.lit(words))).otherwise(text)
    return F.when(mate.isNotNull(), F.concat(side(mate), F.lit(MATE_SENTENCE))).when(bucket == EVAL_BUCKETS[0][1], "The position is equal.").otherwise(text)


def candidate_bucket(cp: Column, mate: Column) -> Column:
    return F.when(mate.isNotNull(), "forced mate").otherwise(eval_bucket(cp))


def candidate_answer(ratings: Column) -> Column:
    """Lines of candidates, array<struct<uci, cp, mate>>, and the best, the first."""
    score = lambda r: F.when(r["mate"].isNotNull(), F.concat(F.lit("M"), r["mate"].cast("string"))).otherwise(F.concat(F.when(r["cp"] >= 0, "+").otherwise(""), r["cp"].cast("string"), F.lit("cp")))
    line = lambda r: F.concat(F.lit("Candidate "), r["uci"], F.lit(": "), score(r), F.lit("; Bucket: "), candidate_bucket(r["cp"], r["mate"]))
    best = F.concat(F.lit("Best: "), F.get(ratings, F.lit(0))["uci"])
    return F.array_join(F.concat(F.transform(ratings, line), F.array(best)), "\n")


def best_dtz_move(moves: DataFrame, position: str) -> DataFrame:
    """(position, best_move, wdl, dtz) of moves(position, move, wdl, dtz, ordinal): the
    best result; then a won position's quickest conversion, a drawn one's first move,
    a lost one's longest defence (smallest dtz)."""
    dtz = F.when(F.col("wdl") > 0, F.abs("dtz")).when(F.col("wdl") < 0, F.col("dtz")).otherwise(0)
    best = F.min_by(F.struct("move", "wdl", "dtz"), F.struct(-F.col("wdl"), dtz, F.col("ordinal"))).alias("b")
    return moves.groupBy(position).agg(best).select(position, F.col("b.move").alias("best_move"), "b.wdl", "b.dtz")


def rotate_tasks(rows: DataFrame, ordinal: Column, names: list[str]) -> DataFrame:
    """rows with task_type: names in turn by an ordinal from 0."""
    return rows.withColumn("task_type", F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(ordinal, F.lit(len(names))) + 1).cast("int")))
