import pytest
from pyspark.sql import functions as F

from plyforge.functions import chess as C
from plyforge.functions import metrics as M
from plyforge.operators import benchmark as B
from plyforge.operators import engine_rows as E
from plyforge.operators import mix


def test_frozen_splits(spark):
    fens = [C.START, "junk", "7k/5Q2/7K/8/8/8/8/8 b - - 0 1", "8/P7/8/8/8/8/8/4K2k w - - 0 1", None]
    rows = spark.createDataFrame([(i * 5000, f) for i, f in enumerate(fens)], "id int, fen string")
    prompts = spark.createDataFrame([("check_detection", "FEN: {fen}, {side_to_move}"), ("captures", "Takes?")], "task_type string, template string")
    table = B.freeze_split(rows, "rules", ["check_detection", "ray_walk", "captures"], "id", templates=prompts)
    frozen = table.orderBy("example_id").collect()
    # the third position has no slider: the first other task answers
    assert [(r["example_id"], r["task_type"], r["metric_type"]) for r in frozen] == [("rules_00000", "check_detection", "check_state"), ("rules_00001", "captures", "uci_set_jaccard"), ("rules_00002", "check_detection", "check_state")]
    assert frozen[1]["gold_answer"] == "No captures available." and frozen[1]["prompt"] == "Takes?" and frozen[0]["prompt"] == f"FEN: {C.START}, white"
    assert B.oracle_failures(table).count() == 0
    # answered once, not for each count and rank
    bare = B.freeze_split(rows, "rules", ["check_detection"], "id")
    assert "ArrowEvalPython" not in bare._jdf.queryExecution().optimizedPlan().toString()
    planned = spark.createDataFrame([("rules", "check_detection"), ("rules", "ray_walk")], "split string, task_type string")
    assert [tuple(r) for r in B.coverage_gaps(planned, table).collect()] == [("rules", "ray_walk")]
    assert B.manifest(table).first()["n"] == 3 and B.manifest(table).first() == B.manifest(table.orderBy(F.desc("example_id"))).first()


def test_ids_are_never_cut(spark):
    rows = spark.range(100_001).select("id", F.lit(C.START).alias("fen")).withColumn("fen", F.when(F.col("id") % 1000 == 0, F.col("fen")).otherwise("8/8"))
    many = spark.range(100_001).select(F.format_string("%05d", "id").alias("e"))
    assert many.distinct().count() == 100_001 and B.freeze_split(rows, "x", ["board_to_fen"], "id").agg(F.max("example_id")).first()[0] == "x_00100"


def test_planning_rows_get_what_they_ask_for(spark):
    rating = '{"candidate_ratings":[{"uci":"e2e4","cp":30,"pv":"e2e4 e7e5"},{"uci":"d2d4","cp":20},{"uci":"a2a3","cp":0},{"uci":"b2b3","cp":-5},{"uci":"c2c4","cp":-90}]}'
    rows = spark.createDataFrame([(0, C.START, rating, "best_line_trace"), (1, C.START, rating, None), (2, C.START, '{"puzzle_id":"x","solution_first_move":"g1f3"}', None), (3, C.START, '{"best_move":"e2e5"}', None)], "id int, fen string, extra string, task_type string")
    got = {r["task_type"]: r["gold_answer"] for r in B.freeze_split(rows, "planning", None, "id").collect()}
    assert set(got) == {"best_line_trace", "candidate_ratings", "puzzle_solve"} and got["puzzle_solve"] == "g1f3"
    assert got["best_line_trace"] == "<think>\nRoot: e2e4\nEval: +30cp; Bucket: equal\nPV: e2e4 e7e5\nBest: e2e4\n</think><move>e2e4</move>"
    assert got["candidate_ratings"].endswith("Candidate c2c4: -90cp; Bucket: slight edge\nBest: e2e4")


def test_weighted_choice_follows_weights(spark):
    moves = spark.range(3000).select("id", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.lit(3).alias("w")), F.struct(F.lit("b").alias("m"), F.lit(1).alias("w")), F.struct(F.lit("c").alias("m"), F.lit(0).alias("w")))).alias("x")).select("id", "x.*")
    drawn = {r["m"]: r["count"] for r in B.choose_weighted(moves, "id", "m", "w", 1).groupBy("m").count().collect()}
    assert set(drawn) == {"a", "b"} and 0.71 < drawn["a"] / 3000 < 0.79


def test_engine_rows(spark):
    rows = spark.createDataFrame([(2, 20, None), (-2, -700, None), (5, 100, -3), (0, -100, None)], "wdl int, cp int, mate int")
    got = rows.select(E.wdl_label(F.col("wdl")).alias("w"), E.evaluation_sentence(F.col("cp"), F.col("mate")).alias("e"), E.candidate_bucket(F.col("cp"), F.col("mate")).alias("b")).collect()
    assert [r["w"] for r in got] == ["Win for the side to move.", "Loss for the side to move.", "WDL value: 5", "Draw with best play."]
    assert [r["e"] for r in got] == ["The position is equal.", "Black has a decisive advantage.", "Black has a decisive advantage (forced mate).", "Black has a slight edge."]
    assert [r["b"] for r in got] == ["equal", "decisive", "forced mate", "slight edge"]
    text = spark.sql("select array(named_struct('uci', 'e2e4', 'cp', 30, 'mate', null), named_struct('uci', 'd2d4', 'cp', -60, 'mate', null)) as r").select(E.candidate_answer(F.col("r")).alias("t")).first()["t"]
    assert text == "Candidate e2e4: +30cp; Bucket: equal\nCandidate d2d4: -60cp; Bucket: slight edge\nBest: e2e4"
    five = "\n".join(f"Candidate {m}: +30cp; Bucket: equal" for m in ("e2e4", "d2d4", "a2a3", "b2b3", "c2c3")) + "\nBest: e2e4"
    assert spark.createDataFrame([(five,)], "t string").select(M.candidate_scores(F.col("t"), F.col("t"))["primary"].alias("p")).first()["p"] == 1.0


def test_best_tablebase_moves(spark):
    rows = [("w", "a", 2, 9, 0), ("w", "b", 2, 3, 1), ("w", "c", 0, 0, 2), ("d", "x", 0, 0, 0), ("d", "y", 0, 0, 1), ("l", "p", -2, -4, 0), ("l", "q", -2, -10, 1)]
    got = E.best_dtz_move(spark.createDataFrame(rows, "pos string, move string, wdl int, dtz int, ordinal int"), "pos").collect()
    assert {r["pos"]: r["best_move"] for r in got} == {"w": "b", "d": "x", "l": "q"}


def test_checked_inputs(spark):
    assert len(mix.checked_schedule([("a", 0.4, {1: 1.0, 2: 0.0}), ("b", 0.6, {1: 0.5, 3: 0.5})])) == 3
    for bad in ([], [("a", 1.0, {})], [("a", 0.5, {1: 1}), ("a", 0.5, {1: 1})], [("a", 0.5, {1: 1})]):
        with pytest.raises(ValueError):
            mix.checked_schedule(bad)
    with pytest.raises(ValueError):
        mix.checked_fractions({"a": 0.7, "b": 0.6})
    assert mix.replay_share({1: 1.0, 2: 1.0, 3: 2.0}) == 0.5
