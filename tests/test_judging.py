from pyspark.sql import functions as F

from plyforge.functions import chess as C
from plyforge.functions import traces as T
from plyforge.operators import judging as J


def test_judgments_and_repairs(spark):
    prompts = spark.createDataFrame([("p", C.START, "best_move", "Find the move.", "e2e4"), ("q", None, "best_move", "?", "e2e4"), ("r", "8/8/8/8/8/8/8/8 w - - 0 1", "best_move", "?", "")], "prompt_id string, fen string, task_type string, user string, gold string")
    outputs = spark.createDataFrame(
        [("1", "p", "m", "<move>e2e4</move>"), ("2", "p", "m", "I like e2e5"), ("3", "p", "m", "no idea"), ("4", "q", "m", "e2e4"), ("5", "r", "m", "e2e4"), ("6", "p", "m", "a2a3"), ("7", "none", "m", "x")],
        "rollout_id string, prompt_id string, model_id string, raw_output string",
    )
    judged = J.judge(J.rollouts(prompts, outputs))
    got = {r["rollout_id"]: (r["failure_bucket"], r["legal"]) for r in judged.collect()}
    assert got == {"1": ("legal_unscored", True), "2": ("illegal_move", False), "3": ("parse_failure", False), "4": ("missing_fen", None), "5": ("invalid_fen", None), "6": ("legal_unscored", True)}
    scored = J.with_regret(judged.withColumn("teacher", F.lit("e2e4")).withColumn("best", F.lit(40)).withColumn("own", F.lit(-30)), "best", "own", "teacher")
    assert {r["rollout_id"]: r["regret_cp"] for r in scored.collect()} == {"1": 0.0, "2": None, "3": None, "4": None, "5": None, "6": 70.0}
    assert {r["rollout_id"]: r["failure_bucket"] for r in scored.collect()}["6"] is None


def refreshed(spark, judged, **more):
    rows = spark.createDataFrame(judged, "ordinal int, judgment_id string, rollout_id string, legal boolean, failure_bucket string, regret_cp double, teacher_move_uci string")
    rolled = spark.createDataFrame([(f"r{i}", "gone" if i == 8 else f"p{i}", "m", "raw", "a2a3") for i in range(9)], "rollout_id string, prompt_id string, model_id string, raw_output string, parsed_move string")
    fens = {4: "8/8/8/8/8/8/8/8 w - - 0 1", 5: ""}
    prompts = spark.createDataFrame(
        [(f"p{i}", fens.get(i, C.START), False, "eval_bucket" if i == 3 else "best_move", " " if i == 6 else "Move?", "e2e4" if i != 7 else "e2e4 or d2d4") for i in range(8)],
        "prompt_id string, fen string, is_chess960 boolean, task_type string, user_prompt string, gold_answer string",
    )
    return J.refresh_rows(rows, rolled, prompts, **more)


def test_refresh_tasks_and_reasons(spark):
    judged = [
        (0, "a", "r0", False, "parse_failure", None, None), (1, "b", "r0", False, "illegal_move", None, None), (2, "c", "r0", True, None, 150.0, "e2e4"),
        (3, "d", "r0", True, None, 50.0, "e2e4"), (4, "e", "r0", True, "legal_unscored", None, None), (5, "f", "none", False, "parse_failure", None, None),
        (6, "g", "r8", False, "parse_failure", None, None), (7, "h", "r3", False, "parse_failure", None, None), (8, "i", "r4", False, "illegal_move", None, None),
        (9, "j", "r5", False, "illegal_move", None, None), (10, "k", "r6", False, "illegal_move", None, None), (11, "l", "r7", False, "illegal_move", None, None),
        (12, "m", "r1", True, None, 150.0, None), (13, "n", "r1", False, "parse_failure", None, "a2a3"), (14, "o", "r1", False, "illegal_move", None, "a2a3"), (15, "p", "r0", True, None, None, None),
    ]
    got = {r["judgment_id"]: (r["task"][:3] if r["reason"] is None else r["reason"]) for r in refreshed(spark, judged).collect()}
    assert got == {
        "a": "7.4", "b": "7.5", "c": "duplicate", "d": "low_regret", "e": "legal_unscored", "f": "missing_rollout", "g": "missing_prompt", "h": "non_move_task", "i": "invalid_fen",
        "j": "missing_fen", "k": "missing_prompt_text", "l": "missing_target_move", "m": "missing_target_move", "n": "7.4", "o": "target_equals_model_move", "p": "unscored_legal",
    }
    capped = {r["judgment_id"]: r["reason"] for r in refreshed(spark, judged, cap=2).collect()}
    assert capped["a"] is None and capped["b"] is None and {v for k, v in capped.items() if k > "b"} == {"max_examples"}
    kept = refreshed(spark, judged)
    # joined and judged once, not for each step that follows
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().optimizedPlan().toString()
    rows = J.repair_rows(kept).collect()
    assert sorted(r["task"][:3] for r in rows) == ["7.4", "7.4", "7.5"] and all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] for r in rows)
    assert all("Previous answer:\nraw" in r["messages"][1]["content"] and r["messages"][2]["content"].endswith(f"<move>{r['metadata']['target_move_uci']}</move>") for r in rows)
    blocked = spark.createDataFrame([(C.START,)], "fen string")
    assert {r["reason"] for r in refreshed(spark, judged[:3], blocked=blocked).collect()} == {"blocklisted_fen"}


def test_review_takes_the_last_judgment(spark):
    rolled = spark.createDataFrame([("r", "p"), ("s", "q")], "rollout_id string, prompt_id string")
    prompts = spark.createDataFrame([("p", "f", "t")], "prompt_id string, fen string, task_type string")
    judged = spark.createDataFrame([(1, "a", "r", True, None, 1.0), (2, "b", "r", False, "x", 2.0)], "ordinal int, judgment_id string, rollout_id string, legal boolean, failure_bucket string, regret_cp double")
    got = {r["rollout_id"]: (r["prompt"], r["judgment"]) for r in J.review(rolled, prompts, judged, "ordinal").collect()}
    assert got["r"][1]["judgment_id"] == "b" and got["r"][0]["fen"] == "f" and got["s"] == (None, None)


def test_faults(spark):
    text = "\n".join(["Candidate e2e4: +30cp; Bucket: equal", "Candidate d2d4: -10cp; Bucket: equal", "Candidate a2a3: +0cp; Bucket: equal", "Candidate b2b3: M2; Bucket: forced mate", "Candidate c2c3: -5cp; Bucket: equal", "Best: e2e4"])
    other = "Values: x\nBalance: Material is equal.\nAll legal moves: e2e4 d2d4"
    rows = spark.createDataFrame([(0, text), (1, other), (2, "nothing here")], "i int, t string").select(
        "i", *[f(F.col("t")).alias(n) for n, f in (("best", T.wrong_best), ("bucket", T.wrong_bucket), ("sign", T.flipped_sign), ("bad", T.malformed), ("balance", T.wrong_balance), ("final", lambda t: T.wrong_final_set(t, "All legal moves:")))]
    ).orderBy("i").collect()
    line = lambda r, k: (r[k]["text"].split("\n")[r[k]["faulty_line"] - 1], r[k]["correction"])
    assert [line(rows[0], k) for k in ("best", "bucket", "sign", "bad")] == [
        ("Best: d2d4", "Best should be e2e4."), ("Candidate e2e4: +30cp; Bucket: decisive", "Candidate e2e4 bucket should be equal."),
        ("Candidate e2e4: -30cp; Bucket: equal", "Candidate e2e4 score should be +30cp."), ("Candidate e2e4 +30cp; Bucket: equal", "Line should be `Candidate e2e4: +30cp; Bucket: equal`."),
    ]
    assert [line(rows[1], k)[0] for k in ("balance", "final")] == ["Balance: White is ahead by 99.", "All legal moves: none"]
    assert all(v is None for k, v in rows[2].asDict().items() if k != "i")


def test_every_case_scores_itself(spark):
    from plyforge.functions import metrics as M

    text = "\n".join([*(f"Candidate {m}: +{n}cp; Bucket: equal" for n, m in enumerate(("e2e4", "d2d4", "a2a3", "b2b3", "c2c3"))), "Best: e2e4"])
    rows = spark.createDataFrame([("7.8_candidate_ratings", text), ("2.10_ray_walk", "Piece: a1.\nMoves from rays: none"), ("2.10_ray_walk", "Piece: a1.\nMoves from rays: a1a2"), ("other", "x")], "task string, answer string")
    got = T.verification_cases(rows).withColumn("s", M.step_scores(F.col("expected_answer"), F.col("expected_answer"))["primary"]).collect()
    assert len(got) == 5 + 2 and all(r["s"] == 1.0 for r in got)
    assert all(r["verification_trace"].startswith("1. ") for r in got) and {r["faulty_line"] for r in got if r["verification_verdict"] == "sound"} == {"none"}


def test_a_fault_is_worked_out_once(spark):
    """Each cuts the trace into lines once, however often their places are named."""
    for made in (T.wrong_balance, T.wrong_best, T.wrong_bucket, T.flipped_sign, T.malformed):
        assert str(made(F.col("t"))).count("split(t") == 1
