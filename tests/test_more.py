import random

import pytest
from pyspark.sql import functions as F

from plyforge.functions import answers as A
from plyforge.functions import chess as C
from plyforge.functions import traces as T
from plyforge.operators import eval_splits as E
from plyforge.operators import generators as G
from plyforge.operators import reports as R
from plyforge.operators import validate as V
from plyforge.plans import boards as BD
from plyforge.plans import reports
from plyforge.sources import sampling as S
from plyforge.streaming import append, games

MID = "r1bqkb1r/pppp1ppp/2n2n2/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR w KQkq - 4 4"
EXTRA = '{"solution_first_move":"h5f7","themes":["fork"],"rating":1500,"best_move":"h5f7","cp":40,"pv_line":"h5f7 e8e7","move_played_uci":"h5f7","move_history":"e2e4","candidate_ratings":[{"uci":"h5f7","cp":1,"pv":"h5f7"},{"uci":"b1c3","cp":1},{"uci":"a2a3","cp":1},{"uci":"a2a4","cp":1},{"uci":"b2b3","cp":1}]}'


def made(spark, tasks=None):
    rows = spark.createDataFrame([(MID, EXTRA), (C.START, None), ("8/8/8/4k3/3q4/8/4R3/4K2R w K - 0 1", None)], "fen string, extra string")
    own = G.task_rows(rows, sorted(tasks or A.TASKS))
    return G.training_rows(own, spark.createDataFrame([(t, "FEN: {fen}") for t in A.TASKS], "task string, template string"))


def test_generated_rows_are_valid(spark):
    checked = V.row_errors(made(spark)).collect()
    assert len(checked) > 100 and {r["task"]: r["errors"] for r in checked if r["errors"]} == {}
    assert {r["task"] for r in checked} >= set(A.SETTLED) - {"2.11_legal_filter_trace"}


def test_changed_rows_are_not(spark):
    rows = made(spark, ["1.7_rank_lookup", "2.3_move_legality_check", "7.1_best_move_selection", "7.8_candidate_ratings", "7.10_best_line_trace", "7.11_history_best_move"]).filter(F.col("fen") == MID)
    swap = lambda a, b: F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", F.replace(m["content"], F.lit(a), F.lit(b))).otherwise(m["content"]).alias("content")))
    errors = lambda df: {r["task"]: set(r["errors"]) for r in V.row_errors(df).collect()}
    got = errors(rows.withColumn("messages", swap("h5f7", "h5h1")))
    assert got["7.1_best_move_selection"] == {"illegal_move", "move_differs_from_target"} and got["7.11_history_best_move"] == {"illegal_move", "move_differs_from_target"}
    assert {"illegal_candidate", "move_differs_from_target", "candidates_differ_from_metadata"} <= got["7.8_candidate_ratings"] and "illegal_line" in got["7.10_best_line_trace"]
    got = errors(rows.withColumn("messages", swap("rank", "Rank")).withColumn("tier", F.lit(3)))
    assert got["1.7_rank_lookup"] == {"tier_differs_from_task", "answer_differs_from_expected"}
    got = errors(rows.withColumn("fen", F.lit("8/8/8/8/8/8/8/8 w - - 0 1")).withColumn("messages", swap("<think>", "{open}")))
    assert got["7.1_best_move_selection"] == {"invalid_fen", "unfilled_placeholder", "bad_move_format"} and got["2.3_move_legality_check"] == {"invalid_fen"}
    got = errors(rows.withColumn("metadata", F.create_map(F.lit("rank"), F.lit("9"))))
    assert got["1.7_rank_lookup"] == {"fields_do_not_fit_the_position"}
    empty = rows.select("task", "tier", "fen", "is_chess960", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), F.lit(None).cast("map<string,string>").alias("metadata"))
    assert all({"missing_messages", "missing_assistant_answer"} <= e for e in errors(empty).values())


def test_every_task_is_validated(spark, tmp_path):
    spark.range(12, 36).selectExpr("nullif(id, 20) as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    boards = BD.boards(spark, str(tmp_path), "supplier", "s_suppkey").select("fen").distinct().count()
    got = {r["task"]: (r["n"], r["wrong"]) for r in reports.validated_rows(spark, str(tmp_path)).collect()}
    assert set(got) == {*A.TASKS, G.STEPS} and all(wrong == 0 for _, wrong in got.values())
    assert {got[t][0] for t in ("1.1_fen_to_board", "4.1_material_balance", "4.3_pawn_structure", "6.1_endgame_classification", "6.4_endgame_principles", "7.10_best_line_trace")} == {boards}


def test_rows_of_broken_traces(spark):
    rows = G.step_rows(G.task_rows(spark.createDataFrame([(MID, EXTRA)], "fen string, extra string"), sorted(T.CASES)))
    kinds = {(r["fields"]["source_task"], r["fields"]["corruption_kind"]): r["answer"] for r in rows.collect()}
    assert len(kinds) == rows.select("example_identity").distinct().count() == rows.count() and {t for t, _ in kinds} == {"1.18_material_balance_trace", "7.8_candidate_ratings"}
    assert kinds["1.18_material_balance_trace", "material_balance_sound"].startswith("Verdict: sound\nFaulty line: none")
    made = G.training_rows(rows, spark.createDataFrame([(G.STEPS, "{verification_trace}")], "task string, template string"))
    assert V.row_errors(made).filter("size(errors) > 0").count() == 0
    other = made.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "correction"), F.create_map(F.lit("correction"), F.lit("x"))))
    assert {tuple(r["errors"]) for r in V.row_errors(other).collect()} == {("answer_differs_from_expected",)}


def test_losses_and_rates(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 3}", float(rng.choice((0, 0, 5, 17, rng.randint(0, 1000))))) for i in range(500)] + [("g0", None)]
    got = {(r["g"], r["metric"]): r["value"] for r in R.acpl_summary(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("g0", "g1", "g2", None):
        own = sorted(v for k, v in rows if v is not None and g in (k, None))
        rank = lambda q: own[max(0, -(-int(q * len(own) * 100) // 100) - 1)]
        assert got[g, "acpl"] == pytest.approx(sum(own) / len(own)) and got[g, "acpl_median"] == own[-(-len(own) // 2) - 1]
        assert got[g, "acpl_p90"] == own[-(-len(own) * 9 // 10) - 1] and got[g, "acpl_p95"] == own[-(-len(own) * 95 // 100) - 1] and rank(0) == own[0]
    scores = spark.createDataFrame([("t", "p", 0.5, 1.0, True), ("t", "p", 0.7, 0.0, False), ("t", "q", None, 0.4, None)], "t string, p string, wpd double, reward double, cache_hit boolean")
    got = {r["metric"]: r["value"] for r in R.wpd_summary(scores, ["t"], "p").collect()}
    assert got == {"wpd": pytest.approx(0.6), "reward": pytest.approx(1.4 / 3), "cache_hit_rate": 0.5, "reward_std_per_prompt": 0.25}


def test_reports(spark):
    rows = spark.createDataFrame([("1.1_a", True, True), ("1.2_b", False, False), ("2.1_c", False, True)], "task string, is_chess960 boolean, passed boolean")
    stats = {r["task"]: (r["target"], r["total"], r["passed"], r["failed"]) for r in R.task_stats(rows, spark.createDataFrame([("1.1_a", 5)], "task string, target int")).collect()}
    assert stats == {"1.1_a": (5, 1, 1, 0), "1.2_b": (0, 1, 0, 1), "2.1_c": (0, 1, 1, 0)}
    mix = {r["tier"]: (r["target"], r["actual"], r["delta"]) for r in R.chess960_mix(rows, spark.createDataFrame([(1, 0.3)], "tier int, ratio double")).collect()}
    assert mix == {1: (0.3, 0.5, 0.2), 2: (0.0, 0.0, 0.0)}
    metrics = spark.createDataFrame([("planning.best_move_acpl", 80.0), ("acc", 0.9), ("rules.acc", 0.1)], "key string, value double")
    checks = spark.createDataFrame([("a", "acc", 0.8, None), ("b", "acpl", None, 50.0), ("c", "wpd", None, None)], "name string, metric string, at_least double, at_most double")
    fields = spark.createDataFrame([("source_task", 2), ("error_type", 1), ("corruption_kind", 0)], "field string, n int")
    got = {r["name"]: (r["value"], r["passed"], r["reason"]) for r in R.gate_report(metrics, checks, fields).collect()}
    assert got == {"a": (0.9, True, "present"), "b": (80.0, False, "threshold"), "c": (None, False, "missing_metric"), "step_verification_metadata_breakdowns": (None, False, "missing: corruption_kind")}
    need = R.readiness(spark.createDataFrame([("x", 5)], "source string, rows int"), spark.createDataFrame([("x", 4), ("y", 1)], "source string, needed int"))
    assert {r["source"]: (r["rows"], r["ready"]) for r in need.collect()} == {"x": (5, True), "y": (0, False)}


def test_eval_splits(spark):
    assert E.effective_sizes({"a": 9, "b": 2}, 5) == {"a": 5, "b": 2} and E.effective_sizes({"a": 9}) == {"a": 9}
    assert E.reserve({"perception": 6, "rules": 6, "x": 9}, [(("perception", "rules"), 12)], 4) == {"perception": 6, "rules": 2, "x": 9}
    fens = [C.Position.parse(C.START)]
    for i in range(60):
        fens.append(S.played_on(fens[0], 1 + i % 7, i)[0])
    checks = ["4k3/8/8/8/8/8/8/4R1K1 b - - 0 1", "4k3/8/8/8/8/8/4R3/6K1 b - - 0 1", "7k/5Q2/7K/8/8/8/8/8 b - - 0 1", "7k/6Q1/7K/8/8/8/8/8 b - - 0 1"]
    rows = [(C.variant_key(f), f) for f in {*(p.fen() for p in fens), *checks}]
    pool = spark.createDataFrame(rows, "pos_key string, fen string")
    got = E.generate_splits({"perception": pool, "rules": pool}, {"perception": 10, "rules": 20, "gone": 3}, 7).collect()
    assert len(got) == 30 and len({r["pos_key"] for r in got}) == 30
    left = pool.join(spark.createDataFrame([(r["pos_key"],) for r in got if r["split"] == "perception"], "pos_key string"), "pos_key", "left_anti")
    states = [r["s"] for r in spark.createDataFrame([(r["fen"],) for r in got if r["split"] == "rules"], "fen string").select(E.state(F.col("fen")).alias("s")).collect()]
    had = [r["s"] for r in left.select(E.state(F.col("fen")).alias("s")).collect()]
    for state, want in (("check", 2), ("checkmate", 1), ("stalemate", 1)):
        assert states.count(state) >= min(want, had.count(state))
    marked = pool.withColumn("source", F.when(F.col("fen") == C.START, "self_play")).withColumn("is_chess960", F.lit(None).cast("boolean"))
    sources = E.build_sources(marked, pool, pool.withColumn("depth", F.lit(20)), pool, pool, pool, pool, 30)
    assert sources["rules"].count() == len(rows) - 1 and sources["evaluation"].count() == 0 and sources["chess960"].count() == 0
    rated = spark.range(9).select("id", F.when(F.col("id") < 7, F.array_repeat(F.lit("e2e4"), 5)).alias("candidate_ratings"))
    assert {r["count"] for r in E.planning_sources(rated, "id").groupBy("task_type").count().collect()} == {2, 3}
    opened = spark.createDataFrame([("A00", "f"), ("B00", "g")], "eco string, fen string")
    known = spark.createDataFrame([("f", "e2e4", 1), ("f", "d2d4", 5)], "fen string, uci string, weight int")
    assert [m["uci"] for m in E.opening_sources(opened, opened.filter("eco = 'A00'"), known).first()["book_moves"]] == ["d2d4", "e2e4"]


def test_sampled_positions(spark):
    got = S.chess960_positions(spark, 40, 6, 3).collect()
    assert len(got) == 40 and all(C.Position.parse(r["fen"], True).valid() and r["chess960_id"] != 518 and r["n_moves_applied"] <= 6 for r in got) and len({r["fen"] for r in got}) > 30
    assert S.starts_960(spark).filter("chess960_id = 518").first()["fen"] == C.START and S.starts_960(spark).select("fen").distinct().count() == 960
    ends = S.endgame_positions(spark, ["KRPKR", "KPK"], 15, 2).collect()
    assert len(ends) == 30 and all(C.Position.parse(r["fen"]).valid() and A.signature(C.Position.parse(r["fen"])) == r["material"] for r in ends)
    assert S.material_of("KRPKR") == ("KRP", "KR") and S.chess960_target(1000) == 5000 and S.chess960_target(1000, 10, 0.2, 3) == 253


def test_book_lines_and_lists(spark):
    p = C.Position.parse(C.START)
    after = p.play(p.find("e2e4")).fen()
    moves = spark.createDataFrame([(C.START, "e2e4", 5), (C.START, "d2d4", 0), (after, "e7e5", 1), (after, "e7e6", 1)], "fen string, uci string, weight int")
    starts = spark.range(20).select(F.col("id").alias("line"), F.lit(C.START).alias("fen"))
    lines = S.book_lines(starts, moves, 5, 1).collect()
    assert len(lines) == 20 and {tuple(r["moves"]) for r in lines} == {("e2e4", "e7e5"), ("e2e4", "e7e6")} and all(C.Position.parse(r["final_fen"]).valid() for r in lines)
    files = spark.createDataFrame([("file:/b/zed.bin",), ("file:/b/Alpha.bin",), ("file:/b/best.bin",), ("file:/b/x.txt",)], "path string")
    assert [(r["name"], r["curated"]) for r in S.books(files, ["none.bin", "best.bin"]).orderBy("rank").collect()] == [("best.bin", True), ("Alpha.bin", False), ("zed.bin", False)]
    hrefs = ["3-4-5/", "../", "/", "a/b/", "http://x/y/", "x/?q", "KQvK.rtbw", "KQvK.rtbz", "dir/KQvK.rtbw", ".hid.rtbw", "a%2Fb.rtbw", "KRvK.txt", "%2E%2E/", "a+b/"]
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", S.safe_dir(F.col("h")).alias("d"), S.safe_file(F.col("h")).alias("f"), S.piece_count(F.col("h")).alias("n")).collect()
    assert {r["h"]: r["d"] for r in got if r["d"]} == {"3-4-5/": "3-4-5/", "a+b/": "a+b/"} and [r["f"] for r in got if r["f"]] == ["KQvK.rtbw", "KQvK.rtbz"]
    assert next(r["n"] for r in got if r["h"] == "KQvK.rtbw") == 3
    line = spark.createDataFrame([(C.START, "e4 e7e5 Nf3"), (C.START, "e4 e4"), (C.START, "")], "f string, l string").select(S.pv_line(F.col("f"), F.col("l")).alias("p")).collect()
    assert [r["p"] for r in line] == ["e2e4 e7e5 g1f3", None, None]


def test_self_play_rows(spark, tmp_path):
    assert S.self_play_positions(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "run1").mkdir()
    row = '{"fen":"f","move_played_uci":"e2e4","game_phase":"opening","material_balance":0,"ply":1,"game_id":"g","mover":"m","model_id":"x","run_id":"r"}'
    (tmp_path / "run1" / "positions.jsonl").write_text(f"{row}\nnot json\n\n{row.replace(chr(34) + 'ply' + chr(34) + ':1,', '')}\n")
    assert S.self_play_positions(spark, f"file://{tmp_path}").count() == 1


def test_output_grows_by_unseen_rows(spark, tmp_path):
    table, rows = f"file://{tmp_path}/t", lambda a, b: spark.range(a, b).select(F.concat(F.lit("i"), F.col("id") % 50).alias("identity"), (F.col("id") % 50).alias("v"))
    order = F.sha2(F.col("identity"), 256)
    assert append.extend_output(spark, table, rows(0, 30), "identity", 10, order) == {"previous": 0, "appended": 10, "final": 10, "duplicates": 0}
    first = {r["identity"] for r in append.read_output(spark, table, rows(0, 1).schema).collect()}
    assert append.extend_output(spark, table, rows(0, 60), "identity", 40, order)["appended"] == 30
    now = [r["identity"] for r in append.read_output(spark, table, rows(0, 1).schema).collect()]
    assert len(now) == len(set(now)) == 40 and first <= set(now)
    assert append.extend_output(spark, table, rows(0, 5), "identity", 20, order)["appended"] == 0
    for bad in (rows(0, 50).withColumn("identity", F.lit(None).cast("string")), rows(0, 10)):
        with pytest.raises(ValueError):
            append.extend_output(spark, table, bad, "identity", 100, order)
    assert append.read_output(spark, table, rows(0, 1).schema).count() == 40
    assert append.candidate_budget(100, 90) == 190 and append.candidate_budget(100, 0) == 400 and append.candidate_budget(5, 9) == 5


def test_games_end_by_streaks_and_length(spark, tmp_path):
    moves = [("a", i, 900.0) for i in range(9)] + [("b", i, 900.0 if i % 2 else -900.0) for i in range(8)] + [("c", i, None) for i in range(12)] + [("d", i, -1000.0 if i > 1 else 0.0) for i in range(6)]
    schema = "game_id string, ply int, white_cp double"
    for part in (0, 1):
        spark.createDataFrame([m for m in moves if (m[1] >= 4) == bool(part)], schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{part}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
        out = games.adjudicate(stream, 800.0, 4, 10)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["game_id"], r["ply"]): (r["streak"], r["result"], r["termination"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for g in "abcd":
        state = (0, 0, 0, "", "")
        for _, ply, value in sorted(m for m in moves if m[0] == g):
            if not state[3]:
                state = games.step(state, ply, value, 800.0, 4, 10)
                want[g, ply] = (state[2], state[3] or None, state[4] or None)
    assert got == want and got["a", 3][1:] == ("1-0", "adjudicated") and got["c", 9][1:] == ("*", "max_plies") and got["d", 5][1:] == ("0-1", "adjudicated") and ("a", 4) not in got
