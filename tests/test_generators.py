from pyspark.sql import functions as F

from plyforge.functions import chess
from plyforge.functions import chess as C
from plyforge.functions import metrics as M
from plyforge.functions.answers import special_bucket
from plyforge.operators import decontaminate as D
from plyforge.operators import generators as G
from plyforge.sources import rule_boards as RB

WITH_EP = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2"
WITHOUT = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 7"
BARE = "8/8/8/4k3/8/8/4P3/4K3 w - - 0 1"
START_960 = C.start_960(7)


def test_block_list_covers_en_passant_and_variants(spark):
    rows = spark.createDataFrame([(WITH_EP,), (C.START,), ("junk",), (None,)], "fen string")
    blocked = spark.createDataFrame([(WITHOUT, False), (BARE, True)], "fen string, is_chess960 boolean")
    assert {r["fen"] for r in G.task_rows(rows, ["1.2_board_to_fen"], blocked).collect()} == {C.START}
    # castling is gone: blocked as Chess960, out as standard chess too
    assert G.task_rows(spark.createDataFrame([(BARE,)], "fen string"), ["1.2_board_to_fen"], blocked).count() == 0


def test_answers_that_hold_a_blocked_position_go(spark):
    fens = [C.Position.parse(C.START).play(m).fen() for m in C.Position.parse(C.START).legal()]
    blocked = spark.createDataFrame([(f,) for f in fens], "fen string")
    got = G.task_rows(spark.createDataFrame([(C.START,)], "fen string"), ["1.5_state_tracking", "1.2_board_to_fen"], blocked).collect()
    assert [r["task"] for r in got] == ["1.2_board_to_fen"]


def test_rows_of_a_row(spark):
    rows = spark.createDataFrame(
        [
            (1, C.START, False, {"after_fen": WITH_EP, "note": WITH_EP, "fen_rank_row": "8"}, [("assistant", "x")]), (2, C.START, False, {}, [("user", WITHOUT), ("assistant", f"Result FEN: {WITHOUT}")]),
            (3, C.START, False, None, [("user", WITHOUT)]), (4, WITHOUT, False, {}, []), (5, None, None, None, None),
        ],
        "id int, fen string, is_chess960 boolean, metadata map<string,string>, messages array<struct<role:string,content:string>>",
    )
    keys = D.block_keys(spark.createDataFrame([(WITHOUT,), (None,)], "fen string"))
    assert {r["id"]: r["fens"] for r in D.contaminated(rows, keys, "id").collect()} == {1: [WITH_EP], 2: [WITHOUT], 4: [WITHOUT]}
    assert sorted(r["id"] for r in D.without_contaminated(rows, keys, "id").collect()) == [3, 5]
    files = rows.filter("id < 5").withColumn("path", F.lit("f")).withColumn("line", F.col("id"))
    audit = D.audit_files(files, keys).first()
    assert (audit["rows"], audit["fens"]) == (3, [WITH_EP, WITHOUT, WITHOUT])
    lines = spark.createDataFrame([(f"std:{WITHOUT}",), (WITH_EP,), ("",), (f"960:{BARE}",)], "value string")
    assert D.load_keys(lines).count() == 2


def test_prompts_messages_and_identities(spark):
    rows = G.task_rows(spark.createDataFrame([(C.START,), (BARE,)], "fen string"), ["1.7_rank_lookup", "2.1_legal_move_gen", "7.2_puzzle_solving"])
    templates = spark.createDataFrame([("1.7_rank_lookup", "{fen}|{rank}|{unknown}"), ("2.1_legal_move_gen", "{board}\n{side_to_move} {castling_rights}  ")], "task string, template string")
    contracts = spark.createDataFrame([("2.1_legal_move_gen", "Two lines.")], "task string, contract string")
    got = {(r["task"], r["fen"]): r for r in G.training_rows(rows, templates, contracts).collect()}
    assert len(got) == 4 and len({r["metadata"]["example_identity"] for r in got.values()}) == 4
    rank = got["1.7_rank_lookup", BARE]
    assert [m["role"] for m in rank["messages"]] == ["system", "user", "assistant"] and rank["messages"][1]["content"] == f"{BARE}|{rank['metadata']['rank']}|{{unknown}}"
    text = got["2.1_legal_move_gen", C.START]["messages"][1]["content"]
    assert text.startswith("8 r n b q") and text.endswith("\nwhite KQkq\n\nTwo lines.") and got["2.1_legal_move_gen", BARE]["tier"] == 2
    again = G.training_rows(rows, templates, contracts).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_caps_variants_and_self_scores(spark):
    rows = spark.createDataFrame([(C.START, False), (START_960, True), (START_960, False), (BARE, None)], "fen string, is_chess960 boolean")
    made = G.task_rows(rows, ["2.1_legal_move_gen", "2.9_legal_moves_by_piece", "3.8_hanging_piece_claim_verification"], per_task=2)
    assert {r["task"]: r["count"] for r in made.groupBy("task").count().collect()} == {"2.1_legal_move_gen": 2, "2.9_legal_moves_by_piece": 2, "3.8_hanging_piece_claim_verification": 2}
    every = G.task_rows(rows, ["2.9_legal_moves_by_piece"])
    # a start of Chess960 is read as one, whatever its row says
    assert every.filter("is_chess960").select("fen").distinct().count() == 1
    assert every.select(M.by_piece_scores(F.col("answer"), F.col("answer"))["per_piece_group_jaccard"].alias("s")).distinct().collect() == [(1.0,)]
    assert G.task_rows(rows.limit(0), ["2.1_legal_move_gen"]).count() == 0


def test_rule_positions(spark):
    families = tuple(f for f in RB.FAMILIES if f != "queen")
    rows = RB.rule_positions(spark, 12, families).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["kind"], []).append(r)
    assert {k: sorted(r["n_row"] for r in v) for k, v in kinds.items()} == {
        k: list(range(1, 13))
        for k in ("castling", "en_passant", "promotion", "none", "pinned_piece_exposes_king", "does_not_resolve_check", "king_would_be_in_check")
    }
    assert len({r["fen"] for r in rows}) == len(rows)
    for r in rows:
        p = chess.Position.parse(r["fen"])
        legal = {p.uci(m) for m in p.legal()}
        assert p.valid() and legal
        if r["kind"] in ("castling", "en_passant", "promotion", "none"):
            assert special_bucket(p) == r["kind"]
        else:
            assert {p.uci(m) for m in p.pseudo()} - legal
            assert p.in_check() == (r["kind"] == "does_not_resolve_check")
    again = RB.rule_positions(spark, 12, families).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_queen_positions_by_plain_search():
    found = 0
    for n in range(2 * 64**3 - 64 * 64, 2 * 64**3):
        other, queen = n // 64 % 64, n % 64
        cells = [""] * 64
        cells[63], cells[other], cells[queen] = "K", "k", "q"
        if len({63, other, queen}) < 3 or not (p := chess.Position(cells, True)).valid():
            continue
        made = RB.FAMILIES["queen"][1](n, 0)
        state = chess.check_state(p)
        assert (made[0], made[1].fen()) == (state, p.fen()) if state != "none" else made is None
        found += state == "checkmate"
    assert found


def test_special_bucket_prefers_the_rarest():
    parse = chess.Position.parse
    assert special_bucket(parse("4k3/8/8/3pP3/8/8/8/R3K2R w KQ d6 0 1")) == "en_passant"
    assert special_bucket(parse("7k/P7/8/8/8/8/8/R3K2R w KQ - 0 1")) == "promotion"
    assert special_bucket(parse("7k/8/8/8/8/8/8/R3K2R w KQ - 0 1")) == "castling"
    assert special_bucket(parse("7k/8/8/8/8/8/8/R3K2R w - - 0 1")) == "none"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_worked_out_once_and_on_all_cores(spark):
    """Once for each distinct position, not below the distinct for each row."""
    rows = spark.createDataFrame([(C.START,)] * 3, "fen string").distinct()
    plan = _plan(G.task_rows(rows, ["1.2_board_to_fen"]))
    assert plan.count("size(") == 0 and plan.index("ArrowEvalPython") < plan.index("Repartition") < plan.index("Aggregate")
    assert "ArrowEvalPython" not in plan[plan.index("Aggregate"):]
