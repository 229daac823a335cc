from plyforge.functions import chess as C
from plyforge.sources import positions as S


def test_games_and_their_positions(spark):
    raw = spark.createDataFrame(
        [(1, "1. e4 {best} e5 2. Nf3 1-0", 1500, "1400"), (2, "e4", 1000, "2000"), (3, "", 2000, "2000"), (4, "e2e4 e7e5 junk", 2000, "2000"), (5, "d4", None, "2000")],
        "id int, movetext string, WhiteElo int, BlackElo string",
    )
    rows = S.games(raw, "id").orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 4]
    assert [r["id"] for r in S.games(raw, "id", cap=1).collect()] == [1]
    got = S.game_positions(S.games(raw, "id").filter("id = 1")).orderBy("ply").collect()
    assert [(r["ply"], r["move_played_uci"], r["move_history"]) for r in got] == [(0, "e2e4", ""), (1, "e7e5", "e2e4"), (2, "g1f3", "e2e4 e7e5")]
    assert got[0]["fen"] == C.START and got[0]["game_phase"] == "opening" and got[0]["material_balance"] == 0


def test_puzzles(spark):
    fen = "r1bqkb1r/pppp1ppp/2n2n2/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR b KQkq - 5 4"
    raw = spark.createDataFrame([("a", fen, "d7d6 h5f7", 900, "mateIn1 short"), ("b", fen, "d7d6 h5h8", 900, "fork"), ("c", fen, "d7d6 h5f7", 3000, "fork")], "PuzzleId string, FEN string, Moves string, Rating int, Themes string")
    got = S.puzzles(raw, 500, 2000).collect()
    assert [(r["puzzle_id"], r["side"], r["solution_full"], r["themes"]) for r in got] == [("a", "white", ["h5f7"], ["mateIn1", "short"])]
    assert S.puzzles(raw, 500, 2000, ["fork"]).count() == 0


def test_evals(spark):
    start = C.START
    rows = [(start, "e4 e7e5", 30, 10, 20, None, 1), (start, "d2d4", 30, 10, 5, None, 2), (start, "a2a3", 25, 99, 5, None, 3), (start, "a2a4", 10, 1, 5, None, 4), ("8/8/8/8/8/8/8/K1k5 w - -", "a1a2", 22, 1, 300, 3, 5)]
    rows += [(start, "e2e5", 60, 10, 20, None, 6), ("junk", "e2e4", 60, 1, 1, None, 7), (start, " ", 60, 1, 1, None, 8)]
    raw = spark.createDataFrame(rows, "fen string, line string, depth int, knodes int, cp int, mate int, id int")
    best = S.evals(raw, "id")
    assert {r["fen"]: (r["best_move"], r["pv_line"], r["id"]) for r in best.collect()} == {start: ("e2e4", "e2e4 e7e5", 1), "8/8/8/8/8/8/8/K1k5 w - -": ("a1a2", "a1a2", 5)}
    classes = sorted((r["id"], r["class"]) for r in S.eval_classes(best).collect())
    assert classes == [(1, "balanced"), (1, "best_move"), (5, "endgame"), (5, "high_eval"), (5, "mate")]


def test_openings_and_books(spark):
    raw = spark.createDataFrame([("C20", "King's Pawn", "e2e4 e7e5", None), ("B00", "Pawn", "e2e4", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"), ("X", "bad", "e2e5", None)], "eco string, name string, uci string, epd string")
    opened = S.openings(raw)
    assert sorted((r["eco"], r["epd_mismatch"]) for r in opened.collect()) == [("B00", True), ("C20", False)]
    assert sorted((r["uci"], r["weight"]) for r in S.book_moves(opened).collect()) == [("e2e4", 2), ("e7e5", 1)]


def test_move_choices(spark):
    text = f'The FEN is "{C.START}" MoveA: e2e4, MoveB: d2d4'
    raw = spark.createDataFrame([(text, "MoveA: e2e4"), (text, "MoveB: e2e4"), (text.replace("d2d4", "d2d5"), "MoveA: e2e4"), ("nothing", "MoveA: e2e4")], "input string, output string")
    assert [tuple(r) for r in S.move_choices(raw).collect()] == [(C.START, "e2e4", "d2d4", "e2e4")]
