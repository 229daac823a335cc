import pytest
from pyspark.sql import functions as F

from plyforge.functions import chess as C
from plyforge.functions import metrics as M
from plyforge.functions import protocol as P

CASES = [
    ("exact_match", " E4 ", "e4", 1.0), ("exact_match", None, "x", 0.0),
    ("jaccard", "a b", "b c", 1 / 3), ("jaccard", "", "", 1.0),
    ("uci_set_jaccard", "e2e4 d2d4", "e2e4", 0.5), ("uci_set_jaccard", "no legal moves", "", 1.0), ("uci_set_jaccard", "e2e4", "No captures available.", 0.0),
    ("opening_name", "The opening is Sicilian Defense: Najdorf", "sicilian defense, dragon (ECO: B70)", 1.0), ("opening_name", "ECO: B20", "ECO: B29", 1.0), ("opening_name", "Ruy Lopez", "French", 0.0),
    ("check_state", "It is check", "Check.", 1.0), ("check_state", "No check here", "Normal position", 1.0), ("check_state", "not checkmate but check", "checkmate", 0.0),
    ("eval_bucket", "White has a slight edge.", "white: slight", 1.0), ("eval_bucket", "equal", "White is winning.", 0.0),
    ("special_rules", "Castling kingside is available. No en passant.", "Castle kingside.", 1.0), ("special_rules", "Promotion: a7a8q.", "promotes a7a8n", 0.0),
    ("side_piece_inventory", "e1 white king; a1 white rook", "e1 white king", 2 / 3),
    ("hanging_f1", "Hanging pieces: white knight on c3.", "Hanging pieces: white knight on c3, black rook on a8.", 2 / 3), ("hanging_f1", "", "No hanging pieces", 1.0),
    ("threat_f1", "White threatens: pawn on e5, rook on a8.", "White threatens: rook on a8.", 2 / 3), ("threat_f1", "", "White has no immediate threats.", 1.0),
    ("continuation_rank", "d2d4 then e2e4", "e2e4 (60%), d2d4 (30%)", 0.5), ("continuation_rank", "e2e4", "", 0.0),
    ("legality_check", "Yes, legal.", "yes", 1.0), ("legality_check", "illegal", "Yes, legal.", 0.0),
    ("move_extraction", "<think>e7e5?</think><move>e2e4</move>", "E2E4", 1.0),
    ("candidate_ratings", "Best: e2e4", "Best: e2e4", 0.0), ("legality_check", "yes and not legal", "Yes, legal.", 0.0), ("exact_match", "e4\n", "e4", 1.0), ("text_exact_match", "A", "a", 0.0),
    ("tactical_patterns", "<move>e2e4</move>", "The tactic is fork. Best move: e2e4", 1.0), ("material_count", "White: 2 rooks. Black: 1 king.", "white 2 rooks black 1 King", 1.0), ("material_count", "White: 2 rooks.", "white 1 rook, black 1 king", 0.0),
    ("step_verification", "Verdict: sound\nFaulty line: 2\nError type: none\nCorrection: none", "Verdict: sound\nFaulty line: none\nError type: none\nCorrection: none", 0.0),
    ("unknown", "a", "A ", 1.0),
]


def test_metrics(spark):
    rows = spark.createDataFrame([(i, m, p, g) for i, (m, p, g, _) in enumerate(CASES)], "i int, m string, p string, g string")
    got = {r["i"]: r["s"] for r in rows.select("i", M.primary_score(F.col("m"), F.col("p"), F.col("g")).alias("s")).collect()}
    for i, (m, p, g, want) in enumerate(CASES):
        assert got[i] == (want if want is None else pytest.approx(want)), (m, p, g)


def test_losses_and_lines(spark):
    row = spark.createDataFrame([(50, -20, "a\nb")], "g int, p int, t string").select(
        M.centipawn_loss(F.col("g"), F.col("p")).alias("a"), M.centipawn_loss(F.col("p"), F.col("g")).alias("b"), M.centipawn_loss(F.col("g"), F.lit(None)).alias("c"), M.number_lines(F.col("t")).alias("n"),
        M.move_overlap(F.lit("All legal moves: e2e4 d2d4"), F.lit("e2e4 a2a3")).alias("o"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["n"]) == (70.0, 0.0, 1000.0, "1. a\n2. b")
    assert row["o"].asDict() == {"precision": 0.5, "recall": 0.5, "jaccard": pytest.approx(1 / 3), "extra": 1.0, "missing": 1.0}


def test_fens_in_answers(spark):
    fen, other = "8/8/8/4k3/8/8/8/4K2R w - - 0 1", "8/8/8/4k3/8/8/8/4K2R w - - 3 9"
    cases = [(f"Result FEN: {fen}.", fen, 1.0, 1.0), (f"x: {other}", fen, 0.0, 1.0), ("no fen", fen, 0.0, 0.0), (f"The position is {fen} now", fen, 1.0, 1.0), (fen.rsplit(" ", 2)[0], fen, 0.0, 1.0), (None, fen, 0.0, 0.0)]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(cases)], "i int, p string, g string")
    got = rows.select("i", P.fen_exact(F.col("p"), F.col("g")).alias("e"), P.fen_first4(F.col("p"), F.col("g")).alias("f")).orderBy("i").collect()
    assert [(r["e"], r["f"]) for r in got] == [c[2:] for c in cases]


def test_choices(spark):
    cases = [("e2e4", 1.0), ("d2d4", 0.0), ("neither", 0.0), ("Between e2e4 and d2d4 I take d2d4.", 0.0), ("Not d2d4 but e2e4.", 1.0), ("d2d4 is worse; e2e4", 1.0), ("e2e4 or d2d4", 0.0), ("d2d4? no, e2e4", 1.0), ("I like e2e4 more than the move d2d4", 1.0), (None, 0.0)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", P.choice_match(F.col("t"), F.lit("E2E4"), F.lit("e2e4"), F.lit("d2d4")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [w for _, w in cases]
    none = F.lit(None).cast("string")
    assert rows.filter("i < 2").select(P.choice_match(F.col("t"), F.lit("e2e4"), none, none).alias("s")).collect() == [(1.0,), (0.0,)]


def test_tagged_moves_and_traces(spark):
    think = "<think>Candidates: e2e4, d2d4. Line: e2e4 e7e5 g1f3. Back to e2e5. Best: e2e4</think><move>e2e4</move>"
    rows = spark.createDataFrame([(0, think), (1, "<move>E2E4</move>"), (2, "e2e4"), (3, "<think>Line: e2e4 e2e4</think><move>d2d4</move>")], "i int, t string")
    got = rows.select("i", P.legal_move_rate(F.col("t"), F.lit(C.START)).alias("r"), P.trace_metrics(F.lit(C.START), F.col("t")).alias("m")).orderBy("i").collect()
    assert [r["r"] for r in got] == [1.0, 0.0, None, 1.0]
    first = got[0]["m"]
    assert (first["trace_referenced_move_count"], first["trace_illegal_referenced_move_count"], first["trace_candidate_count"], first["trace_line_depth"], first["trace_backtrack_count"]) == (7.0, 1.0, 2.0, 3.0, 1.0)
    assert first["trace_conclusion_move_match"] == 1.0 and first["trace_step_accuracy"] == 1.0 and first["trace_failure_buckets"] == ["illegal_referenced_move"]
    assert got[1]["m"]["trace_failure_buckets"] == ["missing_think"] and got[1]["m"]["trace_referenced_move_accuracy"] is None
    assert got[3]["m"]["trace_step_accuracy"] == 0.5 and got[3]["m"]["trace_failure_buckets"] == ["illegal_referenced_move", "missing_conclusion_or_move_tag"]


def test_families_and_bleed(spark):
    cases = [
        ("", "empty", False), ("<think>x", "think_move_protocol", True), ("Rows: rank 1 a->b\nResult FEN: x", "fen_row_rewrite_trace", True), ("Lookup: a", "square_edit_trace", True),
        ("play e2e4", "uci_moves", False), ("Yes, legal", "legality_answer", False), ("Result FEN: 8/8/8/4k3/8/8/8/4K2R w - - 0 1", "result_fen", False),
        ("It is 8/8/8/4k3/8/8/8/4K2R w - - 0 1", "fen", False), ("+--\n|r\n|k\n|P", "board_render", False), ("hello", "text", False),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string")
    got = rows.select("i", P.format_family(F.col("t")).alias("f")).withColumn("b", P.format_bleed(F.lit("piece_id"), F.col("f"))).orderBy("i").collect()
    assert [(r["f"], r["b"]) for r in got] == [c[1:] for c in cases]


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    """As SQL's word boundaries have it: also in the query, against its twin."""
    import duckdb

    import __spark_entry__ as entry

    cases = {"adoñno es": "legality_answer", "no, ñlegal": "text", "é yesñ": "legality_answer", "ñe2e4ñ": "uci_moves", "nothing": "text", "_no": "text", "no way": "legality_answer"}
    rows = spark.createDataFrame([(i, 0, t, t) for i, t in enumerate(cases)], "conv_id long, turn long, role string, text string")
    assert {r["text"]: r["f"] for r in rows.select("text", P.format_family(F.col("text")).alias("f")).collect()} == cases
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, entry.queries()["format_family"](spark, str(tmp_path)).select("role", "family", "n").collect()))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.sql(entry.oracle_sql()["format_family"]).project("role, family, n").fetchall())
