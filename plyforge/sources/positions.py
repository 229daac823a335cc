"""Sources of positions: games, puzzles, openings, evaluations, move choices. Each
function takes a raw table and gives its rows in the schema of the pipeline; rows
that can't be used are left out. ``cap`` keeps the first rows by an ordinal column,
never an arbitrary set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import chess
from ..functions import chess_udfs as U
from ..functions import keys as K
from ..functions.text import UCI
from ..operators.dedup import keep_best
from ..ship import ship
from .readers import first_present

# Wording of move-choice rows; bounds of evaluation classes.
MATE_INPUT = rf'(?is)FEN[^"]*"([^"]+)".*?MoveA[:\s]*({UCI}).*?MoveB[:\s]*({UCI})'
MATE_OUTPUT = rf"(?is)Move([AB])[:\s]*({UCI})"
PERSPECTIVE = "white"
HIGH_CP, BALANCED_CP, FEW_PIECES, DEEP = 200, 100, 10, 30
# Fixed values end.


def first_rows(df: DataFrame, ordinal: str, cap: int | None) -> DataFrame:
    return df if cap is None else df.orderBy(ordinal).limit(max(0, cap))


def games(raw: DataFrame, ordinal: str, min_elo: int = 1200, cap: int | None = None) -> DataFrame:
    """(ordinal, moves, white_elo, black_elo, result) of games in which both players
    have the rating and there are moves."""
    elo = lambda *names: first_present(raw, *names).try_cast("int")
    rows = raw.select(
        F.col(ordinal), F.nullif(first_present(raw, "moves", "pgn", "movetext"), F.lit("")).alias("moves"), elo("WhiteElo", "white_elo").alias("white_elo"),
        elo("BlackElo", "black_elo").alias("black_elo"), F.coalesce(first_present(raw, "Result", "result"), F.lit("*")).alias("result"),
    )
    return first_rows(rows.filter((F.least("white_elo", "black_elo") >= min_elo) & F.col("white_elo").isNotNull() & F.col("black_elo").isNotNull() & F.col("moves").isNotNull()), ordinal, cap)


def game_positions(played: DataFrame) -> DataFrame:
    """(game_id, ply, fen, move_played_uci, move_history, game_phase,
    material_balance): one row before each move, up to the first illegal one."""
    ship(played.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for game, tokens in zip(pdf["game_id"], pdf["tokens"], strict=True):
                p, done = chess.Position.parse(chess.START), []
                for ply, uci in enumerate(chess.replay(chess.START, list(tokens))):
                    out.append((game, ply, p.fen(), uci, " ".join(done)))
                    p = p.play(p.find(uci))
                    done.append(uci)
            yield pd.DataFrame(out, columns=["game_id", "ply", "fen", "move_played_uci", "move_history"])

    parsed = played.select(K.game_id(F.col("moves")).alias("game_id"), U.pgn_tokens(F.col("moves")).alias("tokens"))
    rows = parsed.mapInPandas(run, "game_id string, ply int, fen string, move_played_uci string, move_history string")
    return rows.withColumn("game_phase", B.game_phase(F.col("ply"))).withColumn("material_balance", B.material_balance(F.col("fen")))


def themes(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def puzzles(raw: DataFrame, min_rating: int = 0, max_rating: int = 10_000, wanted: list[str] | None = None) -> DataFrame:
    """Puzzles in the rating range with any of the wanted themes: the set-up move is
    played, the solution checked to its end."""
    fen, moves = first_present(raw, "FEN", "fen"), F.split(F.trim(first_present(raw, "Moves", "moves")), r"\s+")
    rows = raw.select(
        first_present(raw, "PuzzleId", "puzzle_id").alias("puzzle_id"), first_present(raw, "Rating", "rating").try_cast("int").alias("rating"),
        themes(first_present(raw, "Themes", "themes")).alias("themes"), fen.alias("start"), moves.alias("moves"),
    ).filter(F.col("rating").between(min_rating, max_rating) & (F.size("moves") >= 2))
    if wanted:
        rows = rows.filter(F.arrays_overlap("themes", F.array(*[F.lit(t) for t in wanted])))
    played = rows.withColumn("uci", U.replay_moves(F.col("start"), F.col("moves"))).filter(F.size("uci") == F.size("moves"))
    shown = played.withColumn("fen", U.play_move(F.col("start"), F.get("uci", F.lit(0)))).withColumn("solution_full", F.slice("uci", 2, 1000))
    side = F.when(F.split("fen", " ")[1] == "w", "white").otherwise("black")
    return shown.select("fen", side.alias("side"), U.legal_moves(F.col("fen")).alias("legal_moves"), F.get("solution_full", F.lit(0)).alias("solution_first_move"), "solution_full", "themes", "rating", "puzzle_id")


def evals(raw: DataFrame, ordinal: str, min_depth: int = 20, cached: DataFrame | None = None, seed: int = 42, cap: int | None = None) -> DataFrame:
    """The deepest evaluation of each position (then most nodes, then the earlier
    row), of at least min_depth, beside what is cached; in seeded hash order if capped.
    Lines are UCI or SAN and come out as UCI; a row whose line isn't legal to its end,
    or whose FEN is none, is left out. Scores are white's: eval_perspective says so."""
    columns = ["fen", "best_move", "pv_line", "depth", "knodes", "cp", "mate", "eval_perspective", ordinal]
    deep = raw.withColumn("_line", F.filter(F.split(F.trim(first_present(raw, "line", "pv_line")), r"\s+"), lambda m: m != "")).filter((F.col("depth") >= min_depth) & (F.size("_line") > 0))
    legal = deep.withColumn("_uci", U.replay_moves(F.col("fen"), F.col("_line"))).filter(F.size("_uci") == F.size("_line"))
    rows = legal.withColumn("pv_line", F.array_join("_uci", " ")).withColumn("best_move", F.get("_uci", F.lit(0))).withColumn("eval_perspective", F.lit(PERSPECTIVE)).select(*columns)
    both = rows if cached is None else cached.select(*columns).unionByName(rows)
    best = keep_best(both, ["fen"], [F.col("depth"), F.col("knodes"), -F.col(ordinal)])
    return best if cap is None else best.withColumn("_o", K.hash_order(seed, "fen")).orderBy("_o").limit(cap).drop("_o")


def eval_classes(rows: DataFrame) -> DataFrame:
    """rows with one row for each class they belong to: mate, high_eval, balanced,
    endgame, best_move; classes overlap."""
    cp, pieces = F.abs("cp"), F.length(F.regexp_replace(B.board_field(F.col("fen")), "[^A-Za-z]", ""))
    rules = [(F.col("mate").isNotNull(), "mate"), (cp > HIGH_CP, "high_eval"), (cp < BALANCED_CP, "balanced"), (pieces <= FEW_PIECES, "endgame"), (F.col("depth") >= DEEP, "best_move")]
    return rows.withColumn("class", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))))


def openings(raw: DataFrame) -> DataFrame:
    """Openings replayed: fen after their moves, and whether a given EPD differs."""
    moves = F.split(F.trim(first_present(raw, "uci", "uci_moves")), r"\s+")
    rows = raw.select(first_present(raw, "eco").alias("eco"), first_present(raw, "name").alias("name"), first_present(raw, "epd").alias("epd"), moves.alias("given"))
    played = rows.withColumn("uci_moves", U.replay_moves(F.lit(chess.START), F.col("given"))).filter((F.size("uci_moves") == F.size("given")) & (F.size("given") > 0))
    out = played.withColumn("fen", _after(F.col("uci_moves")))
    differs = F.col("epd").isNotNull() & (K.position_fields(F.col("epd")) != K.position_fields(F.col("fen")))
    return out.select("eco", "name", "uci_moves", "fen", differs.alias("epd_mismatch"))


def _after(moves: Column) -> Column:
    ship()

    @F.pandas_udf("string")
    def run(games_: pd.Series) -> pd.Series:
        out = []
        for g in games_:
            p = chess.Position.parse(chess.START)
            for uci in g:
                p = p.play(p.find(uci))
            out.append(p.fen())
        return pd.Series(out, dtype=object)

    return run(moves)


def book_moves(opened: DataFrame) -> DataFrame:
    """(fen, uci, weight): how often each move follows each position of the openings'
    lines; positions are whole FENs, as lines meet them."""
    ship(opened.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for line in pdf["uci_moves"]:
                p = chess.Position.parse(chess.START)
                for uci in line:
                    out.append((p.fen(), uci))
                    p = p.play(p.find(uci))
            yield pd.DataFrame(out, columns=["fen", "uci"])

    return opened.select("uci_moves").mapInPandas(run, "fen string, uci string").groupBy("fen", "uci").agg(F.count("*").alias("weight"))


def move_choices(raw: DataFrame) -> DataFrame:
    """(fen, move_a, move_b, better_move) of texts that name a position, two legal
    moves and the better of them."""
    cut = raw.select(*[F.regexp_extract("input", MATE_INPUT, i).alias(n) for i, n in ((1, "fen"), (2, "a"), (3, "b"))], *[F.regexp_extract("output", MATE_OUTPUT, i).alias(n) for i, n in ((1, "letter"), (2, "said"))])
    rows = cut.filter("fen <> '' and letter <> ''").select("fen", F.lower("a").alias("move_a"), F.lower("b").alias("move_b"), F.upper("letter").alias("letter"), F.lower("said").alias("better_move"))
    legal = U.legal_moves(F.col("fen"))
    own = F.when(F.col("letter") == "A", F.col("move_a")).otherwise(F.col("move_b"))
    checked = rows.withColumn("legal", legal).filter(F.array_contains("legal", F.col("move_a")) & F.array_contains("legal", F.col("move_b")) & (own == F.col("better_move")))
    return checked.select("fen", "move_a", "move_b", "better_move")
