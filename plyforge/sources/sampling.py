"""Sources that make positions up: Chess960 starts, endgames, lines of opening books;
and the listings that other sources are found by. Every choice follows hashes of a
seed and a row's number."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chess
from ..functions import chess_udfs as U
from ..functions.text import UCI, found
from ..operators.benchmark import choose_weighted
from ..ship import ship
from ..store import stash
from .readers import CORRUPT, is_json, read_jsonl

# The usual start among Chess960's, shares and bounds of source counts,
# fields of self-play rows, endings of tablebase files.
USUAL_START = 518
SHARE_960, LEAST_960, MOST_960 = 0.15, 5_000, 100_000
SELF_PLAY = ("fen", "move_played_uci", "game_phase", "material_balance", "ply", "game_id", "mover", "model_id", "run_id")
RTB_ENDINGS = ("rtbw", "rtbz")
# Fixed values end.


def _draw(*parts) -> int:
    """A number of 64 bits that follows from the parts."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def played_on(p: chess.Position, moves: int, *seed) -> tuple[chess.Position, int]:
    """The position after so many moves drawn among the legal ones, fewer where a game
    ends, and how many they were."""
    for n in range(moves):
        legal = sorted(p.legal(), key=p.uci)
        if not legal:
            return p, n
        p = p.play(legal[_draw(*seed, n) % len(legal)])
    return p, moves


def starts_960(spark: SparkSession) -> DataFrame:
    """(chess960_id, fen) of all 960 starts."""
    rows = [(i, chess.Position.parse(chess.start_960(i), True).fen()) for i in range(960)]
    return spark.createDataFrame(rows, "chess960_id int, fen string")


def chess960_positions(spark: SparkSession, n: int, most_moves: int = 0, seed: int = 42) -> DataFrame:
    """(n_row, fen, chess960_id, is_chess960, n_moves_applied) of n Chess960 positions:
    a start that isn't the usual one, and up to most_moves moves from it."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                start = _draw(seed, i, "start") % 959
                start += start >= USUAL_START
                p = chess.Position.parse(chess.start_960(start), True)
                p, played = played_on(p, _draw(seed, i, "moves") % (most_moves + 1), seed, i)
                out.append((i, p.fen(), start, True, played))
            yield pd.DataFrame(out, columns=["n_row", "fen", "chess960_id", "is_chess960", "n_moves_applied"])

    return spark.range(n).mapInPandas(run, "n_row long, fen string, chess960_id int, is_chess960 boolean, n_moves_applied int")


def chess960_target(n_standard: int, cap: int | None = None, share: float = SHARE_960, reserve: int = 0) -> int:
    """Chess960 rows that a mix needs beside n_standard others: their share, within
    bounds; for a capped run the cap or the share, and what evaluation takes besides."""
    want = int(n_standard * share / (1 - share))
    return max(LEAST_960, min(want, MOST_960)) if cap is None else max(cap + reserve, want + reserve)


def material_of(name: str) -> tuple[str, str]:
    """White's and black's pieces of a name like KRPKR."""
    cut = name.rindex("K")
    return name[:cut] or "K", name[cut:]


def _placed(name: str, *seed) -> str | None:
    white, black = material_of(name)
    free, cells = list(range(64)), [""] * 64
    for i, piece in enumerate(white + black.lower()):
        able = [s for s in free if piece not in "pP" or 8 <= s < 56]
        square = able[_draw(*seed, i) % len(able)]
        free.remove(square)
        cells[square] = piece
    p = chess.Position(cells, _draw(*seed, "side") % 2 == 0)
    return p.fen() if p.valid() else None


def endgame_positions(spark: SparkSession, materials: list[str], n: int, seed: int = 42, tries: int = 200) -> DataFrame:
    """(material, n_row, fen): n valid placements of each material, drawn square by
    square, ``tries`` draws for each at most. Their values come from a tablebase's
    columns, joined by fen; none is read here."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            out = []
            for name, i in zip(pdf["material"], pdf["n_row"], strict=True):
                fen = next((f for t in range(tries) if (f := _placed(name, seed, name, i, t))), None)
                if fen:
                    out.append((name, i, fen))
            yield pd.DataFrame(out, columns=["material", "n_row", "fen"])

    names = F.explode(F.array(*[F.lit(m) for m in materials]))
    return spark.range(n).select(names.alias("material"), F.col("id").alias("n_row")).mapInPandas(run, "material string, n_row long, fen string")


def book_lines(starts: DataFrame, moves: DataFrame, most_plies: int, seed: int = 42) -> DataFrame:
    """(line, start_fen, final_fen, moves) of starts(line, fen): in each step a line goes
    on by a move of moves(fen, uci, weight), drawn by weight, as long as its position has
    any and the move is legal. Positions are matched by their FEN. Runs jobs for each
    ply while the plan is built; a book's lines are short."""
    now = starts.select("line", F.col("fen").alias("start_fen"), F.col("fen").alias("final_fen"), F.array().cast("array<string>").alias("moves"), F.lit(True).alias("open"))
    for ply in range(most_plies):
        going = now.filter("open").select("line", F.col("final_fen").alias("fen"))
        drawn = choose_weighted(going.join(moves, "fen"), "line", "uci", "weight", seed * 1000 + ply).withColumnRenamed("uci", "_move")
        stepped = now.join(drawn, "line", "left").withColumn("_after", U.play_move(F.col("final_fen"), F.col("_move")))
        on = F.col("open") & F.col("_after").isNotNull()
        now = stash(
            stepped.select(
                "line", "start_fen", F.when(on, F.col("_after")).otherwise(F.col("final_fen")).alias("final_fen"),
                F.when(on, F.concat("moves", F.array("_move"))).otherwise(F.col("moves")).alias("moves"), F.coalesce(on, F.lit(False)).alias("open"),
            ),
            "lines",
        )
        if now.filter("open").isEmpty():
            break
    return now.drop("open")


def books(files: DataFrame, curated: list[str]) -> DataFrame:
    """(rank, name, path, curated) of the .bin files of files(path): curated ones in
    their order, then the others by name."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select("path", name.alias("name")).filter(F.lower("name").endswith(".bin")).groupBy("name").agg(F.min("path").alias("path"))
    at = F.array_position(F.array(*[F.lit(c) for c in curated]) if curated else F.array().cast("array<string>"), F.col("name"))
    ranked = own.withColumn("curated", at > 0).withColumn("_o", F.struct(F.when(at > 0, at).otherwise(1 << 30).alias("a"), F.lower("name").alias("b"), F.col("name")))
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct("_o", "path", "curated"))).alias("l"))  # a folder's files
    return listed.select(F.posexplode("l").alias("rank", "x")).select("rank", F.col("x._o.name").alias("name"), F.col("x.path").alias("path"), F.col("x.curated").alias("curated"))


def _bare(href: Column) -> Column:
    """The decoded path of a link that has nothing else; null for any other link."""
    plain = ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|[?#]")
    return F.when(plain, F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))))


def safe_dir(href: Column) -> Column:
    """The name of a folder one level down, with its slash; null for other links."""
    path = _bare(href)
    name = F.rtrim(path, F.lit("/"))
    fine = path.endswith("/") & ~name.isin("", ".", "..") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\"))
    return F.when(fine, F.concat(name, F.lit("/")))


def safe_file(href: Column) -> Column:
    """The name of a tablebase file in the folder itself; null for other links."""
    path = _bare(href)
    fine = ~path.rlike(r"[/\\]|^\.") & path.rlike(rf"\.(?:{'|'.join(RTB_ENDINGS)})$")
    return F.when(fine, path)


def piece_count(name: Column) -> Column:
    """Pieces that a tablebase file's name stands for."""
    return F.length(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^A-Z]", ""))


def self_play_positions(spark: SparkSession, root: str) -> DataFrame:
    """Positions of all runs' positions.jsonl below a folder; lines that aren't JSON
    and rows without one of the fields are left out, a folder without runs gives none."""
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("material_balance", "ply") else T.StringType()) for c in SELF_PLAY])
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/positions.jsonl")
    found_ = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    if found_ is None or not len(found_):
        return spark.createDataFrame([], schema)
    rows = read_jsonl(spark, f"{root.rstrip('/')}/*/positions.jsonl", schema)
    rows = rows.filter(is_json(rows)).drop(CORRUPT)
    return rows.dropna(subset=[c for c in SELF_PLAY])


def pv_line(fen: Column, line: Column) -> Column:
    """A line of moves in UCI or SAN as UCI; null if any of them isn't legal in turn."""
    moves = F.filter(F.split(F.trim(line), r"\s+"), lambda m: m != "")
    uci = U.replay_moves(fen, moves)
    return F.when((F.size(moves) > 0) & (F.size(uci) == F.size(moves)), F.array_join(uci, " "))


def first_uci(line: Column) -> Column:
    return found(line, rf"^\s*({UCI})")
