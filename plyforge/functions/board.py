"""Board fields of FENs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Centipawns of a piece, its name.
VALUES = {"P": 100, "N": 300, "B": 300, "R": 500, "Q": 900}
NAMES = {"P": "pawn", "N": "knight", "B": "bishop", "R": "rook", "Q": "queen", "K": "king"}
# Bounds of plies: to 30 opening, to 70 middlegame.
PHASES = ((30, "opening"), (70, "middlegame"))
# Upper bounds of |cp| and their labels.
EVAL_BUCKETS = ((50, "equal"), (150, "slight edge"), (300, "clear advantage"), (600, "winning"))
# Fixed values end.


def board_field(fen: Column) -> Column:
    return F.get(F.split(F.trim(fen), r"\s+"), F.lit(0))


def expand_rank(row: Column) -> Column:
    """Cells of a compressed rank: digits become as many dots."""
    cells = F.filter(F.split(row, ""), lambda c: c != "")
    return F.array_join(F.transform(cells, lambda c: F.when(c.rlike("[1-8]"), F.repeat(F.lit("."), c.try_cast("int"))).otherwise(c)), "")


def compress_rank(cells: Column) -> Column:
    """Dots back to digits, longest runs first."""
    out = cells
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit("." * n), F.lit(str(n)))
    return out


def ranks(fen: Column) -> Column:
    return F.transform(F.split(board_field(fen), "/"), expand_rank)


def placed(fen: Column) -> Column:
    """The board's ranks with blanks between cells."""
    spaced = F.transform(ranks(fen), lambda r: F.array_join(F.filter(F.split(r, ""), lambda c: c != ""), " "))
    return F.array_join(spaced, "\n")


def ascii_board(fen: Column) -> Column:
    """The board with the numbers of its ranks in front and the files' letters below."""
    numbered = F.transform(F.split(placed(fen), "\n"), lambda r, i: F.concat((8 - i).cast("string"), F.lit(" "), r))
    return F.concat(F.array_join(numbered, "\n"), F.lit("\n  a b c d e f g h"))


def count_piece(fen: Column, piece: str) -> Column:
    field = board_field(fen)
    return F.length(field) - F.length(F.replace(field, F.lit(piece), F.lit("")))


def material_balance(fen: Column) -> Column:
    """White's centipawns less black's."""
    total = F.lit(0)
    for piece, value in VALUES.items():
        total = total + value * (count_piece(fen, piece) - count_piece(fen, piece.lower()))
    return total


def material_signature(fen: Column) -> Column:
    """KQ..vKR.. in the order king, queen, rook, bishop, knight, pawn."""
    side = lambda low: F.concat(*[F.repeat(F.lit(p), count_piece(fen, p.lower() if low else p)) for p in "KQRBNP"])
    return F.concat(side(False), side(True))


def square_piece(fen: Column, square: Column) -> Column:
    """What stands on a square; "." if nothing."""
    row = 9 - F.substring(square, 2, 1).cast("int")
    column = F.ascii(F.substring(square, 1, 1)) - 96
    return F.substring(F.element_at(ranks(fen), row), column, F.lit(1))


def game_phase(ply: Column) -> Column:
    out = F.lit("endgame")
    for bound, name in reversed(PHASES):
        out = F.when(ply <= bound, name).otherwise(out)
    return out


def eval_bucket(cp: Column) -> Column:
    out = F.lit("decisive")
    for bound, name in reversed(EVAL_BUCKETS):
        out = F.when(F.abs(cp) < bound, name).otherwise(out)
    return out


def side_to_move_cp(fen: Column, white_cp: Column) -> Column:
    return F.when(F.get(F.split(fen, " "), F.lit(1)) == "w", white_cp).otherwise(-white_cp)
