"""Small positions of the rules of chess that pools of game positions hold few of:
checks, mates and stalemates; castling, en passant, promotion; pieces and kings that
may not move. Families are numbered: a number says where each piece stands, so any
range of a family can be laid out anywhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chess
from ..functions.answers import filter_trace_text, special_bucket
from ..operators.ranking import with_rank
from ..ship import ship
from .sampling import _draw

# Squares of the two kings beside a pawn, castling rights (rook squares)
# and the ranks on which a pawn of each side may stand beside them.
KINGS = (("e1", "e8"), ("a1", "h8"), ("h1", "a8"), ("c1", "f8"), ("f1", "c8"))
KINGS_FAR = (("e1", "h8"), ("a1", "h8"), ("h1", "a8"), ("c1", "f8"), ("f1", "c8"))
RIGHTS = (("a1", "h1", "a8", "h8"), ("a1", "h1"), ("a8", "h8"), ("h1", "h8"), ("a1", "a8"))
PAWN_RANKS = range(1, 6)
# Fixed values end.

_EXTRA = [None, *(8 * y + x for y in PAWN_RANKS for x in range(8))]


def _digits(n: int, *bases: int) -> list[int]:
    out = []
    for base in reversed(bases):
        n, digit = divmod(n, base)
        out.append(digit)
    return out[::-1]


def _position(pieces: list[tuple[int | None, str]], white: bool, **rest) -> chess.Position | None:
    """The position of pieces, if each has a square of its own."""
    cells = [""] * 64
    for square, piece in pieces:
        if square is None:
            continue
        if cells[square]:
            return None
        cells[square] = piece
    return chess.Position(cells, white, **rest)


def _side(piece: str, white: bool) -> str:
    return piece.upper() if white else piece.lower()


def _queen(n: int, _) -> tuple[str, chess.Position] | None:
    """King and queen against a king that is to move."""
    side, king, other, queen = _digits(n, 2, 64, 64, 64)
    white = side == 1
    p = _position([(king, _side("k", white)), (other, _side("k", not white)), (queen, _side("q", not white))], white)
    # a king off the edges, next to a queen that gives no check, always has a move
    edge = king & 7 in (0, 7) or king >> 3 in (0, 7)
    if p is None or not (edge or p.in_check()):
        return None
    state = chess.check_state(p)
    return None if state == "none" else (state, p)


def _castling(n: int, _):
    side, rights, one, two = _digits(n, 2, len(RIGHTS), len(_EXTRA), len(_EXTRA))
    pieces = [(chess.square(s), piece) for s, piece in (("e1", "K"), ("a1", "R"), ("h1", "R"), ("e8", "k"), ("a8", "r"), ("h8", "r"))]
    rooks = [chess.square(s) for s in RIGHTS[rights]]
    own = {True: frozenset(s for s in rooks if s < 8), False: frozenset(s for s in rooks if s >= 56)}
    return "castling", _position([*pieces, (_EXTRA[one], "P"), (_EXTRA[two], "p")], side == 0, rooks=own)


def _en_passant(n: int, _):
    kings, x, right, side = _digits(n, len(KINGS), 8, 2, 2)
    white, beside = side == 0, x + (1 if right else -1)
    if not 0 <= beside < 8:
        return None
    y, behind = (4, 5) if white else (3, 2)
    pieces = [(chess.square(KINGS[kings][0]), "K"), (chess.square(KINGS[kings][1]), "k")]
    pawns = [(8 * y + x, _side("p", white)), (8 * y + beside, _side("p", not white))]
    return "en_passant", _position([*pieces, *pawns], white, ep=8 * behind + beside)


def _promotion(n: int, _):
    kings, x, side = _digits(n, len(KINGS_FAR), 8, 2)
    white = side == 0
    pieces = [(chess.square(KINGS_FAR[kings][0]), "K"), (chess.square(KINGS_FAR[kings][1]), "k")]
    return "promotion", _position([*pieces, (8 * (6 if white else 1) + x, _side("p", white))], white)


def _bare(n: int, _):
    white, black = _digits(n, 64, 64)
    return "none", _position([(white, "K"), (black, "k")], True)


def _pick(choices, *seed):
    return choices[_draw(*seed) % len(choices)]


def _line(square: int, *seed) -> tuple[list[int], str]:
    """A line from a square, and a slider that attacks along it."""
    way = _pick(chess.STRAIGHT + chess.DIAGONAL, *seed, "way")
    return chess.RAYS[square, way], _pick("rq" if way in chess.STRAIGHT else "bq", *seed, "slider")


def _drawn(kind: str):
    def build(n: int, seed: int):
        key = (seed, kind, n)
        white, king, other = _draw(*key, "side") % 2 == 0, _draw(*key, "king") % 64, _draw(*key, "other") % 64
        pieces = [(king, _side("k", white)), (other, _side("k", not white))]
        if kind == "king_would_be_in_check":
            # an attacker on a line to a square beside the king
            line, slider = _line(_pick(chess.HOPS[king, "k"], *key, "beside"), *key)
            if not line:
                return None
            pieces.append((_pick(line, *key, "from"), _side(slider, not white)))
        else:
            line, slider = _line(king, *key)
            if len(line) < 2:
                return None
            far = 1 + _draw(*key, "far") % (len(line) - 1)
            mine = line[_draw(*key, "near") % far] if kind == "pinned_piece_exposes_king" else _draw(*key, "mine") % 64
            piece = _pick("rbnqp", *key, "piece")
            if piece == "p" and mine >> 3 in (0, 7):
                return None
            pieces += [(line[far], _side(slider, not white)), (mine, _side(piece, white))]
        p = _position(pieces, white)
        if p is None or not p.valid() or p.in_check() != (kind == "does_not_resolve_check"):
            return None
        legal = {p.uci(m) for m in p.legal()}
        odd = {p.uci(m) for m in p.pseudo()} - legal
        return (kind, p) if legal and odd and filter_trace_text(p) else None

    return build


#: How many numbers a family has (none: as many as are asked for), and what one says.
FAMILIES = {
    "queen": (2 * 64**3, _queen),
    "castling": (2 * len(RIGHTS) * len(_EXTRA) ** 2, _castling),
    "en_passant": (len(KINGS) * 32, _en_passant),
    "promotion": (len(KINGS_FAR) * 16, _promotion),
    "bare": (64 * 64, _bare),
    "pinned": (None, _drawn("pinned_piece_exposes_king")),
    "unresolved": (None, _drawn("does_not_resolve_check")),
    "walk": (None, _drawn("king_would_be_in_check")),
}
SPECIAL = ("castling", "en_passant", "promotion", "bare")


def rule_positions(spark: SparkSession, most: int, families=tuple(FAMILIES), seed: int = 42, draws: int = 4) -> DataFrame:
    """(kind, n_row, fen): the first ``most`` valid positions of each kind, none twice,
    fewer where a family has no more. ``queen`` holds check, checkmate and stalemate;
    castling, en_passant, promotion and bare what special_bucket calls them; pinned,
    unresolved and walk are drawn, ``draws`` times for each position asked for, and
    hold moves that leave the king in check."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            out = []
            for family, n in zip(pdf["family"], pdf["n"], strict=True):
                made = FAMILIES[family][1](n, seed)
                if not made or made[1] is None or not made[1].valid():
                    continue
                kind, p = made
                if family in SPECIAL and special_bucket(p) != kind:
                    continue
                out.append((kind, n, p.fen()))
            yield pd.DataFrame(out, columns=["kind", "n", "fen"])

    numbers = None
    for family in families:
        part = spark.range(FAMILIES[family][0] or most * draws).select(F.lit(family).alias("family"), F.col("id").alias("n"))
        numbers = part if numbers is None else numbers.union(part)
    made = numbers.mapInPandas(run, "kind string, n long, fen string").groupBy("kind", "fen").agg(F.min("n").alias("n"))
    ranked = with_rank(made, ["kind"], F.col("n"), "n_row", bucket=F.floor(F.col("n") / 1024))
    return ranked.filter(F.col("n_row") <= most).select("kind", "n_row", "fen")
