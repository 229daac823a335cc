"""The chess kernel as Arrow-batched column functions. Rows that aren't positions
give null; so do null inputs."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ship import ship
from . import chess


def _position(fen, chess960) -> chess.Position | None:
    return _read(fen, bool(chess960) if chess960 is not None and chess960 == chess960 else False) if isinstance(fen, str) else None


@lru_cache(maxsize=256)  # rows and columns that ask about one position lie together
def _read(fen: str, chess960: bool) -> chess.Position | None:
    try:
        p = chess.Position.parse(fen, chess960)
    except (ValueError, TypeError, AttributeError):
        return None
    return p if p.valid() else None


def _per_row(returns: str, body):
    def apply(fen: Column, *rest: Column, chess960: Column | bool = False) -> Column:
        ship()

        @F.pandas_udf(returns)
        def run(fens: pd.Series, variant: pd.Series, *more: pd.Series) -> pd.Series:
            out = []
            for f, v, *values in zip(fens, variant, *more, strict=True):
                p = _position(f, v)
                out.append(None if p is None else body(p, *values))
            return pd.Series(out, dtype=object)

        flag = F.lit(chess960) if isinstance(chess960, bool) else chess960
        return run(fen, flag, *rest)

    return apply


def _moved(p, uci):
    m = p.find(uci) if isinstance(uci, str) else None
    return None if m is None else p.play(m).fen()


def _reason(p, uci):
    return chess.legality(p, uci if isinstance(uci, str) else "")[1]


def _structure(p, side):
    found = chess.pawn_structure(p, side == "w")
    return ";".join(f"{k}={','.join(v)}" for k, v in sorted(found.items()))


def _exchanges(p):
    from . import answers

    takes = [m for m in p.legal() if m[3] not in ("ep", "castle") and p.cells[m[1]] and not m[2]]
    return sorted(f"{p.uci(m)}:{answers.exchange_sequence(p, m)[1]}" for m in takes)


legal_moves = _per_row("array<string>", lambda p: sorted(p.uci(m) for m in p.legal()))
check_state = _per_row("string", chess.check_state)
legality_reason = _per_row("string", _reason)
play_move = _per_row("string", _moved)
hanging_pieces = _per_row("array<string>", lambda p: sorted(f"{c}{s}" for s, c, hit, kept in chess.hanging(p) if hit and not kept))
captures = _per_row("array<string>", lambda p: sorted(p.uci(m) for m in p.legal() if m[3] == "ep" or (p.cells[m[1]] and m[3] != "castle")))
exchange_values = _per_row("array<string>", _exchanges)
pawn_structure = _per_row("string", _structure)
pseudo_legal_from = _per_row("array<string>", lambda p, s: sorted(p.uci(m) for m in p.pseudo(chess.square(s))))
legal_from = _per_row("array<string>", lambda p, s: sorted(p.uci(m) for m in p.legal(chess.square(s))))


def replay_moves(fen: Column, moves: Column) -> Column:
    """UCI of a game's moves (array of UCI or SAN) up to the first illegal one."""
    ship()

    @F.pandas_udf("array<string>")
    def run(fens: pd.Series, games: pd.Series) -> pd.Series:
        return pd.Series([None if _position(f, False) is None or g is None else chess.replay(f, list(g)) for f, g in zip(fens, games, strict=True)], dtype=object)

    return run(fen, moves)


def pgn_tokens(text: Column) -> Column:
    """Move texts of a PGN's movetext: no comments, variations, numbers or results."""
    bare = F.regexp_replace(text, r"\{[^}]*\}|\([^)]*\)|\$\d+|;[^\n]*", " ")
    bare = F.regexp_replace(bare, r"\d+\.(\.\.)?|1-0|0-1|1/2-1/2|\*", " ")
    return F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != "")
