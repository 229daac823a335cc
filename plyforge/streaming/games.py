"""Games that a stream of judged moves brings to an end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# From when on an evaluation counts as decided, for how many moves on end,
# and how long a game may be.
DECIDED_CP, DECIDED_PLIES, MOST_PLIES = 800.0, 6, 200
# Fixed values end.

RESULT = "game_id string, ply int, streak int, result string, termination string"
_STATE = "next int, sign int, streak int, result string, termination string"


def step(state: tuple, ply: int, white_cp: float | None, cp: float, plies: int, most: int) -> tuple:
    """(next, sign, streak, result, termination) after a move with white's evaluation:
    a streak of decided evaluations for one side ends the game, and so does its length."""
    _, sign, streak, result, end = state
    if result:
        return state
    if white_cp is None or abs(white_cp) < cp:
        streak = 0
    else:
        now = 1 if white_cp > 0 else -1
        sign, streak = now, streak + 1 if now == sign else 1
    if streak >= plies:
        result, end = ("1-0" if sign > 0 else "0-1"), "adjudicated"
    elif ply + 1 >= most:
        result, end = "*", "max_plies"
    return ply + 1, sign, streak, result, end


def adjudicate(moves: DataFrame, cp: float = DECIDED_CP, plies: int = DECIDED_PLIES, most: int = MOST_PLIES) -> DataFrame:
    """A stream of moves(game_id, ply, white_cp) to one row for each move that its game
    still took: the streak of decided evaluations and, with the last, result and
    termination. A game's state is a few numbers; its moves come in order of their
    plies, batch by batch, and moves after its end are left out. A game's state is kept
    after its end, so that late moves are known to be late."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0, "", "")
        out = []
        rows = pd.concat(list(frames)).sort_values("ply", kind="stable")
        for ply, value in zip(rows["ply"], rows["white_cp"], strict=True):
            if now[3] or ply < now[0]:  # over, or seen before
                continue
            now = step(now, int(ply), None if pd.isna(value) else float(value), cp, plies, most)
            out.append((key[0], int(ply), now[2], now[3] or None, now[4] or None))
        state.update(now)
        yield pd.DataFrame(out, columns=["game_id", "ply", "streak", "result", "termination"])

    own = moves.select("game_id", "ply", "white_cp")
    return own.groupBy("game_id").applyInPandasWithState(run, RESULT, _STATE, "append", GroupStateTimeout.NoTimeout)
