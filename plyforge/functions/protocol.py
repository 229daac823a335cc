"""What is read from texts by the rules of chess: FENs in answers, legality of tagged
moves, binary choices, traces. Each is one Arrow-batched column function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ship import ship
from . import chess
from . import text as X
from .chess import Position

# Patterns and wording by which traces and choices are read.
_UCI = re.compile(rf"\b({X.UCI})\b", re.IGNORECASE)
_ANY_FEN = re.compile(r"(?:[prnbqkPRNBQK1-8]+/){7}[prnbqkPRNBQK1-8]+\s+[wb]\s+[-A-HKQabcdefghkq]+\s+(?:-|[a-h][36])(?:\s+\d+\s+\d+)?")
_PLAIN_FEN = re.compile(X.FEN, re.IGNORECASE)
_RESULT = re.compile(r"result\s+fen\s*:", re.IGNORECASE)
_THINK = re.compile(r"<think\b[^>]*>(.*?)</think>", re.IGNORECASE | re.DOTALL)
_THINK_MOVE = re.compile(X.THINK_MOVE)
_STRICT = re.compile(X.STRICT_MOVE_TAG)
_LINE = re.compile(r"\b(?:Line|PV|Variation)\s*:\s*([^.\n<]+)", re.IGNORECASE)
_CANDIDATES = re.compile(r"\bCandidates?\s*:\s*([^.\n<]+)", re.IGNORECASE)
_CONCLUSION = re.compile(rf"\b(?:Best|Conclusion|Final(?: move)?)\s*:\s*({X.UCI})\b", re.IGNORECASE)
_BACKTRACK = re.compile(r"\b(?:backtrack|back\s+to|return\s+to)\b", re.IGNORECASE)
_NEGATION = re.compile(r"\b(?:not|don'?t|never|avoid|reject|worse|inferior|rather\s+than|instead\s+of)\b")
_REJECTED_AFTER = re.compile(r"\s+is\s+(?:not|worse|inferior|bad|wrong|weaker)|[?!]\s*no\b")
NEAR_BEFORE, NEAR_AFTER, PREAMBLE = 30, 25, 25
FAULTS = {
    "think": "missing_think", "format": "invalid_think_move_format", "fen": "invalid_fen", "illegal": "illegal_referenced_move",
    "mismatch": "conclusion_move_mismatch", "missing": "missing_conclusion_or_move_tag",
}
# Fixed values end.


def _board(fen, chess960: bool) -> Position | None:
    try:
        p = Position.parse(fen, bool(chess960))
    except (ValueError, TypeError, AttributeError):
        return None
    return p


def fen_texts(text: str) -> list[str]:
    """What may be a FEN in an answer, likeliest first: after "Result FEN:", the whole
    text, each line (after a colon if it has one), anything of that shape."""
    bare = (text or "").strip().strip("`")
    rows = [row for row in (line.strip().strip("`") for line in bare.splitlines()) if row]
    after = lambda row: row.partition(":")[2].strip() if ":" in row else row
    results = [after(row).rstrip(".") for row in rows if _RESULT.match(row)]
    return [*results, bare, *(after(row).rstrip(".") for row in rows), *_ANY_FEN.findall(bare)]


def find_fen(text: str, chess960: bool = False, whole: bool = False) -> str | None:
    """The first valid position of fen_texts as a FEN; ``whole``: six fields only."""
    for found in fen_texts(text):
        if whole and len(found.split()) != 6:
            continue
        p = _board(found, chess960)
        if p is not None and p.valid():
            return p.fen()
    return None


def choice(prediction: str, gold: str, a: str | None, b: str | None) -> float:
    """Whether a prediction (lower case, without thoughts) settles on the gold one of
    two moves: the only one it names; after "a or b" the next one it names; else the
    first one it names, or the other if it rejects that. Without two moves, the first
    move it names."""
    if not a or not b:
        named = re.findall(rf"\b({X.UCI})\b", prediction)
        return float(bool(named) and named[0] == gold)
    seen = sorted((m.start(), i) for i, move in enumerate((a, b)) for m in re.finditer(re.escape(move), prediction))
    if not seen:
        return 0.0
    moves = (a, b)
    if len({i for _, i in seen}) == 1:
        return float(moves[seen[0][1]] == gold)
    at, first = seen[0]
    then, second = next(x for x in seen if x[1] != first)
    between = prediction[at + len(moves[first]) : then]
    if then - at < PREAMBLE and re.search(r"\b(?:and|or)\b", between):
        rest = [i for place, i in seen if place >= then + len(moves[second])]
        return float(bool(rest) and moves[rest[0]] == gold)
    end = at + len(moves[first])
    refused = _NEGATION.search(prediction[max(0, at - NEAR_BEFORE) : at]) or _REJECTED_AFTER.match(prediction[end : end + NEAR_AFTER])
    return float(moves[second if refused else first] == gold)


def _played(p: Position, moves: list[str]) -> int:
    """How many of the moves are legal in turn; others are passed over."""
    n = 0
    for text in moves:
        move = p.find(text)
        if move is not None:
            p, n = p.play(move), n + 1
    return n


TRACE_FIELDS = (
    "trace_referenced_move_accuracy", "trace_referenced_move_count", "trace_illegal_referenced_move_count", "trace_candidate_count", "trace_line_depth",
    "trace_backtrack_count", "trace_step_accuracy", "trace_step_count", "trace_conclusion_move_match",
)


def trace(fen: str, prediction: str, chess960: bool = False) -> dict:
    """How far the thoughts of an answer hold: moves that they name against the
    rules, lines played out, the conclusion against the tagged move."""
    out: dict = {name: 0.0 if "count" in name or "depth" in name else None for name in TRACE_FIELDS}
    out["trace_failure_buckets"] = faults = []
    text = prediction or ""
    think = _THINK.search(text)
    if think is None:
        faults.append(FAULTS["think"])
        return out
    if not _THINK_MOVE.match(text):
        faults.append(FAULTS["format"])
    p = _board(fen, chess960)
    if p is None or not p.valid():
        faults.append(FAULTS["fen"])
        return out
    said = _PLAIN_FEN.sub(" ", think[1])
    uci = lambda t: [m.lower() for m in _UCI.findall(t)]
    played = [uci(m[1]) for m in _LINE.finditer(said)]
    steps, good = sum(map(len, played)), sum(_played(p, line) for line in played)
    legal = {p.uci(m) for m in p.legal()}
    loose = uci(_LINE.sub(" ", said))
    total, right = steps + len(loose), good + sum(m in legal for m in loose)
    if right < total:
        faults.append(FAULTS["illegal"])
    listed = _CANDIDATES.search(said)
    conclusions, tag = _CONCLUSION.findall(said), _STRICT.search(text)
    match = None
    if conclusions and tag:
        match = float(conclusions[-1].lower() == tag[1])
        if not match:
            faults.append(FAULTS["mismatch"])
    elif conclusions or tag:
        faults.append(FAULTS["missing"])
    out.update(
        trace_referenced_move_accuracy=right / total if total else None, trace_referenced_move_count=float(total),
        trace_illegal_referenced_move_count=float(total - right),
        trace_candidate_count=float(len(uci(listed[1])) if listed else sum(row.strip().lower().startswith("candidate ") for row in said.splitlines())),
        trace_line_depth=float(max(map(len, played), default=0)), trace_backtrack_count=float(len(_BACKTRACK.findall(said))),
        trace_step_accuracy=good / steps if steps else None, trace_step_count=float(steps), trace_conclusion_move_match=match,
        trace_failure_buckets=sorted(faults),
    )
    return out


# --- column functions ------------------------------------------------------------


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def _flag(x) -> bool:
    return bool(x) if x is not None and x == x else False


# Positions come again in other rows: results for texts of a FEN's length are kept.


@lru_cache(maxsize=1 << 16)
def _known_key(t: str, v: bool) -> str:
    return chess.variant_key(t, v)


@lru_cache(maxsize=1 << 16)
def _known_valid(t: str, v: bool) -> bool:
    return (p := _board(t, v)) is not None and p.valid()


@lru_cache(maxsize=1 << 16)
def _known_legal(t: str, m: str, v: bool) -> bool:
    return _known_valid(t, v) and m in {p.uci(x) for p in [_board(t, v)] for x in p.legal()}


def _seen(known, v: bool, *texts: str):
    """known(*texts, v), kept unless the texts are long."""
    return (known if sum(map(len, texts)) <= 120 else known.__wrapped__)(*texts, v)


def _udf(returns: str, body):
    """body(text, ..., chess960) for each row, as a column function of the same."""

    def apply(*columns: Column, chess960: Column | bool = False) -> Column:
        ship()

        @F.pandas_udf(returns)
        def run(variant: pd.Series, *values: pd.Series) -> pd.Series:
            return pd.Series([body(*(v if isinstance(v, str) else None for v in row), _flag(f)) for f, *row in zip(variant, *values, strict=True)], dtype=object)

        return run(F.lit(chess960) if isinstance(chess960, bool) else F.coalesce(chess960, F.lit(False)), *columns)

    return apply


canonical_fen = _udf("string", lambda t, v: find_fen(_text(t), v))
whole_fen = _udf("string", lambda t, v: find_fen(_text(t), v, whole=True))
canonical_key = _udf("string", lambda t, v: chess.canonical_key(_text(t), v))
variant_key = _udf("string", lambda t, v: _seen(_known_key, v, _text(t)))
blocking_keys = _udf("array<string>", lambda t, v: chess.blocking_keys(_text(t), v))
normalized_key = _udf("string", lambda t, v: chess.normalized_key(_text(t)))
valid_fen = _udf("boolean", lambda t, v: _seen(_known_valid, v, _text(t)))
valid_line = _udf("boolean", lambda t, m, v: (p := _board(_text(t), v)) is not None and p.valid() and bool(_text(m).split()) and len(chess.replay_uci(p, _text(m).split())) == len(_text(m).split()))
_legal = _udf("boolean", lambda t, m, v: _seen(_known_legal, v, _text(t), _text(m)))
_choice = _udf("double", lambda p, g, a, b, v: choice(_text(p), _text(g), a, b))


def is_legal(fen: Column, move: Column, chess960: Column | bool = False) -> Column:
    """False for a move that isn't legal, for no move and for no position."""
    return _legal(fen, move, chess960=chess960)


def fen_exact(pred: Column, gold: Column, chess960: Column | bool = False) -> Column:
    """1 if both answers give one position, with its counters."""
    return F.when(F.coalesce(whole_fen(pred, chess960=chess960) == whole_fen(gold, chess960=chess960), F.lit(False)), 1.0).otherwise(0.0)


def fen_first4(pred: Column, gold: Column, chess960: Column | bool = False) -> Column:
    """1 if both answers give one position, whatever the counters."""
    four = lambda t: F.substring_index(canonical_fen(t, chess960=chess960), " ", 4)
    return F.when(F.coalesce(four(pred) == four(gold), F.lit(False)), 1.0).otherwise(0.0)


def legal_move_rate(pred: Column, fen: Column, chess960: Column | bool = False) -> Column:
    """1 or 0 for the tagged move; 0 for a tag in another form; null without a tag."""
    plain = X.normalize_prediction(F.coalesce(pred, F.lit("")))
    move = X.strict_move(plain)
    return F.when(move.isNotNull(), is_legal(fen, move, chess960).cast("double")).when(plain.rlike(r"(?is)<move\b[^>]*>.*?</move>"), 0.0)


def choice_match(pred: Column, gold: Column, a: Column, b: Column) -> Column:
    low = lambda c: X.normalize(c)
    return _choice(low(X.normalize_prediction(F.coalesce(pred, F.lit("")))), low(gold), low(a), low(b))


def trace_metrics(fen: Column, pred: Column, chess960: Column | bool = False) -> Column:
    """struct of TRACE_FIELDS (double) and trace_failure_buckets (array<string>)."""
    ship()
    fields = ", ".join(f"{n} double" for n in TRACE_FIELDS)

    @F.pandas_udf(f"{fields}, trace_failure_buckets array<string>")
    def run(variant: pd.Series, fens: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [trace(_text(f), _text(t), _flag(v)) for v, f, t in zip(variant, fens, texts, strict=True)]
        return pd.DataFrame(rows, columns=[*TRACE_FIELDS, "trace_failure_buckets"]).astype({n: "float64" for n in TRACE_FIELDS})

    found = run(F.lit(chess960) if isinstance(chess960, bool) else F.coalesce(chess960, F.lit(False)), fen, pred)
    nans = [F.when(~F.isnan(found[n]), found[n]).alias(n) for n in TRACE_FIELDS]
    return F.struct(*nans, found["trace_failure_buckets"].alias("trace_failure_buckets"))


def format_family(text: Column) -> Column:
    """The first of an ordered list of output shapes that a prediction has."""
    from .metrics import legality_yes_no

    t = X.strip(F.coalesce(text, F.lit("")))
    low, plain, own = F.lower(t), X.normalize_prediction(t), X.lines(t)
    starts = lambda *marks: F.filter(own, lambda x: F.lower(x).rlike(f"^(?:{'|'.join(marks)})"))
    result = F.size(starts("result fen:")) > 0
    edits = F.size(starts("source ", "destination ")) + F.size(starts("rank "))
    rewrite = F.lower(F.get(own, F.lit(0))).startswith("rows:") & F.contains(F.get(own, F.lit(0)), F.lit("->")) & result
    edit_trace = (edits >= 2) | (result & (edits >= 1)) | (F.size(starts("lookup:", "squares:", "ranks:", "move ")) > 0) | (result & low.rlike("lookup:|squares:|ranks:"))
    board = F.size(F.filter(own, lambda x: x.rlike(r"^[+|]|[KQRBNPkqrbnp]"))) >= 4
    fen = canonical_fen(F.when(t.rlike(r"[1-8pnbrqkPNBRQK]/[1-8pnbrqkPNBRQK]"), t)).isNotNull()
    return (
        F.when(t == "", "empty")
        .when(low.rlike("<think|<move"), "think_move_protocol")
        .when(rewrite, "fen_row_rewrite_trace")
        .when(edit_trace, "square_edit_trace")
        .when(F.size(X.uci_list(X.strip_fens(plain))) > 0, "uci_moves")
        .when(legality_yes_no(plain).isNotNull(), "legality_answer")
        .when(fen, F.when(low.startswith("result fen:"), "result_fen").otherwise("fen"))
        .when(board, "board_render")
        .otherwise("text")
    )


# Tasks whose answers have the shape of a trace or of a tagged move.
EDIT_TASKS = ("move_square_edits", "fen_assembly", "state_tracking")
MOVE_TASKS = ("best_move", "puzzle_solve", "best_line_trace")
# Fixed values end.


def format_bleed(task_type: Column, family: Column) -> Column:
    """Whether an answer has the shape of another task's answers."""
    return (
        ((family == "fen_row_rewrite_trace") & (task_type != "fen_row_application"))
        | ((family == "square_edit_trace") & ~task_type.isin(*EDIT_TASKS))
        | ((family == "think_move_protocol") & ~task_type.isin(*MOVE_TASKS))
    )
