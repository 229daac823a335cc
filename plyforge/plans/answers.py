"""Queries over model answers: parsing, metrics, analysis, with their DuckDB twins.

The tables hold no answers about boards, so these queries write some: each event
takes a template of a prediction and a gold answer, filled with squares and moves
that follow from its number. The twins are written from the metrics' definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import protocol as P
from ..functions import text as X
from .catalog import query, table

_CANDIDATES = "Candidate {a}: +20cp; Bucket: equal\nCandidate {b}: -70cp; Bucket: slight edge\nCandidate a1a2: +200cp; Bucket: clear advantage\nCandidate h7h8q: M3; Bucket: forced mate\nCandidate {c}: +0cp; Bucket: equal\nBest: {a}"
_LINE = "<think>\nRoot: {a}\nEval: +35cp; Bucket: equal\nPV: {a} {b} {c}\nBest: {a}\n</think><move>{a}</move>"
_STEP = "Verdict: broken\nFaulty line: 3\nError type: wrong_best\nCorrection: Best should be {a}."
_CLAIM = "Verdict: incorrect\nAttacked: yes\nDefended: no\nHanging: yes\nCorrection: the white rook on {s} is hanging."
_BY_PIECE = "Side to move: white.\nPieces: {s} white pawn.\nMoves by piece:\n{s} white pawn: {a} {b}\ne1 white king: {c}\nAll legal moves: {a} {b} {c}"
_FILTER = "Pseudo-legal moves from {s}: {a} {b} {c}\nLegal moves from {s}: {a} {b}\nRejected moves from {s}: {c} king_would_be_in_check"

#: (task, gold, prediction); {a} {b} {c} are moves, {s} a square.
TEMPLATES = (
    ("best_move", "{a}", "<think>Candidates: {a}, {b}.</think>\n<move>{a}</move>"),
    ("best_move", "{a}", "<think>x</think>\n<move> {b} </move><move>{a}</move>"),
    ("best_move", "{a}", "I prefer {b} over {a}."),
    ("best_move", "{a}", '{"move_uci": "{a}", "p": 1}'),
    ("best_move", "{a}", "<|im_start|>assistant\n {a}<|im_end|>"),
    ("best_move", "{a}", "b2b4/8/8/8/7k/8/8/K7 w - - 0 1 and {b}"),
    ("legal_moves", "Legal moves: {a} {b} {c}", "{a} {c} {c}"),
    ("legal_moves", "No legal moves available.", "There are no legal moves."),
    ("available_captures", "", "none"),
    ("check_detection", "Checkmate.", "It is checkmate"),
    ("check_detection", "Check.", "no check, position is fine"),
    ("check_detection", "Stalemate.", "This is not a checkmate but stalemate."),
    ("eval_bucket", "White has a slight edge.", "Black has a slight edge."),
    ("eval_bucket", "The position is equal.", "equal"),
    ("special_rules", "Castling available: kingside. Promotions: {a}q.", "castling kingside! promote {a}q"),
    ("side_piece_inventory", "Pieces: {s} white pawn; e1 white king.", "e1 white  king and {s} black pawn"),
    ("hanging_pieces", "Hanging pieces: white rook on {s}, black pawn on a7.", "Hanging pieces: white rook on {s}."),
    ("hanging_pieces", "No hanging pieces — all defended.", "hanging pieces: none"),
    ("threats", "White threatens: rook on {s}, pawn on a7.", "White threatens: pawn on a7, queen on d8."),
    ("legality_check", "Yes, legal. Reason: legal.", "yes"),
    ("legality_check", "No, illegal. Reason: own piece destination.", "illegal. Reason: own-piece destination!"),
    ("legality_check", "No, illegal. Reason: empty source.", "No and yes, legal"),
    ("step_verification", _STEP, _STEP),
    ("step_verification", _STEP, _STEP.replace("{a}", "{b}").replace("3", "4")),
    ("step_verification", _STEP, "Verdict: sound\nFaulty line: none\nError type: none\nCorrection: none"),
    ("hanging_piece_claim_verification", _CLAIM, _CLAIM.replace("yes\nDefended", "no\nDefended").replace("is hanging.", "is  Hanging")),
    ("best_line_trace", _LINE, _LINE),
    ("best_line_trace", _LINE, _LINE.replace("{b} {c}\nBest", "{c}\nBest").replace("equal", "winning")),
    ("candidate_ratings", _CANDIDATES, _CANDIDATES),
    ("candidate_ratings", _CANDIDATES, _CANDIDATES.replace("clear advantage", "winning").replace("Best: {a}", "Best: {b}")),
    ("candidate_ratings", _CANDIDATES, "Best: {a}"),
    ("legal_moves_by_piece", _BY_PIECE, _BY_PIECE),
    ("legal_moves_by_piece", _BY_PIECE, _BY_PIECE.replace("{a} {b}\ne1", "{a}\ne1").replace("Pieces:", "Have:")),
    ("piece_legal_filter", _FILTER, _FILTER.replace("{a} {b}\nRej", "{a}\nRej")),
    ("opening_name", "Sicilian Defense: Najdorf (ECO: B90)", "The opening is Sicilian Defense, Dragon (ECO: B70)."),
    ("opening_name", "Sicilian Defense: Najdorf (ECO: B90)", "ECO: C20"),
    ("piece_counting", "White (3 pieces): 1 king, 2 pawns. Black (1 pieces): 1 king.", "White: 1 king, 2 pawns; black has 1 king, 1 rook."),
    ("piece_counting", "White: 1 king. Black: 1 king.", "white 1 KING black 1 king"),
)

_MOVES = {"a": ("event_id", "event_id * 3 + 1", "event_id * 5 + 2", "event_id * 7 + 3"), "b": ("event_id + 1", "event_id * 5", "event_id + 6", "event_id * 3"), "c": ("event_id * 3", "event_id + 5", "event_id * 7", "event_id + 4")}


def _move(name: str, letter: str) -> str:
    """A move of an event; ``letter`` writes one by its number."""
    f1, r1, f2, r2 = _MOVES[name]
    return f"{letter.format(f1)} || (1 + ({r1}) % 8) || {letter.format(f2)} || (1 + ({r2}) % 8)"


_SPARK_LETTER, _SQL_LETTER = "char(97 + ({}) % 8)", "chr((97 + ({}) % 8)::int)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def answers(spark, sf) -> DataFrame:
    """(event_id, task, gold, pred) of every event."""
    own = table(spark, sf, "events").select("event_id").filter("event_id is not null")
    for m in _MOVES:
        own = own.withColumn(m, F.expr(_move(m, _SPARK_LETTER)))
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "i long, task string, gold string, pred string")
    filled = own.withColumn("i", F.col("event_id") % len(TEMPLATES)).join(F.broadcast(templates), "i")
    for c in ("gold", "pred"):
        for m in _MOVES:
            filled = filled.withColumn(c, F.replace(c, F.lit("{" + m + "}"), m))
        filled = filled.withColumn(c, F.replace(c, F.lit("{s}"), F.substring("a", 3, 2)))
    return filled.select("event_id", "task", "gold", "pred")


def _fill(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '{{a}}', a), '{{b}}', b), '{{c}}', c), '{{s}}', a[3:4])"


_ANSWERS_SQL = f"""with t(i, task, g, p) as (values {", ".join(f"({i}, {', '.join(map(_literal, t))})" for i, t in enumerate(TEMPLATES))}),
e as (select event_id, {", ".join(f"{_move(m, _SQL_LETTER)} as {m}" for m in _MOVES)} from events where event_id is not null),
x as (select event_id, task, {_fill("g")} as gold, {_fill("p")} as pred from e join t on event_id % {len(TEMPLATES)} = i)
"""

# --- how the twins write what several metrics need --------------------------------

_U = "[a-h][1-8][a-h][1-8][qrbn]?"
_FEN = "(?:[prnbqk1-8]+/){7}[prnbqk1-8]+\\s+[wb]\\s+(?:-|[a-hkq]+)\\s+(?:-|[a-h][36])(?:\\s+\\d+\\s+\\d+)?"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '(?is)<think>.*?</think>', '', 'g')"
    for token in ("<|im_end|>", "<|endoftext|>", "<|assistant|>", "<|user|>"):
        out = f"replace({out}, '{token}', ' ')"
    out = f"regexp_replace({out}, '(?i)<\\|im_start\\|>\\s*assistant', ' ', 'g')"
    return _strip(f"regexp_replace({out}, '(?i)^\\s*assistant\\s*:?\\s*', '')")


def _no_fens(x: str) -> str:
    return f"regexp_replace({x}, '(?i){_FEN}', ' ', 'g')"


def _list(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '\\b({_U})\\b', 1)"


def _set(x: str) -> str:
    return f"list_distinct({_list(x)})"


def _jac(p: str, g: str) -> str:
    return f"case when len({p}) + len({g}) = 0 then 1.0 else len(list_intersect({p}, {g})) / len(list_distinct(list_concat({p}, {g}))) end"


def _f1(p: str, g: str) -> str:
    return f"case when len({p}) + len({g}) = 0 then 1.0 else 2.0 * len(list_intersect({p}, {g})) / (len({p}) + len({g})) end"


def _eq(p: str, g: str) -> str:
    return f"coalesce({p} = {g}, false)::int::double"


def _first(x: str) -> str:
    low = f"lower({_strip(x)})"
    return f"coalesce(nullif(regexp_extract({x}, '<move>({_U})</move>', 1), ''), case when regexp_full_match({low}, '{_U}') then {low} end, {_list(_no_fens(low))}[1])"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: {_strip('y')}), lambda y: y <> '')"


def _both(f) -> str:
    """CTE columns p and g: f of the prediction and of the gold answer."""
    return f"y as (select *, {f('pred')} as p, {f('gold')} as g from x)"


def _scored(score: Column, pairs: DataFrame) -> DataFrame:
    return pairs.select("event_id", "task", F.round(score, 6).alias("score"))




# --- parsing ----------------------------------------------------------------------


@query(_ANSWERS_SQL + f""", k as (select event_id, pred, list_distinct(regexp_extract_all(lower(pred), '<move>\\s*({_U})\\s*</move>', 1)) as tags,
  case when starts_with({_strip('pred')}, '{{') and ends_with({_strip('pred')}, '}}') then lower({_strip("json_extract_string(case when json_valid(pred) then pred end, '$.move_uci')")}) end as js,
  lower({_strip('pred')}) as low, {_set(_no_fens('pred'))} as named from x),
c as (select *, case when len(tags) = 1 then 'move_tag' when len(tags) > 1 then 'none' when regexp_full_match(js, '{_U}') then 'json'
  when regexp_full_match(low, '{_U}') then 'bare_uci' when len(named) = 1 then 'prose_uci' else 'none' end as format_type from k)
select event_id, format_type, case format_type when 'move_tag' then tags[1] when 'json' then js when 'bare_uci' then low when 'prose_uci' then named[1] end as move_uci,
  case when format_type <> 'none' then null when len(tags) > 1 then 'ambiguous move tags' when len(named) > 1 then 'ambiguous UCI moves in prose' else 'no UCI move found' end as parse_error,
  regexp_matches(pred, '(?s)^<think>.*?</think>\\s*<move>{_U}</move>\\s*$') as strict, nullif(regexp_extract(pred, '<move>({_U})</move>', 1), '') as strict_move, {_first(_plain('pred'))} as first_move from c""")
def parse_answers(spark, sf):
    rows = answers(spark, sf).withColumn("a", X.parse_answer(F.col("pred")))
    return rows.select(
        "event_id", "a.format_type", "a.move_uci", "a.parse_error", X.valid_think_move(F.col("pred")).alias("strict"), X.strict_move(F.col("pred")).alias("strict_move"), X.extract_move(F.col("pred")).alias("first_move")
    )


@query(_ANSWERS_SQL + f""", e8 as (select event_id // 8 as example, event_id % 8 as sample, {_first(_plain('pred'))} as move, arg_min(gold, event_id) over (partition by event_id // 8) as want from x)
select example, coalesce(bool_or(move = lower(want)) filter (sample < 1), false)::int::double as pass_1, coalesce(bool_or(move = lower(want)), false)::int::double as pass_8 from e8 group by example""")
def pass_at_k(spark, sf):
    """Eight answers an example, whose gold move is the first one's."""
    rows = answers(spark, sf).withColumn("example", F.expr("event_id div 8"))
    grouped = rows.groupBy("example").agg(F.array_sort(F.collect_list(F.struct("event_id", "pred"))).alias("s"), F.min_by("gold", "event_id").alias("gold"))
    grouped = grouped.withColumn("samples", F.transform("s", lambda x: x["pred"]))
    first = F.when(F.get(F.transform("s", lambda x: x["event_id"] % 8), F.lit(0)) == 0, X.pass_at_k(F.col("samples"), F.col("gold"), 1)).otherwise(0.0)
    return grouped.select("example", first.alias("pass_1"), X.pass_at_k(F.col("samples"), F.col("gold"), 8).alias("pass_8"))


def _family_sql(x: str) -> str:
    """Without the shapes that a valid FEN has: no text here holds one alone."""
    low, plain, own = f"lower({_strip(x)})", _plain(_strip(x)), _lines(x)
    edits = f"len(list_filter({own}, lambda y: regexp_matches(lower(y), '^(source |destination |rank )')))"
    no = "\\bno\\b|\\billegal\\b|\\bnot\\s+legal\\b"
    yes = "\\byes\\b|\\blegal\\b"
    return f"""case when coalesce({_strip(x)}, '') = '' then 'empty' when regexp_matches({low}, '<think|<move') then 'think_move_protocol'
  when {edits} >= 2 or len(list_filter({own}, lambda y: regexp_matches(lower(y), '^(lookup:|squares:|ranks:|move )'))) > 0 then 'square_edit_trace'
  when len({_list(_no_fens(plain))}) > 0 then 'uci_moves'
  when (regexp_matches(lower({plain}), '{no}') and not regexp_matches(regexp_replace(lower({plain}), '{no}', ' ', 'g'), '{yes}')) or (not regexp_matches(lower({plain}), '{no}') and regexp_matches(lower({plain}), '{yes}')) then 'legality_answer'
  when len(list_filter({own}, lambda y: regexp_matches(y, '^[+|]|[KQRBNPkqrbnp]'))) >= 4 then 'board_render' else 'text' end"""


@query(f"select role, {_family_sql('text')} as family, count(*) as n from conversations group by all")
def format_family(spark, sf):
    rows = table(spark, sf, "conversations").select("role", P.format_family(F.col("text")).alias("family"))
    return rows.groupBy("role", "family").agg(F.count("*").alias("n"))


@query(_ANSWERS_SQL + f""", f as (select task, {_family_sql('pred')} as family from x)
select task, family, count(*) as n, count(*) filter ((family = 'square_edit_trace' and task not in ('move_square_edits', 'fen_assembly', 'state_tracking'))
  or (family = 'think_move_protocol' and task not in ('best_move', 'puzzle_solve', 'best_line_trace'))) as bleed from f group by all""")
def format_bleed(spark, sf):
    rows = answers(spark, sf).select("task", P.format_family(F.col("pred")).alias("family"))
    return rows.groupBy("task", "family").agg(F.count("*").alias("n"), F.count_if(P.format_bleed(F.col("task"), F.col("family"))).alias("bleed"))


def _prefix_sql(x: str) -> str:
    line = f"regexp_replace({_lines(x)}[1], '\\s+', ' ', 'g')"
    return f"coalesce(case when length({line}) <= 80 then {line} else {line}[1:77] || '...' end, '')"


@query(f"""select lang, prefix, n from (select *, row_number() over (partition by lang order by n desc, prefix) as r
  from (select lang, {_prefix_sql('text')} as prefix, count(*) as n from documents group by all)) where r <= 10""")
def top_prefixes(spark, sf):
    """The ten commonest first lines of each language."""
    counts = table(spark, sf, "documents").groupBy("lang", X.prediction_prefix(F.col("text")).alias("prefix")).agg(F.count("*").alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "prefix"))), 1, 10)
    # two steps: the ten best of each of 64 parts, then of all
    parts = counts.groupBy("lang", F.pmod(F.xxhash64("prefix"), F.lit(64)).alias("part")).agg(ranked.alias("best"))
    best = parts.select("lang", F.inline("best")).withColumn("n", -F.col("m")).groupBy("lang").agg(ranked.alias("best"))
    return best.select("lang", F.inline("best")).select("lang", "prefix", (-F.col("m")).alias("n"))


@query(_ANSWERS_SQL + f""", r as (select task, {_prefix_sql('pred')} as prefix, {_family_sql('pred')} as family, {_eq(f"lower({_strip('pred')})", f"lower({_strip('gold')})")} as score from x)
select task, count(*) as n, count(distinct prefix) as prefixes, count(distinct family) as families, round(avg(score), 6) as accuracy,
  count(*) filter (score < 1) as failures from r group by grouping sets ((task), ())""")
def analysis_report(spark, sf):
    rows = answers(spark, sf).select("task", X.prediction_prefix(F.col("pred")).alias("prefix"), P.format_family(F.col("pred")).alias("family"), M.exact_match(F.col("pred"), F.col("gold")).alias("score"))
    return rows.groupingSets([[F.col("task")], []], F.col("task")).agg(
        F.count("*").alias("n"), F.countDistinct("prefix").alias("prefixes"), F.countDistinct("family").alias("families"),
        F.round(F.avg("score"), 6).alias("accuracy"), F.count_if(F.col("score") < 1).alias("failures"),
    )


# --- metrics ----------------------------------------------------------------------

_SILENT = f"""(len(g) = 0 and ({_strip('gold')} = '' or regexp_matches(lower({_strip('gold')}), '{M.NO_MOVE.replace("(?i)", "")}')))"""


@query(_ANSWERS_SQL + f", {_both(lambda t: _set(_no_fens(t)))} select event_id, task, round(case when {_SILENT} then regexp_matches(lower({_strip('pred')}), '{M.NO_MOVE.replace('(?i)', '')}')::int::double else {_jac('p', 'g')} end, 6) as score from y")
def metric_uci_set(spark, sf):
    return _scored(M.uci_set_jaccard(F.col("pred"), F.col("gold")), answers(spark, sf))


def _state_sql(t: str) -> str:
    low = f"lower({_strip(t)})"
    said = f"regexp_replace({low}, '\\b(?:no|not)\\s+(?:a\\s+)?checkmate\\b', ' ', 'g')"
    return f"""case when contains({low}, 'normal') or {low} in ('none', 'no') or regexp_matches({low}, '\\bno\\s+checks?\\b') then 'normal' when regexp_matches({said}, '\\bcheckmate\\b') then 'checkmate'
  when regexp_matches({said}, '\\bstalemate\\b') then 'stalemate' when regexp_matches({said}, '\\bchecks?\\b') then 'check' end"""


@query(_ANSWERS_SQL + f", {_both(_state_sql)} select event_id, task, {_eq('p', 'g')} as score from y")
def metric_check_state(spark, sf):
    return _scored(M.check_state_accuracy(F.col("pred"), F.col("gold")), answers(spark, sf))


def _bucket_sql(t: str) -> str:
    low = f"lower({_strip(t)})"
    return f"""case when contains({low}, 'equal') then 'equal' when contains({low}, 'white') = contains({low}, 'black') then null else
  (case when contains({low}, 'white') then 'w' else 'b' end) || (case when contains({low}, 'forced mate') then 'forced mate' when contains({low}, 'slight edge') then 'slight edge'
  when contains({low}, 'clear advantage') then 'clear advantage' when contains({low}, 'winning') then 'winning' when contains({low}, 'decisive') then 'decisive' when contains({low}, 'slight') then 'slight edge' end) end"""


@query(_ANSWERS_SQL + f", {_both(_bucket_sql)} select event_id, task, {_eq('p', 'g')} as score from y")
def metric_eval_bucket(spark, sf):
    return _scored(M.eval_bucket_accuracy(F.col("pred"), F.col("gold")), answers(spark, sf))


def _rules_sql(t: str) -> str:
    said = f"list_filter(regexp_split_to_array(lower({t}), '[.!?\\n]'), lambda s: not regexp_matches(s, '\\b(?:no|not|none|without|unavailable)\\b'))"
    kinds = (("\\bcastl(?:e|ing)\\b", "kingside|queenside"), ("\\ben\\s+passant\\b", "\\b[a-h][1-8][a-h][1-8]\\b"), ("\\bpromot(?:e|es|ed|ing|ion|ions)\\b", "\\b[a-h][1-8][a-h][1-8][qrbn]\\b"))
    parts = [f"list_transform(flatten(list_transform(list_filter({said}, lambda s: regexp_matches(s, '{w}')), lambda s: regexp_extract_all(s, '{m}'))), lambda m: '{i}' || m)" for i, (w, m) in enumerate(kinds)]
    return f"list_sort(list_distinct(list_concat({', '.join(parts)})))"


@query(_ANSWERS_SQL + f", {_both(_rules_sql)} select event_id, task, {_eq('p', 'g')} as score from y")
def metric_special_rules(spark, sf):
    return _scored(M.special_rules_accuracy(F.col("pred"), F.col("gold")), answers(spark, sf))


def _items_sql(pattern: str):
    return lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '{pattern}'), lambda m: regexp_replace(lower(m), '\\s+', ' ', 'g')))"


_INVENTORY = _items_sql(M.INVENTORY_ITEM)


@query(_ANSWERS_SQL + f", {_both(_INVENTORY)} select event_id, task, round({_f1('p', 'g')}, 6) as score from y")
def metric_side_inventory(spark, sf):
    return _scored(M.side_inventory_f1(F.col("pred"), F.col("gold")), answers(spark, sf))


def _hanging_sql(t: str) -> str:
    low = f"lower({t})"
    rest = f"case when contains({low}, 'hanging pieces:') then string_split({low}, 'hanging pieces:')[-1] else {low} end"
    return f"case when not contains({low}, 'hanging pieces:') and contains({low}, 'no hanging pieces') then [] else {_items_sql(M.HANGING_ITEM)(rest)} end"


@query(_ANSWERS_SQL + f", {_both(_hanging_sql)} select event_id, task, round({_f1('p', 'g')}, 6) as score from y")
def metric_hanging(spark, sf):
    return _scored(M.hanging_f1(F.col("pred"), F.col("gold")), answers(spark, sf))


def _threats_sql(t: str) -> str:
    low = f"lower({_strip(t)})"
    rest = f"regexp_replace({low}, '(?s)^.*?threatens:', '')"
    items = f"list_filter(list_transform(string_split({rest}, ','), lambda i: {_strip('i')}), lambda i: i <> '')"
    return f"case when contains({low}, 'no immediate threats') or (contains({low}, 'no ') and contains({low}, 'threat')) then [] else list_distinct(list_transform({items}, lambda i: rtrim(i, '.'))) end"


@query(_ANSWERS_SQL + f", {_both(_threats_sql)} select event_id, task, round({_f1('p', 'g')}, 6) as score from y")
def metric_threats(spark, sf):
    return _scored(M.threat_f1(F.col("pred"), F.col("gold")), answers(spark, sf))


def _yes_no_sql(t: str) -> str:
    low = f"lower({_strip(t)})"
    no, yes = "\\bno\\b|\\billegal\\b|\\bnot\\s+legal\\b", "\\byes\\b|\\blegal\\b"
    return f"case when regexp_matches({low}, '{no}') then case when not regexp_matches(regexp_replace({low}, '{no}', ' ', 'g'), '{yes}') then 'no' end when regexp_matches({low}, '{yes}') then 'yes' end"


@query(_ANSWERS_SQL + f", {_both(_yes_no_sql)} select event_id, task, {_eq('p', 'g')} as score from y")
def metric_legality(spark, sf):
    return _scored(M.legality_accuracy(F.col("pred"), F.col("gold")), answers(spark, sf))


def _reason_sql(t: str) -> str:
    said = f"coalesce(nullif(regexp_extract({t}, '(?is)\\breason\\s*:\\s*(.+)', 1), ''), {t})"
    bare = f"(' ' || {_strip(f'''regexp_replace(regexp_replace(regexp_replace(lower({said}), '[_-]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')''')} || ' ')"
    return "case " + " ".join(f"when contains({bare}, ' {r.replace('_', ' ')} ') then '{r}'" for r in sorted(M.REASON_LABELS, key=len, reverse=True)) + " end"


@query(_ANSWERS_SQL + f", {_both(_reason_sql)} select event_id, task, case when g is not null then {_eq('p', 'g')} end as score from y")
def metric_legality_reason(spark, sf):
    return _scored(M.reason_accuracy(F.col("pred"), F.col("gold")), answers(spark, sf))


def _grammar_sql(grammar: tuple):
    def build(t: str) -> str:
        own = _lines(t)
        fits = " and ".join(f"regexp_matches({own}[{i + 1}], '(?i)^{n}:\\s*({v})\\s*$')" for i, (n, v) in enumerate(grammar))
        values = ", ".join(f"regexp_replace(lower(regexp_extract({own}[{i + 1}], '(?i)^{n}:\\s*({v})\\s*$', 1)), '\\s+', ' ', 'g')" for i, (n, v) in enumerate(grammar))
        return f"case when len({own}) = {len(grammar)} and {fits} then [{values}] end"

    return build


def _parts_sql(n: int, last=lambda x: x) -> str:
    same = [_eq(f"p[{i}]", f"g[{i}]") for i in range(1, n)] + [_eq(last(f"p[{n}]"), last(f"g[{n}]"))]
    return f"round(({' + '.join(same)}) / {n}, 6)"


_STEP_OK = " and ".join(f"({v}[1] = 'sound') = ({v}[2] = 'none') and ({v}[1] = 'sound') = ({v}[3] = 'none') and ({v}[1] = 'broken' or {v}[4] = 'none') and {v}[3] in ({', '.join(map(_literal, M.ERROR_TYPES))})" for v in ("p", "g"))


@query(_ANSWERS_SQL + f", {_both(_grammar_sql(M.STEP_LINES))} select event_id, task, case when p is not null and g is not null and {_STEP_OK} then {_parts_sql(4)} else 0 end as score from y")
def metric_step_verification(spark, sf):
    return _scored(M.step_scores(F.col("pred"), F.col("gold"))["primary"], answers(spark, sf))


@query(_ANSWERS_SQL + f", {_both(_grammar_sql(M.CLAIM_LINES))} select event_id, task, {_parts_sql(5, lambda x: f'''rtrim({x}, '.')''')} as score from y")
def metric_claim_verification(spark, sf):
    return _scored(M.claim_scores(F.col("pred"), F.col("gold"))["primary"], answers(spark, sf))


def _best_line_sql(t: str) -> str:
    grab = lambda i: f"lower(regexp_extract({t}, '{M.BEST_LINE}', {i}))"
    return f"case when regexp_matches({t}, '{M.BEST_LINE}') then struct_pack(root := {grab(1)}, bucket := {grab(3)}, pv := string_split({grab(4)}, ' '), best := {grab(5)}, move := {grab(6)}) end"


@query(_ANSWERS_SQL + f""", {_both(_best_line_sql)}, z as (select *, [i for i in range(1, len(g.pv) + 1) if coalesce(p.pv[i] <> g.pv[i], true)] as off from y)
select event_id, task, coalesce(round(({_eq('p.root', 'g.root')} + {_eq('p.best', 'g.best')} + {_eq('p.move', 'g.move')} + {_eq('p.bucket', 'g.bucket')}
  + case when p is null then 0 when len(off) = 0 then 1 else (off[1] - 1) / len(g.pv) end) / 5, 6), 0) as score from z""")
def metric_best_line(spark, sf):
    return _scored(M.best_line_scores(F.col("pred"), F.col("gold"))["primary"], answers(spark, sf))


def _ratings_sql(t: str) -> str:
    own = _lines(t)
    cand, best = M.CANDIDATE, M.CANDIDATE_BEST
    rated = f"list_filter({own}, lambda l: regexp_matches(l, '{cand}'))"
    bests = f"list_filter({own}, lambda l: regexp_matches(l, '{best}'))"
    return f"""case when len({rated}) = 5 and len({bests}) > 0 and len({rated}) + len({bests}) = len({own}) then struct_pack(u := list_transform({rated}, lambda l: lower(regexp_extract(l, '{cand}', 1))),
  k := list_transform({rated}, lambda l: lower(regexp_extract(l, '{cand}', 3))), best := lower(regexp_extract({bests}[-1], '{best}', 1))) end"""


@query(_ANSWERS_SQL + f""", {_both(_ratings_sql)} select event_id, task, case when p is null or g is null then 0 else round((
  {_jac('list_distinct(p.u)', 'list_distinct(g.u)')} + {_eq('p.best', 'g.best')} + len(list_filter([1, 2, 3, 4, 5], lambda i: p.k[i] = g.k[i])) / 5) / 3, 6) end as score from y""")
def metric_candidate_ratings(spark, sf):
    return _scored(M.candidate_scores(F.col("pred"), F.col("gold"))["primary"], answers(spark, sf))


def _pieces_sql(t: str) -> str:
    """Counts behind each colour's name, up to the next colour."""
    chunks = f"regexp_split_to_array(regexp_replace({t}, '(?i)\\b(white|black)\\b', '§\\1', 'g'), '§')"
    sides = []
    for color in ("white", "black"):
        said = f"array_to_string(list_filter({chunks}, lambda c: regexp_matches(c, '(?i)^{color}\\b')), ' | ')"
        sides.append(f"[{', '.join(f'''regexp_extract_all({said}, '(?i)\\b(\\d+)\\s+{p}s?\\b', 1)[-1]''' for p in M.PIECES)}]")
    some = " and ".join(f"len(list_filter({s}, lambda n: n is not null)) > 0" for s in sides)
    return f"case when {some} then list_transform(list_concat({', '.join(sides)}), lambda n: coalesce(n::int, 0)) end"


@query(_ANSWERS_SQL + f""", {_both(_pieces_sql)} select event_id, task, case when p is null or g is null then {_eq(f"lower({_strip('pred')})", f"lower({_strip('gold')})")} else {_eq('p', 'g')} end as score,
  round(case when p is not null and g is not null then len(list_filter(range(1, 13), lambda i: p[i] = g[i])) / 12 end, 6) as piece_accuracy from y""")
def metric_material_count(spark, sf):
    return answers(spark, sf).select("event_id", "task", M.material_count_accuracy(F.col("pred"), F.col("gold")).alias("score"), F.round(M.material_piece_accuracy(F.col("pred"), F.col("gold")), 6).alias("piece_accuracy"))


def _groups_sql(t: str) -> str:
    own = f"list_filter(string_split({t}, chr(10)), lambda l: regexp_matches(l, '{M.PIECE_LINE}'))"
    return f"list_transform({own}, lambda l: struct_pack(q := lower(regexp_extract(l, '{M.PIECE_LINE}', 1)), m := {_set(f'''regexp_extract(l, '{M.PIECE_LINE}', 2)''')}))"


_MOVE_LINE = lambda t: f"case when regexp_matches({t}, '(?im)^\\s*All legal moves:') then {_set(f'''regexp_extract({t}, '(?im)^\\s*All legal moves:[ ]*(.*?)\\s*$', 1)''')} else {_set(t)} end"


@query(_ANSWERS_SQL + f""", {_both(_groups_sql)}, s as (select *, list_distinct(list_concat(list_transform(p, lambda r: r.q), list_transform(g, lambda r: r.q))) as squares, {_MOVE_LINE('pred')} as pm, {_MOVE_LINE('gold')} as gm from y),
j as (select event_id, avg({_jac('a', 'b')} * (na * nb)::int) as per_piece from (select event_id, na > 0 as na, nb > 0 as nb, a, b from (select event_id, len(list_filter(p, lambda r: r.q = q)) as na, len(list_filter(g, lambda r: r.q = q)) as nb,
  list_distinct(flatten(list_transform(list_filter(p, lambda r: r.q = q), lambda r: r.m))) as a, list_distinct(flatten(list_transform(list_filter(g, lambda r: r.q = q), lambda r: r.m))) as b from (select *, unnest(squares) as q from s))) group by event_id)
select s.event_id, task, round(({' + '.join(f"contains(lower(pred), '{m}')::int" for m in M.SECTIONS)}) / 4, 6) as sections, round({_f1(_INVENTORY('pred'), _INVENTORY('gold'))}, 6) as inventory,
  round({_f1('pm', 'gm')}, 6) as set_f1, len(list_filter(pm, lambda m: not list_contains(gm, m)))::double as extra, len(list_filter(gm, lambda m: not list_contains(pm, m)))::double as missing,
  round(case when len(squares) = 0 then {_eq(_strip('pred'), _strip('gold'))} else per_piece end, 6) as per_piece from s left join j on s.event_id = j.event_id""".replace("(na * nb)::int", "(na and nb)::int"))
def metric_by_piece(spark, sf):
    s = M.by_piece_scores(F.col("pred"), F.col("gold"))
    return answers(spark, sf).select("event_id", "task", s.alias("s")).select(
        "event_id", "task", F.round("s.section_completeness", 6).alias("sections"), F.round("s.piece_inventory_accuracy", 6).alias("inventory"), F.round("s.set_f1", 6).alias("set_f1"),
        F.col("s.illegal_extra_count").alias("extra"), F.col("s.missing_move_count").alias("missing"), F.round("s.per_piece_group_jaccard", 6).alias("per_piece"),
    )


def _section_sql(name: str):
    return lambda t: f"list_distinct(flatten(list_transform(list_filter(string_split(lower({t}), chr(10)), lambda l: starts_with(ltrim(l), '{name}')), lambda l: {_list('l')})))"


@query(_ANSWERS_SQL + f"""select event_id, task, round(({' + '.join(_f1(_section_sql(n)('pred'), _section_sql(n)('gold')) for n in M.FILTER_SECTIONS)}) / 3, 6) as score,
  round(case when contains(lower(pred), 'all legal moves:') and contains(lower(gold), 'all legal moves:') then {_jac(*[_set(f"string_split(lower({t}), 'all legal moves:')[-1]") for t in ('pred', 'gold')])} end, 6) as final_jaccard from x""")
def metric_legal_filter(spark, sf):
    return answers(spark, sf).select("event_id", "task", F.round(M.legal_filter_f1(F.col("pred"), F.col("gold")), 6).alias("score"), F.round(M.filter_trace_jaccard(F.col("pred"), F.col("gold")), 6).alias("final_jaccard"))


def _opening_sql(t: str) -> str:
    code = "(?i)\\bECO\\s*:\\s*[A-E]\\d{2}\\b"
    bare = f"trim(regexp_replace(regexp_replace({t}, '{code}', ' ', 'g'), '\\(\\s*\\)', ' ', 'g'), ' .:;-' || chr(10))"
    name = f"trim(regexp_replace({bare}, '(?i)^(?:the\\s+opening\\s+is|opening\\s*:|answer\\s*:)\\s*', ''), ' .:;-' || chr(10))"
    return f"[upper(regexp_extract({t}, '(?i)\\bECO\\s*:\\s*([A-E]\\d{{2}})\\b', 1)), trim(regexp_extract(regexp_replace(lower({name}), '\\s+', ' ', 'g'), '^[^:;,]*'))]"


@query(_ANSWERS_SQL + f""", {_both(_opening_sql)} select event_id, task, greatest({_eq(f"lower({_strip('pred')})", f"lower({_strip('gold')})")},
  (p[1] <> '' and g[1] <> '' and p[1][1:2] = g[1][1:2])::int, (p[2] <> '' and p[2] = g[2])::int)::double as score, (p[1] <> '' and p[1] = g[1])::int::double as eco_exact from y""")
def metric_opening(spark, sf):
    s = M.opening_scores(F.col("pred"), F.col("gold"))
    return answers(spark, sf).select("event_id", "task", s["primary"].alias("score"), s["eco_exact"].alias("eco_exact"))


_GOLD_MOVE = _first(_plain('gold'))


@query(_ANSWERS_SQL + f"select event_id, task, {_eq(_first(_plain('pred')), f'''lower({_strip(f'coalesce({_GOLD_MOVE}, gold)')})''')} as score from x")
def metric_tactical(spark, sf):
    return _scored(M.tactical_scores(F.col("pred"), F.col("gold"))["primary"], answers(spark, sf))
