"""Queries over positions: answers of board tasks, training rows, splits, mixes.

The tables hold no positions, so these queries set some up: the ranks of a board follow
from an event's number, and are chosen so that white, who moves, never attacks the black
king. The same text is built in SQL, which then answers the tasks that need no rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import keys as K
from ..functions import protocol as P
from ..functions import traces as T
from ..functions.answers import BENCHMARK, TASKS
from ..operators import benchmark as BM
from ..operators import decontaminate as D
from ..operators import generators as G
from ..operators import judging as J
from ..operators import mixer as MX
from ..operators import ranking, splits
from ..store import fresh_path
from .catalog import SEED, query, table

#: What stands on each rank, from the eighth down: neither side has more than sixteen
#: pieces or eight pawns, and the files and diagonals of the black king are closed.
RANKS = (
    ("r1bqk2r", "r3kb1r", "2bqk3", "4k2r", "r2qk1nr"), ("pppppppp", "p1pppp1p", "3ppp2", "pp1ppp1p"), ("8", "2n2n2", "8", "5n2"), ("8", "8", "2n5"),
    ("8", "4P3", "2N2N2", "P6P", "3Q4", "1B6"), ("8", "2N2N2", "8", "5B2", "7R"), ("8", "PPP2PPP", "P4PPP", "3P4"), ("R1BQKB1R", "R3K2R", "4K3", "R1BQK2R"),
)
_STEP = (1, 3, 5, 7, 11, 13, 17, 19)
_NAMES = {"k": "king", "q": "queen", "r": "rook", "b": "bishop", "n": "knight", "p": "pawn"}
_POINTS = {"k": 0, "q": 9, "r": 5, "b": 3, "n": 3, "p": 1}


def _sql_rank(i: int) -> str:
    return f"[{', '.join(repr(r) for r in RANKS[i])}][(event_id // {_STEP[i]} % {len(RANKS[i])} + 1)::int]"


def _boards_sql(source: str = "events", key: str = "event_id") -> str:
    return f"""with f as (select event_id, {" || '/' || ".join(_sql_rank(i) for i in range(8))} as field from (select {key}::bigint as event_id from {source} where {key} is not null)),
b as (select event_id, field || ' w - - 0 1' as fen, {"replace(" * 8}replace(field, '/', ''){"".join(f", '{n}', '{'.' * n}')" for n in range(1, 9))} as x from f),
boards as (select fen, x from b group by all),
"""


_BOARDS_SQL = _boards_sql()


def boards(spark, sf, source: str = "events", key: str = "event_id") -> DataFrame:
    """(event_id, fen): a board for each row of a table that has the key."""
    e = table(spark, sf, source).select(F.col(key).cast("long").alias("event_id")).filter("event_id is not null")
    ranks = [F.expr(f"element_at(array({', '.join(repr(r) for r in RANKS[i])}), cast(event_id div {_STEP[i]} % {len(RANKS[i])} + 1 as int))") for i in range(8)]
    return e.select("event_id", F.concat(F.concat_ws("/", *ranks), F.lit(" w - - 0 1")).alias("fen"))


def _fewer(spark, sf) -> DataFrame:
    """Boards of customers, for queries that work out the rules on each."""
    return boards(spark, sf, "customer", "c_custkey")


# s counts squares from a1; cells are written from a8
_CELL = "x[((7 - s // 8) * 8 + s % 8 + 1)::int]"
_SQUARE = "chr((97 + s % 8)::int) || (1 + s // 8)"


def _where(piece: str) -> str:
    return f"list_transform(list_filter(range(64), lambda s: {_CELL} = '{piece}'), lambda s: {_SQUARE})"


def _side(white: bool) -> dict[str, str]:
    return {k: _where(k.upper() if white else k) for k in _NAMES}


def _count(piece: str) -> str:
    return f"(length(x) - length(replace(x, '{piece}', '')))"


def _points(white: bool) -> str:
    return "(" + " + ".join(f"{v} * {_count(k.upper() if white else k)}" for k, v in _POINTS.items()) + ")"


def _vector(white: bool, what: str) -> str:
    case = lambda k: k.upper() if white else k
    parts = {
        "inventory": [f"'{n}=' || coalesce(nullif(array_to_string({_where(case(k))}, ','), ''), 'none')" for k, n in _NAMES.items()],
        "counts": [f"'{n}=' || {_count(case(k))}" for k, n in _NAMES.items()],
        "values": [*(f"'{n}=' || {_POINTS[k]} * {_count(case(k))}" for k, n in _NAMES.items()), f"'total=' || {_points(white)}"],
    }[what]
    return "(" + " || '; ' || ".join(parts) + ")"


def _lead(up: str, end: str) -> str:
    w, b = _points(True), _points(False)
    return f"(case when {w} > {b} then 'White is {up} ' || ({w} - {b}) || ' point(s){end}' when {w} < {b} then 'Black is {up} ' || ({b} - {w}) || ' point(s){end}' else 'Material is equal.' end)"


def _listed(white: bool, plural: bool) -> str:
    own = ", ".join(f"struct_pack(n := '{n}', c := {_count(k.upper() if white else k)})" for k, n in sorted(_NAMES.items(), key=lambda kn: kn[1]))
    suffix = " || case when y.c > 1 then 's' else '' end" if plural else ""
    return f"array_to_string(list_transform(list_filter([{own}], lambda y: y.c > 0), lambda y: y.c || ' ' || y.n{suffix}), ', ')"


def _pieces(white: bool) -> str:
    return "(" + " + ".join(_count(k.upper() if white else k) for k in _NAMES) + ")"


_PHRASE = "case when {0} = upper({0}) then 'white ' else 'black ' end || case lower({0}) " + " ".join(f"when '{k}' then '{n}'" for k, n in _NAMES.items()) + " end"

_TASK_SQL = {
    "1.1_fen_to_board": "array_to_string(list_transform(range(8), lambda i: (8 - i) || ' ' || array_to_string(regexp_split_to_array(x[(8 * i + 1)::int:(8 * i + 8)::int], ''), ' ')), chr(10)) || chr(10) || '  a b c d e f g h'",
    "1.2_board_to_fen": "fen",
    "1.4_piece_counting": f"'White (' || {_pieces(True)} || ' pieces): ' || {_listed(True, True)} || '. Black (' || {_pieces(False)} || ' pieces): ' || {_listed(False, True)} || '. ' || {_lead('up', ' of material.')}",
    "1.15_material_inventory": f"'White inventory: ' || {_vector(True, 'inventory')} || '.' || chr(10) || 'Black inventory: ' || {_vector(False, 'inventory')} || '.'",
    "1.16_material_piece_counts": f"'White counts: ' || {_vector(True, 'counts')} || '.' || chr(10) || 'Black counts: ' || {_vector(False, 'counts')} || '.'",
    "1.17_material_value_totals": f"'White values: ' || {_vector(True, 'values')} || '.' || chr(10) || 'Black values: ' || {_vector(False, 'values')} || '.'",
    "1.18_material_balance_trace": f"'Inventory: white ' || {_vector(True, 'inventory')} || ' | black ' || {_vector(False, 'inventory')} || chr(10) || 'Counts: white ' || {_vector(True, 'counts')} || ' | black ' || {_vector(False, 'counts')} || chr(10) || 'Values: white total=' || {_points(True)} || '; black total=' || {_points(False)} || chr(10) || 'Balance: ' || {_lead('up', ' of material.')}",
    "2.0_side_piece_inventory": f"'Side to move: white.' || chr(10) || 'Pieces: ' || array_to_string(list_transform(list_filter(range(64), lambda s: {_CELL} in ('K', 'Q', 'R', 'B', 'N', 'P')), lambda s: {_SQUARE} || ' ' || {_PHRASE.format(_CELL)}), '; ') || '.'",
    "4.1_material_balance": f"'White: ' || {_listed(True, False)} || ' (' || {_points(True)} || ' pts). Black: ' || {_listed(False, False)} || ' (' || {_points(False)} || ' pts). ' || {_lead('ahead by', '.')}",
    "6.1_endgame_classification": f"'This is a ' || {' || '.join(f'''repeat('{k.upper()}', {_count(k.upper() if w else k)})''' for w in (True, False) for k in 'kqrbnp')} || ' endgame.'",
}


@query(_BOARDS_SQL + "t as (" + " union all ".join(f"select fen, '{t}' as task, {sql} as answer from boards" for t, sql in _TASK_SQL.items()) + ") select * from t")
def board_tasks(spark, sf):
    """The board tasks that leave nothing to choose and need no rules."""
    return G.task_rows(boards(spark, sf).select("fen").distinct(), list(_TASK_SQL)).select("fen", "task", "answer")


@query(_BOARDS_SQL + f"""t as (select * from boards) select fen, ({_points(True)} - {_points(False)})::bigint * 100 as balance, {' || '.join(f'''repeat('{k.upper()}', {_count(k.upper() if w else k)})''' for w in (True, False) for k in 'kqrbnp')} as signature,
  array_to_string(list_transform(range(8), lambda i: array_to_string(regexp_split_to_array(x[(8 * i + 1)::int:(8 * i + 8)::int], ''), ' ')), chr(10)) as placed, x[29] as e5 from t""")
def board_columns(spark, sf):
    """The same boards read by column expressions alone."""
    fen = F.col("fen")
    return boards(spark, sf).select("fen").distinct().select("fen", B.material_balance(fen).cast("long").alias("balance"), B.material_signature(fen).alias("signature"), B.placed(fen).alias("placed"), B.square_piece(fen, F.lit("e5")).alias("e5"))


#: What an engine, a puzzle or an opening would add, the same on every board.
_EXTRA = '{"solution_first_move":"a1a1","themes":["fork","mateIn2"],"rating":1500,"name":"Test Opening: Line","eco":"C20","book_moves":[["e2e4",3],["d2d4",1]],"cp":40,"wdl":0,"material":null}'


@query()
def task_rows_on_boards(spark, sf):
    """Every task on every board, without the boards of a block list."""
    own = boards(spark, sf, "supplier", "s_suppkey")
    blocked = own.filter("event_id % 50 = 0").select("fen")
    rows = own.select("fen").distinct().withColumn("extra", F.lit(_EXTRA))
    return G.task_rows(rows, sorted(TASKS), blocked).select("task", "tier", "fen", "answer", "example_identity")


_PROMPTS = [(t, f"FEN: {{fen}}\nSide to move: {{side_to_move}}\nTask {t}.") for t in TASKS] + [("1.7_rank_lookup", "Rank {rank} of\n{board}")]


@query()
def training_rows(spark, sf):
    own = _fewer(spark, sf).select("fen").distinct()
    templates = spark.createDataFrame(_PROMPTS, "task string, template string")
    contracts = spark.createDataFrame([("2.1_legal_move_gen", "Answer format: two lines.")], "task string, contract string")
    rows = G.training_rows(G.task_rows(own, sorted(_TASK_SQL) + ["1.7_rank_lookup", "2.1_legal_move_gen"]), templates, contracts)
    return rows.select("task", "tier", "fen", F.to_json("messages").alias("messages"), F.to_json("metadata").alias("metadata"))


@query()
def verification_cases(spark, sf):
    own = _fewer(spark, sf).select("fen").distinct()
    rows = G.task_rows(own, ["1.18_material_balance_trace", "2.10_ray_walk", "2.11_legal_filter_trace"]).select("task", "fen", "answer")
    return T.verification_cases(rows).select("task", "fen", "corruption_kind", "verification_verdict", "faulty_line", "correction", "expected_answer")


_FENS = "regexp_extract_all(text, '[pnbrqkPNBRQK1-8]+(?:/[pnbrqkPNBRQK1-8]+){7} [wb] (?:-|[KQkqA-Ha-h]+) (?:-|[a-h][1-8])(?: \\d+ \\d+)?')"


@query(_BOARDS_SQL + f"""k as (select distinct array_to_string(string_split(fen, ' ')[1:4], ' ') as key from b where event_id % 50 = 0),
r as (select event_id, fen, 'The result is ' || lead(fen) over (order by event_id) || ' then.' as text from b),
h as (select event_id, unnest(list_concat([fen], coalesce({_FENS}, []))) as f from r)
select event_id, count(distinct f) as blocked from h where array_to_string(string_split(f, ' ')[1:4], ' ') in (select key from k) group by event_id""")
def contaminated_rows(spark, sf):
    """Rows that hold a blocked position, as their own or in what an answer says."""
    own = boards(spark, sf)
    following = own.select((F.col("event_id") - 1).alias("event_id"), F.col("fen").alias("next"))
    text = F.concat(F.lit("The result is "), F.col("next"), F.lit(" then."))
    rows = own.join(following, "event_id", "left").select(
        "event_id", "fen", F.lit(False).alias("is_chess960"), F.create_map(F.lit("source"), F.lit("x")).alias("metadata"), F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"))).alias("messages"),
    )
    keys = D.block_keys(own.filter("event_id % 50 = 0"))
    return D.contaminated(rows, keys, "event_id").select("event_id", F.size("fens").cast("long").alias("blocked"))


@query(_BOARDS_SQL + """p as (select array_to_string(string_split(fen, ' ')[1:4], ' ') as fields, count(*) as n from b group by 1)
select 'std:' || fields as pos_key, ['std:' || fields, '960:' || fields] as keys_, n from p""".replace("['std:' || fields, '960:' || fields] as keys_", "'std:' || fields || ' ' || '960:' || fields as both"))
def position_keys(spark, sf):
    """Variant keys of the boards, and the keys that block them."""
    rows = boards(spark, sf).groupBy("fen").agg(F.count("*").alias("n"))
    return rows.select(P.variant_key(F.col("fen")).alias("pos_key"), F.array_join(P.blocking_keys(F.col("fen")), " ").alias("both"), "n")


@query()
def frozen_benchmark(spark, sf):
    """Two splits of the boards with prompts and gold answers, ids dense in each."""
    own = _fewer(spark, sf).withColumn("extra", F.lit(_EXTRA))
    templates = spark.createDataFrame([(t, f"FEN: {{fen}}\n{t}") for t in BENCHMARK], "task_type string, template string")
    out = [BM.freeze_split(own.filter(f"event_id % 2 = {i}"), s, None, "event_id", templates=templates) for i, s in enumerate(("perception", "rules"))]
    return out[0].unionByName(out[1]).select("example_id", "split", "task_type", "metric_type", "fen", "prompt", "gold_answer")


@query(_BOARDS_SQL + "r as (select event_id, row_number() over (order by event_id) - 1 as i, fen from b) select 'x_' || printf('%05d', i) as example_id, fen, [" + ", ".join(f"'{t}'" for t in ("material_inventory", "material_piece_counts", "material_value_totals")) + "][(i % 3)::int + 1] as task_type from r")
def frozen_ids(spark, sf):
    """Tasks in turn and dense ids, on tasks that every position answers."""
    rows = BM.freeze_split(boards(spark, sf), "x", ["material_inventory", "material_piece_counts", "material_value_totals"], "event_id")
    return rows.select("example_id", "fen", "task_type")


# --- refresh ------------------------------------------------------------------------

def _judged(spark, sf):
    own = _fewer(spark, sf)
    m, n = F.col("event_id") % 7, F.col("event_id")
    judged = own.filter("event_id % 11 <> 5").select(
        n.alias("ordinal"), F.concat(F.lit("j"), n).alias("judgment_id"), F.concat(F.lit("r"), n).alias("rollout_id"),
        F.when(m == 0, "parse_failure").when(m == 1, "illegal_move").when(m == 2, "legal_unscored").when(m == 3, "missing_fen").alias("failure_bucket"),
        F.when(m.isin(2, 4, 5, 6), True).when(m < 2, False).alias("legal"), F.when((m >= 4) & (m < 6), (n % 300).cast("double")).alias("regret_cp"), F.lit("e1f1").alias("teacher_move_uci"),
    )
    rolled = own.select(
        F.concat(F.lit("r"), n).alias("rollout_id"), F.concat(F.lit("p"), n).alias("prompt_id"), F.lit("model").alias("model_id"), F.lit("text").alias("raw_output"), F.lit("a2a3").alias("parsed_move"),
    ).filter("cast(substring(rollout_id, 2) as long) % 17 <> 3")
    prompts = own.select(
        F.concat(F.lit("p"), n).alias("prompt_id"), "fen", F.lit(False).alias("is_chess960"), F.when(n % 13 == 0, "eval_bucket").otherwise("best_move").alias("task_type"), F.lit("Best move?").alias("user_prompt"), F.lit("e1f1").alias("gold_answer"),
    )
    return J.refresh_rows(judged, rolled, prompts, cap=40)


@query(_boards_sql("customer", "c_custkey") + """j as (select event_id as n, fen, event_id % 7 as m from b where event_id % 11 <> 5),
t as (select *, fen not like '%KB1R w %' as can, case when m = 0 then '7.4_autodata_format_repair' when m = 1 or (m in (4, 5) and n % 300 >= 100) then '7.5_autodata_move_correction' end as task from j),
r as (select *, case when n % 17 = 3 then 'missing_rollout' when task is null then case m when 2 then 'legal_unscored' when 3 then 'missing_fen' when 6 then 'unscored_legal' else 'low_regret' end
  when n % 13 = 0 then 'non_move_task' when not can then 'missing_target_move' end as reason from t),
d as (select *, case when reason is null and row_number() over (partition by reason is null, task, fen order by n) > 1 then 'duplicate' else reason end as r2 from r),
c as (select *, coalesce(sum((r2 is null)::int) over (order by n rows between unbounded preceding and 1 preceding), 0) as before from d)
select coalesce(case when before >= 40 then 'max_examples' else r2 end, task) as outcome, count(*) as n from c group by 1""")
def refresh_outcomes(spark, sf):
    """How many judgments become which row, or are skipped for which reason."""
    return _judged(spark, sf).groupBy(F.coalesce("reason", "task").alias("outcome")).agg(F.count("*").alias("n"))


@query()
def repair_rows(spark, sf):
    rows = J.repair_rows(_judged(spark, sf))
    return rows.select("task", "tier", "fen", F.to_json("messages").alias("messages"), F.to_json("metadata").alias("metadata"))


# --- evaluation keys and mixes --------------------------------------------------------

#: Event types in order of their names.
_TYPES = ("click", "error", "purchase", "refund", "signup", "view")


def _greedy_sql(source: str, tasks: tuple, share: float) -> str:
    """CTEs k_i(key, task): tasks in order of their names, each key once."""
    parts, held = [], "select null::varchar as key where false"
    for i, t in enumerate(tasks):
        parts.append(f"""o{i} as (select key, n, key in ({held}) as held from {source} where task = '{t}'),
g{i} as (select greatest(1, floor(sum(n) * {share}))::bigint as goal, coalesce(sum(n) filter (held), 0) as have from o{i}),
s{i} as (select key, n, have + sum(n) over (order by n, sha256('{SEED}:' || key)) - n as taken, goal, have, row_number() over (order by n, sha256('{SEED}:' || key)) as r, count(*) over () as groups_ from o{i}, g{i} where not held),
a{i} as (select key from s{i} where taken < goal and 2 * taken + n <= 2 * goal),
k{i} as (select key, '{t}' as task from s{i} where key in (select key from a{i}) or (r = 1 and have = 0 and groups_ >= 2 and not exists (select 1 from a{i})))""")
        held += f" union all select key from k{i}"
    return ",\n".join(parts)


_COUNTS_SQL = "with c as (select user_id::varchar as key, event_type as task, count(*) as n from events where user_id is not null group by all),\n"


@query(_COUNTS_SQL + _greedy_sql("c", _TYPES, 0.1) + " " + " union all ".join(f"select key, task from k{i}" for i in range(len(_TYPES))))
def greedy_eval_keys(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return splits.greedy_keys(counts, "user_id", "event_type", "n", 0.1, SEED)


def _mix_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type").filter("event_id is not null and user_id is not null")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("tier"), F.col("event_type").alias("task"), F.col("user_id").cast("string").alias("key"))


_MIX_SQL = "with r as (select event_id as id, (event_id % 3 + 1)::int as tier, event_type as task, user_id::varchar as key from events where event_id is not null and user_id is not null),\nc as (select key, task, count(*) as n from r group by all),\n" + _greedy_sql("c", _TYPES, 0.05) + ",\ne as (" + " union ".join(f"select key from k{i}" for i in range(len(_TYPES))) + ")"


@query(_MIX_SQL + " select tier, task, case when key in (select key from e) then 'eval' else 'train' end as side, count(*) as n from r group by all")
def held_out_sides(spark, sf):
    """Evaluation keys kept in a state folder, in two steps: tiers 1 and 2 in the first
    build, tier 3 never changes them. All tiers are chosen at once here."""
    rows = _mix_rows(spark, sf)
    keys = MX.load_or_extend_eval_keys(spark, fresh_path(spark, "eval-keys"), rows, 0.05, SEED)
    return MX.with_side(rows, keys).groupBy("tier", "task", "side").agg(F.count("*").alias("n"))


_PHASE = [MX.TierMix(1, 0.5), MX.TierMix(2, 1.0, 2), MX.TierMix(3, 0.25)]
_FRACTIONS = {"purchase": 0.3, "click": 0.2}


def _sampled_sql(n: str) -> str:
    """Rows that a tier's fraction leaves of n."""
    return "case tier " + " ".join(f"when {m.tier} then case when {n} = 0 then 0 else {f'{n}' if m.fraction >= 1 else f'greatest(1, least({n}, round_even({n} * {m.fraction}, 0)))'} end" for m in _PHASE) + " end"


@query(_MIX_SQL + f""", s as (select *, key in (select key from e) as held from r),
q as (select *, row_number() over (partition by tier, held order by sha256('{SEED}:' || case when held then 'eval' else 'train' end || ':' || tier || ':' || id)) as place, count(*) over (partition by tier, held) as whole from s),
p as (select *, ({_sampled_sql('whole')})::bigint as take from q), k as (select * from p where place <= take),
u as (select tier, sum(case when task = 'refund' then 3 else 1 end)::bigint as total from k where not held group by tier),
l as (select tier, total, label, share, total * share as quota, floor(total * share) as f from u, (values ('click', 0.2), ('purchase', 0.3), ('__other__', 0.5)) v(label, share)),
m as (select *, row_number() over (partition by tier order by round(quota - f, 9) desc, case label when 'click' then 0 when 'purchase' then 1 else 2 end) as place, sum(f) over (partition by tier) as whole from l)
select 'train' as side, tier, label, ((f + (place <= total - whole)::int) * case tier when 2 then 2 else 1 end)::bigint as n from m union all select 'eval', tier, 'all', count(*) from k where held group by tier""")
def phase_mix(spark, sf):
    """Rows of a phase by tier: sampled, one task upsampled, two drawn to their shares."""
    rows = _mix_rows(spark, sf)
    keys = splits.greedy_keys(rows.groupBy("key", "task").agg(F.count("*").alias("n")), "key", "task", "n", 0.05, SEED)
    train, held = MX.build_phase(rows, _PHASE, keys, SEED, {"refund": 3}, _FRACTIONS)
    label = F.when(F.col("task").isin(*_FRACTIONS), F.col("task")).otherwise(MX.OTHER)
    out = train.groupBy(F.lit("train").alias("side"), "tier", label.alias("label")).agg(F.count("*").alias("n"))
    return out.unionByName(held.groupBy(F.lit("eval").alias("side"), "tier", F.lit("all").alias("label")).agg(F.count("*").alias("n")))


_SEGMENTS = [MX.Segment("warm", 0.3, ((1, 0.7), (2, 0.3))), MX.Segment("main", 0.5, ((1, 0.2), (2, 0.45), (3, 0.35))), MX.Segment("cool", 0.2, ((3, 1.0),))]


@query(_MIX_SQL + f""", n as (select count(*) as total from r where key not in (select key from e)),
w(segment, fraction, tier, weight) as (values {", ".join(f"({i}, {s.fraction}::double, {t}, {x}::double)" for i, s in enumerate(_SEGMENTS) for t, x in s.weights)}),
a as (select segment, total * fraction / sum(fraction) over () as q, total from (select distinct segment, fraction from w), n),
b as (select *, row_number() over (order by round(q - floor(q), 9) desc, segment) as place from a), c2 as (select segment, (floor(q) + (place <= total - sum(floor(q)) over ())::int)::bigint as rows_ from b),
t as (select segment, tier, rows_, rows_ * weight / sum(weight) over (partition by segment) as q from c2 join w using (segment)),
z as (select *, row_number() over (partition by segment order by round(q - floor(q), 9) desc, tier) as place from t)
select segment::int as segment, tier::int as tier, (floor(q) + (place <= rows_ - sum(floor(q)) over (partition by segment))::int)::bigint as n from z""")
def schedule_mix(spark, sf):
    """Rows of each segment by tier."""
    rows = _mix_rows(spark, sf)
    keys = splits.greedy_keys(rows.groupBy("key", "task").agg(F.count("*").alias("n")), "key", "task", "n", 0.05, SEED)
    train, _, _ = MX.build_schedule(rows, _SEGMENTS, keys, SEED)
    return train.groupBy("segment", "tier").agg(F.count("*").alias("n"))


@query(f"select example_id, line from (select printf('%05d', row_number() over (order by event_id) - 1) as example_id, sha256('{SEED}:' || event_id) as line from events where event_id is not null)")
def dense_hash_ids(spark, sf):
    """Dense ids of five digits at least, beside each row's seeded hash."""
    e = table(spark, sf, "events").select("event_id").filter("event_id is not null")
    ranked = ranking.with_rank(e, [], F.col("event_id"), "i", ranking.number_bucket("event_id", 4096))
    return ranked.select(F.format_string("%05d", F.col("i") - 1).alias("example_id"), K.hash_order(SEED, "event_id").alias("line"))
