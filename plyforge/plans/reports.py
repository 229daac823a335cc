"""Queries of reports, gates, links, splits and row validation, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traces as T
from ..functions.answers import TASKS
from ..functions.chess_udfs import legal_moves, play_move
from ..operators import eval_splits as E
from ..operators import generators as G
from ..operators import reports as R
from ..operators import validate as V
from ..sources import rule_boards as RB
from ..sources import sampling as S
from ..functions import protocol as P
from ..store import spread
from . import boards as BD
from .catalog import SEED, query, table


@query("""
with v as (select l_returnflag, l_extendedprice as v from lineitem), g as (select l_returnflag, avg(v) as acpl, quantile_disc(v, 0.5) as acpl_median, quantile_disc(v, 0.9) as acpl_p90, quantile_disc(v, 0.95) as acpl_p95 from v group by 1
  union all select null, avg(v), quantile_disc(v, 0.5), quantile_disc(v, 0.9), quantile_disc(v, 0.95) from v)
select l_returnflag, metric, round(value, 4) as value from (unpivot g on acpl, acpl_median, acpl_p90, acpl_p95 into name metric value value)""")
def loss_summary(spark, sf):
    """Mean and nearest ranks of a measure, by group and over all."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return R.acpl_summary(rows, ["l_returnflag"], "v").withColumn("value", F.round("value", 4))


@query("""
with s as (select o_orderpriority as task, o_custkey as prompt, o_totalprice::double as wpd, case when o_orderkey % 3 <> 0 then (o_orderkey % 100)::double end as reward, case when o_orderkey % 5 <> 0 then o_orderkey % 2 = 0 end as cache_hit from orders),
m as (select task, avg(wpd) as wpd, avg(reward) as reward, avg(cache_hit::int) as cache_hit_rate from s group by task),
u as (select task, metric, value from (unpivot m on wpd, reward, cache_hit_rate into name metric value value) union all
  select task, 'reward_std_per_prompt', avg(d) from (select task, prompt, stddev_pop(reward) as d from s where reward is not null group by all) group by task)
select task, metric, round(value, 4) as value from u""")
def win_probability_summary(spark, sf):
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("task"), F.col("o_custkey").alias("prompt"), F.col("o_totalprice").cast("double").alias("wpd"),
        F.when(key % 3 != 0, (key % 100).cast("double")).alias("reward"), F.when(key % 5 != 0, key % 2 == 0).alias("cache_hit"),
    )
    return R.wpd_summary(rows, ["task"], "prompt").withColumn("value", F.round("value", 4))


@query("""
with r as (select (event_id % 3 + 1) || '.' || event_type as task, user_id % 4 = 0 as is_960, event_id % 7 <> 0 as passed from events where event_id is not null and user_id is not null and event_type is not null)
select task, coalesce(case task when '1.view' then 100 when '2.click' then 50 end, 0)::bigint as target, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(avg(is_960::int), 4) as chess960_share from r group by task""")
def task_stats(spark, sf):
    targets = spark.createDataFrame([("1.view", 100), ("2.click", 50)], "task string, target long")
    return R.task_stats(_generated(spark, sf), targets)


def _generated(spark, sf):
    e = table(spark, sf, "events").filter("event_id is not null and user_id is not null and event_type is not null")
    return e.select(F.concat_ws(".", (F.col("event_id") % 3 + 1).cast("string"), "event_type").alias("task"), (F.col("user_id") % 4 == 0).alias("is_chess960"), (F.col("event_id") % 7 != 0).alias("passed"))


@query("""
with r as (select (event_id % 3 + 1)::int as tier, avg((user_id % 4 = 0)::int) as a from events where event_id is not null and user_id is not null and event_type is not null group by 1), t as (select *, case tier when 1 then 0.3 when 2 then 0.2 else 0.0 end::double as target from r)
select tier, target, round(a, 4) as actual, round(a - target, 4) as delta from t""")
def chess960_shares(spark, sf):
    return R.chess960_mix(_generated(spark, sf), spark.createDataFrame([(1, 0.3), (2, 0.2)], "tier int, ratio double"))


@query("""
with m as (select source || '.quality' as key, round(avg(quality), 6) as value from documents join labels using (doc_id) group by source union all select 'toxic', round(avg(toxic), 6) from labels),
c(name, metric, lo, hi) as (values ('toxic_low', 'toxic', null::double, 0.5::double), ('quality_there', 'quality', 0.1::double, null), ('wpd_there', 'wpd', null, null)),
f as (select name, metric, any_value(lo) as lo, any_value(hi) as hi, arg_min(value, (key <> metric)::int || key) filter (key is not null) as value from c left join m on key = metric or ends_with(key, '_' || metric) or ends_with(key, '.' || metric) group by all)
select name, metric, value, (value is not null and (lo is null or value >= lo) and (hi is null or value <= hi)) as passed, case when value is null then 'missing_metric' when (lo is null or value >= lo) and (hi is null or value <= hi) then 'present' else 'threshold' end as reason from f
union all select 'step_verification_metadata_breakdowns', null, null, false, 'missing: corruption_kind'""")
def measurement_gate(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    own = docs.join(labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("value")).select(F.concat("source", F.lit(".quality")).alias("key"), "value")
    metrics = own.unionByName(labels.agg(F.round(F.avg("toxic"), 6).alias("value")).select(F.lit("toxic").alias("key"), "value"))
    checks = spark.createDataFrame([("toxic_low", "toxic", None, 0.5), ("quality_there", "quality", 0.1, None), ("wpd_there", "wpd", None, None)], "name string, metric string, at_least double, at_most double")
    fields = spark.createDataFrame([("source_task", 3), ("error_type", 1)], "field string, n int")
    return R.gate_report(metrics, checks, fields)


@query("""
with h as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as href from pages),
b as (select *, case when not regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:|^//|[?#]') then href end as path from h)
select page_id, href, case when ends_with(path, '/') and rtrim(path, '/') not in ('', '.', '..') and not contains(rtrim(path, '/'), '/') and not contains(path, '\\') then rtrim(path, '/') || '/' end as folder,
  case when not regexp_matches(path, '[/\\\\]|^\\.') and regexp_matches(path, '\\.(?:rtbw|rtbz)$') then path end as file from b where href not like '%\\%%' escape '\\'""")
def safe_links(spark, sf):
    """Links of pages that lead to a folder below or a table file; none that are encoded
    are in the twin's answer."""
    from ..functions.text import hrefs

    rows = table(spark, sf, "pages").select("page_id", F.explode(hrefs(F.col("html"))).alias("href")).filter(~F.contains("href", F.lit("%")))
    return rows.select("page_id", "href", S.safe_dir(F.col("href")).alias("folder"), S.safe_file(F.col("href")).alias("file"))


def _known(own: DataFrame) -> DataFrame:
    """The boards with ``extra``: what an engine, a tablebase, a puzzle, a game and an
    opening book would add, made up from a board's legal moves and a hash. Values are
    any; moves can be played."""
    own = spread(own).withColumn("_moves", legal_moves(F.col("fen"))).withColumn("_best", F.get("_moves", F.lit(0)))
    own = own.withColumn("_line", F.concat_ws(" ", "_best", F.get(legal_moves(play_move(F.col("fen"), F.col("_best"))), F.lit(0))))
    moves, best, line, n = F.col("_moves"), F.col("_best"), F.col("_line"), F.pmod(F.xxhash64(F.lit(SEED), "fen"), F.lit(1201)).cast("int")
    mate = F.when(n % 7 == 0, n % 5 + 1)
    rated = F.transform(F.slice(moves, 1, 5), lambda m, i: F.struct(
        m.alias("uci"), F.when((i > 0) | mate.isNull(), n - 600 - 90 * i).alias("cp"), F.when(i == 0, mate).alias("mate"), F.when(i == 0, line).otherwise(m).alias("pv"),
    ))
    extra = {
        "solution_first_move": best, "themes": F.array(F.lit("fork"), F.lit("mateIn2")), "rating": F.lit(1500),
        "best_move": best, "pv_line": line, "cp": F.when(mate.isNull(), n - 600), "mate": mate, "candidate_ratings": rated, "wdl": n % 5 - 2,
        "move_played_uci": best, "move_history": F.lit("e2e4 e7e5"), "game_id": F.lit("g"), "ply": F.lit(3),
        "name": F.lit("Test Opening: Line"), "eco": F.lit("C20"), "uci_moves": F.lit("e2e4 e7e5"), "book_moves": F.transform(F.slice(moves, 1, 3), lambda m, i: F.array(m, (3 - i).cast("string"))),
    }
    return own.select("fen", F.to_json(F.struct(*[c.alias(k) for k, c in extra.items()])).alias("extra"))


@query()
def validated_rows(spark, sf):
    """Rows of every task made from a position, those that need an engine and those that
    verify traces too, generated and checked; none is wrong."""
    own = _known(BD.boards(spark, sf, "supplier", "s_suppkey").select("fen").distinct())
    rows = G.task_rows(own, sorted(TASKS)).unionByName(G.step_rows(G.task_rows(own, sorted(T.CASES))))
    templates = [(t, "FEN: {fen}") for t in TASKS] + [(G.STEPS, "FEN: {fen}\nTrace to verify:\n{verification_trace}")]
    made = G.training_rows(rows, spark.createDataFrame(templates, "task string, template string"))
    return V.row_errors(made).groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("wrong"))


@query(BD._boards_sql("customer", "c_custkey") + f"""k as (select array_to_string(string_split(fen, ' ')[1:4], ' ') as f, fen from boards),
p as (select f, 'perception' as split from (select *, row_number() over (order by sha256('{SEED}:perception:std:' || f)) as r from k) where r <= 20),
t as (select f, 'tactics' as split from (select *, row_number() over (order by sha256('{SEED}:tactics:std:' || f)) as r from k where f not in (select f from p)) where r <= 10)
select split, 'std:' || f as pos_key from p union all select split, 'std:' || f from t""")
def held_out_splits(spark, sf):
    """Two splits in their order; no position is in both."""
    own = BD.boards(spark, sf, "customer", "c_custkey").select("fen").distinct().withColumn("pos_key", P.variant_key(F.col("fen")))
    return E.generate_splits({"perception": own, "tactics": own}, {"perception": 20, "tactics": 10}, SEED).select("split", "pos_key")


@query()
def sampled_chess960(spark, sf):
    """As many Chess960 positions as there are suppliers."""
    return S.chess960_positions(spark, table(spark, sf, "supplier").count(), 8, SEED).select("n_row", "fen", "chess960_id", "n_moves_applied")


@query()
def rule_positions(spark, sf):
    return RB.rule_positions(spark, table(spark, sf, "nation").count(), seed=SEED)


@query()
def sampled_endgames(spark, sf):
    return S.endgame_positions(spark, ["KPK", "KRK", "KQKP", "KRPKR", "KBNK"], table(spark, sf, "nation").count(), SEED)
