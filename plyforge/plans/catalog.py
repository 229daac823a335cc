"""The queries over the driver's tables and their DuckDB twins.

Each keeps the semantics of one operation and applies it to the tables at hand; the
operators are in ``plyforge.operators``, the expressions in ``plyforge.functions``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import keys as K
from ..functions import text as X
from ..operators import dedup, joins, mix, ranking, refresh, scoring, splits, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Seed of the hash orders, and how SQL writes one.
SEED = 42


def _sql_order(key: str, seed: int = SEED) -> str:
    return f"sha256('{seed}:' || coalesce({key}::varchar, ''))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scores -------------------------------------------------------------------


@query("""
with j as (select d.source as split, d.lang as task, coalesce(l.quality, 0)::double as p, l.toxic::double as s, l.doc_id as has
           from documents d left join labels l on d.doc_id = l.doc_id)
select split, task, count(*) as n, count(has) as covered, round(avg(p), 6) as primary_mean, round(avg(s), 6) as secondary_mean,
       quantile_disc(p, 0.5) as p50, quantile_disc(p, 0.9) as p90
from j group by grouping sets ((split, task), (split)) having count(has) > 0""")
def split_scorecard(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("split"), F.col("lang").alias("task"))
    return scoring.score_split(docs, table(spark, sf, "labels"), "doc_id", "split", "task", "quality", "toxic")


@query("""
select lang, count(n_chars) as n, round(avg(n_chars), 6) as mean, quantile_disc(n_chars, 0.5)::double as p50,
       quantile_disc(n_chars, 0.9)::double as p90, quantile_disc(n_chars, 0.95)::double as p95 from documents group by lang""")
def nearest_rank_summary(spark, sf):
    return scoring.nearest_rank(table(spark, sf, "documents"), ["lang"], "n_chars")


@query("""
with s as (select d.source, d.lang, l.quality::double as quality, l.toxic::double as toxic, d.n_chars::double as n_chars
           from documents d join labels l using (doc_id)),
u as (unpivot s on quality, toxic, n_chars into name metric value value)
select source as split, metric, round(avg(value), 6) as value from u group by source, metric""")
def metric_unpivot_lookup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("split"), "n_chars").join(table(spark, sf, "labels"), "doc_id")
    long = scoring.unpivot_metrics(rows, ["split"], ["quality", "toxic", "n_chars"])
    return long.groupBy("split", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


_CRITERIA = [("quality", 0.85, None), ("toxic", None, 0.12), ("acpl", None, 200.0)]
_CRITERIA_SQL = ", ".join(f"('{m}', {'null' if a is None else a}::double, {'null' if b is None else b}::double)" for m, a, b in _CRITERIA)


@query(f"""
with m as (select d.source, 'quality' as metric, round(avg(l.quality), 6) as value from documents d join labels l using (doc_id) group by d.source
           union all select d.source, 'toxic', round(avg(l.toxic), 6) from documents d join labels l using (doc_id) group by d.source),
c as (select s.source, x.* from (select distinct source from documents) s, (values {_CRITERIA_SQL}) x(metric, low, high))
select c.source, c.metric, c.low, c.high, m.value,
       case when m.value is null then 'missing' when (c.low is null or m.value >= c.low) and (c.high is null or m.value <= c.high) then 'pass' else 'fail' end as status
from c left join m on c.source = m.source and c.metric = m.metric""")
def phase_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    long = scoring.unpivot_metrics(docs.join(table(spark, sf, "labels"), "doc_id"), ["source"], ["quality", "toxic"])
    means = long.groupBy("source", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high")) for m, a, b in _CRITERIA]))
    criteria = docs.select("source").distinct().select("source", rows.alias("c")).select("source", "c.*")
    return scoring.gate(means, criteria, ["source", "metric"]).select("source", "metric", "low", "high", "value", "status")


@query("""
with m as (select d.source, d.doc_id // 10 % 4 as phase, 'quality' as metric, avg(l.quality) as value from documents d join labels l using (doc_id) group by all
           union all select d.source, d.doc_id // 10 % 4, 'acpl_mean', avg(d.n_chars) from documents d join labels l using (doc_id) group by all),
b as (select source, metric, case when metric like 'acpl%' then min(value) else max(value) end as baseline from m where phase < 3 group by source, metric),
c as (select source, metric, value from m where phase = 3)
select c.source, c.metric, round(c.value, 6) as value, round(b.baseline, 6) as baseline,
       (metric not like '%\\_count' escape '\\' and b.baseline - c.value > 0.05) as regressed
from c join b using (source, metric)""")
def baseline_merge(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("acpl_mean")).join(table(spark, sf, "labels"), "doc_id")
    rows = rows.withColumn("phase", F.pmod(F.floor(F.col("doc_id") / 10), F.lit(4)))
    means = scoring.unpivot_metrics(rows, ["source", "phase"], ["quality", "acpl_mean"]).groupBy("source", "phase", "metric").agg(F.avg("value").alias("value"))
    best = scoring.best_baseline(means.filter("phase < 3"), ["source", "metric"])
    now = means.filter("phase = 3").select("source", "metric", "value")
    bad = scoring.regressions(now, best, ["source", "metric"]).select("source", "metric", F.lit(True).alias("regressed"))
    out = now.join(best.withColumnRenamed("value", "baseline"), ["source", "metric"]).join(bad, ["source", "metric"], "left")
    return out.select("source", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), F.coalesce("regressed", F.lit(False)).alias("regressed"))


@query("""
with g as (select d.source, count(*) as n, count(*) filter (l.quality = 1 and l.toxic = 0) as both_correct,
       count(*) filter (l.quality <> 1 and l.toxic <> 0) as both_wrong, count(*) filter (l.quality = 1 and l.toxic <> 0) as baseline_only,
       count(*) filter (l.quality <> 1 and l.toxic = 0) as candidate_only
  from documents d join labels l using (doc_id) group by d.source),
t as (select source, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) as tail
  from (select source, baseline_only as b, candidate_only as c, unnest(range(0, least(baseline_only, candidate_only) + 1)) as i from g) group by source)
select g.*, round((candidate_only - baseline_only) / n, 6) as delta,
       round(case when baseline_only + candidate_only = 0 then 1 else least(1, 2 * tail) end, 6) as p_value from g join t using (source)""")
def paired_mcnemar(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return scoring.paired_summary(rows, ["source"], F.col("quality").cast("double"), 1.0 - F.col("toxic"))


# --- identity and dedup -------------------------------------------------------


@query("""
with k as (select doc_id, lower(trim(text)) as k, lang, source, lang = 'en' as flag from documents)
select sha256(k) as pos_key, min(doc_id) as doc_id, arg_min(source, doc_id) filter (source is not null) as source,
       arg_min(lang, doc_id) filter (lang is not null) as lang, coalesce(bool_or(flag), false) as is_english, count(*) as n
from k group by k""")
def pool_dedup_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("pos_key"), "lang", "source")
    docs = docs.withColumn("is_english", F.col("lang") == "en")
    return dedup.merge_tags(docs, ["pos_key"], "doc_id", ["source", "lang"], ["is_english"], "n")


_BEST_SQL = """
select l_partkey, l_quantity, l_extendedprice, l_orderkey, l_linenumber from (
  select *, row_number() over (partition by l_partkey order by l_quantity desc, l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) where r = 1"""


def _best_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_shipdate")
    return rows, [F.col("l_quantity"), F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber")]


@query(_BEST_SQL)
def keep_best_eval(spark, sf):
    rows, order = _best_rows(spark, sf)
    return dedup.keep_best(rows.drop("l_shipdate"), ["l_partkey"], order)


@query(_BEST_SQL)
def upsert_best(spark, sf):
    """What was cached before a ship date, updated by what came later."""
    rows, order = _best_rows(spark, sf)
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")
    cache = dedup.keep_best(rows.filter(early).drop("l_shipdate"), ["l_partkey"], order)
    return dedup.upsert_best(cache, rows.filter(~early | F.col("l_shipdate").isNull()).drop("l_shipdate"), ["l_partkey"], order)


def _sql_edge(direction: str) -> str:
    return f"""select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate {direction}, o_orderkey {direction}) as r from orders) where r = 1"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")


@query(_sql_edge(""))
def insert_or_ignore(spark, sf):
    return dedup.keep_first(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(_sql_edge("desc"))
def insert_or_replace(spark, sf):
    return dedup.keep_last(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""select task || ':' || substr(sha256('{"fen":' || to_json(doc_id::varchar) || ',"fields":{' || concat_ws(',', case when lang <> '' then '"lang":' || to_json(lang) end, case when source <> '' then '"source":' || to_json(source) end)
  || '},"task":' || to_json(task) || '}'), 1, 24) as example_id, doc_id from (select 'quality.' || lang as task, * from documents)""")
def example_identity(spark, sf):
    task = F.concat(F.lit("quality."), F.col("lang"))
    return table(spark, sf, "documents").select(K.example_identity(task, F.col("doc_id").cast("string"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("example_id"), "doc_id")


@query("""select source, count(*) as n, bit_xor(('0x' || substr(sha256(doc_id::varchar || '|' || text), 1, 15))::bigint) as fingerprint from documents group by source""")
def source_fingerprint(spark, sf):
    """A digest of each source that doesn't depend on the order of its rows: the
    xor of 60 bits of each row's hash, a partial aggregate at any size."""
    docs = table(spark, sf, "documents")
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256), 1, 15), 16, 10).cast("long")
    return docs.select("source", digest.alias("d")).groupBy("source").agg(F.count("*").alias("n"), F.bit_xor("d").alias("fingerprint"))


# --- sampling, splits, mixing -------------------------------------------------


@query(f"select o_orderkey, o_custkey, o_totalprice from orders order by {_sql_order('o_orderkey')} limit 500")
def hash_shuffle_limit(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.hash_sample(orders, K.hash_order(SEED, "o_orderkey"), 500)


@query(f"""
with o as (select text, min(source || '/' || lpad(doc_id::varchar, 12, '0')) as m from documents group by text),
d as (select split_part(m, '/', 1) as source, split_part(m, '/', 2)::bigint as doc_id from o)
select source, doc_id, rank from (select *, row_number() over (partition by source order by {_sql_order('doc_id')}) as rank from d) where rank <= 10""")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text"))
    return splits.stratified_sample(docs, "source", "doc_id", "text", 10, SEED).select("source", "doc_id", "rank")


_QUOTAS = {"en": 55, "de": 25, "fr": 10, "es": 10}


@query(f"""
with r as (select doc_id, lang, {_sql_order('doc_id')} as o, row_number() over (partition by lang order by {_sql_order('doc_id')}) as r from documents),
m as (select *, case when r <= case lang when 'en' then 55 when 'de' then 25 when 'fr' then 10 when 'es' then 10 else 0 end then 'quota' else 'backfill' end as filled from r),
p as (select *, row_number() over (partition by filled order by o) as place from m)
select doc_id, lang, filled from p where filled = 'quota' or place <= 120 - (select count(*) from m where filled = 'quota')""")
def quota_fill_backfill(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return splits.quota_fill(docs, "lang", "doc_id", _QUOTAS, 120, SEED)


@query("""
with c as (select source, count(*) as rows from documents group by source),
q as (select *, 1000 * rows / sum(rows) over () as q from c),
f as (select *, floor(q) as f, row_number() over (order by round(q - floor(q), 9) desc, source) as r from q)
select source, rows, (f + case when r <= 1000 - sum(f) over () then 1 else 0 end)::bigint as n from f""")
def largest_remainder(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("rows"))
    return mix.largest_remainder(counts, "rows", 1000, ["source"])


# segment, name, share of the run, tier, weight
SCHEDULE = [(0, "warm", 0.3, 1, 0.7), (0, "warm", 0.3, 2, 0.3), (1, "main", 0.5, 1, 0.2), (1, "main", 0.5, 2, 0.45), (1, "main", 0.5, 3, 0.35), (2, "cool", 0.2, 2, 0.1), (2, "cool", 0.2, 3, 0.9)]
_SCHEDULE_SQL = ", ".join(f"({a}, '{b}', {c}::double, {d}, {e}::double)" for a, b, c, d, e in SCHEDULE)
_PLAN_SQL = f"""
with s(segment, name, fraction, tier, weight) as (values {_SCHEDULE_SQL}), n as (select count(*) as total from documents),
a as (select segment, name, total * fraction / sum(fraction) over () as q, total from (select distinct segment, name, fraction from s), n),
b as (select *, row_number() over (order by round(q - floor(q), 9) desc, segment) as r from a),
c as (select segment, name, (floor(q) + case when r <= total - sum(floor(q)) over () then 1 else 0 end)::bigint as segment_rows from b),
e as (select *, sum(segment_rows) over (order by segment)::bigint as last_row from c),
t as (select e.*, tier, segment_rows * weight / sum(weight) over (partition by segment) as q from e join s using (segment, name)),
u as (select *, row_number() over (partition by segment order by round(q - floor(q), 9) desc, tier) as r from t)
"""


def _plan(spark, sf):
    schedule = spark.createDataFrame(SCHEDULE, "segment int, name string, fraction double, tier int, weight double")
    return mix.plan_segments(schedule, table(spark, sf, "documents").count())


@query(_PLAN_SQL + """select segment, name, tier, segment_rows, (last_row - segment_rows)::bigint as first_row, last_row,
  (floor(q) + case when r <= segment_rows - sum(floor(q)) over (partition by segment) then 1 else 0 end)::bigint as tier_rows from u""")
def segment_plan(spark, sf):
    return _plan(spark, sf).select("segment", "name", "tier", "segment_rows", "first_row", "last_row", "tier_rows")


@query(_PLAN_SQL + """, bounds as (select segment, ceil(last_row / 32.0)::bigint as boundary from e),
steps as (select unnest(range(0, (select max(boundary) + 3 from bounds)))::bigint as step)
select step, coalesce(min(segment), (select max(segment) from bounds))::int as segment from steps left join bounds on step <= boundary group by step""")
def step_to_segment(spark, sf):
    """The first segment whose boundary step isn't passed; the last one after all."""
    bounds = _plan(spark, sf).select("segment", F.ceil(F.col("last_row") / 32).alias("boundary")).distinct()
    ends = bounds.agg(F.max("boundary").alias("top"), F.max("segment").alias("last"), F.sort_array(F.collect_list(F.struct("boundary", "segment"))).alias("b"))
    steps = ends.select("last", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") + 2)).alias("step"))
    hit = F.get(F.filter("b", lambda x: x["boundary"] >= F.col("step")), F.lit(0))["segment"]
    return steps.select("step", F.coalesce(hit, "last").cast("int").alias("segment"))


@query(f"""
with n as (select source, greatest(1, least(count(*), round_even(count(*) * 0.15, 0)))::bigint as take from documents group by source),
r as (select doc_id, source, row_number() over (partition by source order by {_sql_order('doc_id')}) as r from documents)
select doc_id, source from r join n using (source) where r <= take""")
def fraction_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mix.fraction_sample(docs, "source", "doc_id", 0.15, SEED)


@query("select doc_id, quality, toxic, unnest(range(1, case when toxic = 1 then 5 else 2 end))::int as copy from labels")
def task_upsample(spark, sf):
    return mix.upsample(table(spark, sf, "labels"), F.when(F.col("toxic") == 1, 4).otherwise(1)).select("doc_id", "quality", "toxic", "copy")


@query("""
with n as (select count(*) as n from benchmark), e as (select item_id, unnest(range(0, 3))::int as epoch from benchmark)
select (epoch * n + row_number() over (partition by epoch order by sha256('42:' || epoch || ':' || item_id)) - 1)::bigint as draw, epoch, item_id from e, n""")
def cyclic_draw(spark, sf):
    pool = table(spark, sf, "benchmark").select("item_id")
    return mix.cyclic_draw(pool, "item_id", 3 * pool.count(), SEED).select("draw", "epoch", "item_id")


@query(f"""
with g as (select distinct p_brand from part where p_brand is not null), r as (select p_brand, row_number() over (order by {_sql_order('p_brand')}) as r, count(*) over () as n from g)
select p_partkey, p_brand, case when r <= greatest(1, floor(n * 0.15)) then 'eval' else 'train' end as side from part left join r using (p_brand)""")
def group_holdout(spark, sf):
    return splits.group_holdout(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 0.15, SEED).select("p_partkey", "p_brand", "side")


@query(f"select conv_id, turn, case when ('0x' || substr({_sql_order('conv_id')}, 1, 8))::bigint / 4294967296.0 < 0.1 then 'eval' else 'train' end as side from conversations")
def split_by_key_no_leak(spark, sf):
    return splits.split_by_key(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", 0.1, SEED)


@query("""select doc_id, n_chars, label from (
  select doc_id, n_chars, unnest([case when n_chars < 500 then 'short' end, case when n_chars >= 500 and n_chars < 3000 then 'medium' end,
    case when n_chars >= 2000 then 'long' end, case when lang = 'en' then 'english' end]) as label from documents) where label is not null""")
def multi_label_partition(spark, sf):
    n = F.col("n_chars")
    labels = [(n < 500, "short"), ((n >= 500) & (n < 3000), "medium"), (n >= 2000, "long"), (F.col("lang") == "en", "english")]
    return table(spark, sf, "documents").select("doc_id", "n_chars", splits.labels_of(labels).alias("label"))


@query("""
with r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as i from documents)
select doc_id, source || '_' || printf('%06d', i) as example_id, ['planning', 'rules', 'tactics'][(i % 3)::int + 1] as task from r""")
def round_robin_ids(spark, sf):
    """Dense ids and tasks in turn per source, ranked in ranges of doc_id."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    ranked = ranking.with_rank(docs, ["source"], F.col("doc_id"), "i", ranking.number_bucket("doc_id", 4096)).withColumn("i", F.col("i") - 1)
    task = F.element_at(F.array(F.lit("planning"), F.lit("rules"), F.lit("tactics")), (F.pmod("i", F.lit(3)) + 1).cast("int"))
    return ranked.select("doc_id", F.concat_ws("_", "source", F.format_string("%06d", "i")).alias("example_id"), task.alias("task"))


# --- joins --------------------------------------------------------------------


@query(f"""
with s as (select user_id, event_id from events where event_type = 'purchase' order by {_sql_order('event_id')} limit 50)
select distinct event_id from (select event_id from s union all select event_id from events where user_id in (select user_id from s))""")
def blocklist_neighbours(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    sampled = ranking.hash_sample(events.filter("event_type = 'purchase'"), K.hash_order(SEED, "event_id"), 50)
    return joins.with_neighbours(events, sampled, "event_id", "user_id")


def _sentences(df: DataFrame, key: str) -> DataFrame:
    parts = F.transform(F.split("text", r"[.\n]"), lambda s: F.lower(F.trim(s)))
    return df.select(key, F.explode(parts).alias("sentence")).filter(F.length("sentence") >= 20)


def _sql_sentences(table_: str, key: str) -> str:
    return f"select {key}, sentence from (select {key}, lower(trim(unnest(regexp_split_to_array(text, '[.\\n]')))) as sentence from {table_}) where length(sentence) >= 20"


@query(f"""
with d as ({_sql_sentences('documents', 'doc_id')}), b as ({_sql_sentences('benchmark', 'item_id')})
select doc_id, count(*) as hits, count(distinct sentence) as sentences from d where sentence in (select sentence from b) group by doc_id""")
def decontaminate(spark, sf):
    """Documents with a sentence of the benchmark, by exact membership."""
    blocked = _sentences(table(spark, sf, "benchmark"), "item_id").select("sentence").distinct()
    hits = _sentences(table(spark, sf, "documents"), "doc_id").join(blocked, "sentence", "left_semi")
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.countDistinct("sentence").alias("sentences"))


@query("""
select s.source, l.lang from (select distinct source from documents) s, (values ('en'), ('de'), ('fr'), ('es'), ('it')) l(lang)
except select source, lang from documents""")
def coverage_gaps(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang")
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "it")]))
    return joins.missing_from(docs.select("source").distinct().select("source", langs.alias("lang")), docs, ["source", "lang"])


_TARGETS = {"click": 3000, "purchase": 100, "refund": 10, "view": 1000000}


@query("select t.*, coalesce(n, 0) as n, case when n is null then 'missing' when n < target then 'underfilled' else 'complete' end as status from (values "
       + ", ".join(f"('{k}', {v})" for k, v in _TARGETS.items()) + ") t(event_type, target) left join (select event_type, count(*) as n from events group by event_type) using (event_type)")
def completeness_audit(spark, sf):
    targets = spark.createDataFrame(list(_TARGETS.items()), "event_type string, target int")
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("target"), "underfilled").otherwise("complete")
    return targets.join(counts, "event_type", "left").select("event_type", "target", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


_REFRESH_SQL = """
with j as (select o_orderkey, o_custkey as rollout_id, o_orderstatus, o_totalprice, c_mktsegment, c_nationkey as prompt_id, c_custkey, n_name
  from orders left join (select * from customer where c_custkey % 10 <> 3) on o_custkey = c_custkey left join (select * from nation where n_nationkey <> 7) on c_nationkey = n_nationkey),
r as (select *, case when c_custkey is null then 'missing_rollout' when n_name is null then 'missing_prompt'
  when o_orderstatus = 'P' then 'unsupported' when o_totalprice < 50000 then 'below_regret' end as reason from j),
d as (select *, case when reason is not null then reason
  when row_number() over (partition by rollout_id, o_orderstatus, reason is null order by o_orderkey) > 1 then 'duplicate' end as r2 from r),
c as (select *, coalesce(sum(case when r2 is null then 1 else 0 end) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from d),
x as (select o_orderkey, rollout_id, n_name, case when before >= 400 then 'max_examples' else r2 end as reason from c)
"""


def _refresh(spark, sf):
    judgments = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("rollout_id"), "o_orderstatus", "o_totalprice")
    rollouts = table(spark, sf, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("rollout_id"), F.col("c_nationkey").alias("prompt_id"), F.lit(True).alias("has_rollout"))
    prompts = table(spark, sf, "nation").filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("prompt_id"), "n_name")
    rules = [
        (F.col("has_rollout").isNull(), "missing_rollout"), (F.col("n_name").isNull(), "missing_prompt"),
        (F.col("o_orderstatus") == "P", "unsupported"), (F.col("o_totalprice") < 50000, "below_regret"),
    ]
    return refresh.refresh(judgments, rollouts, prompts, rules, "o_orderkey", ["rollout_id", "o_orderstatus"], ranking.number_bucket("o_orderkey", 4096), 400)


@query(_REFRESH_SQL + "select o_orderkey, rollout_id, n_name from x where reason is null")
def refresh_rows(spark, sf):
    return _refresh(spark, sf).filter("reason is null").select("o_orderkey", "rollout_id", "n_name")


@query(_REFRESH_SQL + "select reason, count(*) as n from x where reason is not null group by reason")
def refresh_skip_reasons(spark, sf):
    return _refresh(spark, sf).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("""select conv_id, turn, role from conversations where role <> 'system' and (turn % 2 = 1 or role = 'assistant')
  and contains(lower(concat_ws(' ', role, text)), 'the') and length(text) between 20 and 2000""")
def review_filter(spark, sf):
    rows = table(spark, sf, "conversations")
    found = F.contains(F.lower(F.concat_ws(" ", "role", "text")), F.lit("the"))
    return rows.filter((F.col("role") != "system") & ((F.col("turn") % 2 == 1) | (F.col("role") == "assistant")) & found & F.length("text").between(20, 2000)).select("conv_id", "turn", "role")


@query("select 'role' as facet, role as value, count(*) as n from conversations group by role union all select 'turn', turn::varchar, count(*) from conversations group by turn")
def review_facets(spark, sf):
    rows = table(spark, sf, "conversations").select("role", F.col("turn").cast("string").alias("turn"))
    return rows.unpivot([], ["role", "turn"], "facet", "value").groupBy("facet", "value").agg(F.count("*").alias("n"))


# --- text metrics -------------------------------------------------------------

_PAIRS_SQL = """
with u as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn, text from conversations where role = 'assistant'),
w as (select u.conv_id, u.turn, list_distinct(list_filter(regexp_split_to_array(lower(u.text), '\\s+'), lambda x: x <> '')) as p,
             list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda x: x <> '')) as g
      from u join a on a.conv_id = u.conv_id and a.turn = u.turn + 1)
"""


def _pairs(spark, sf):
    rows = table(spark, sf, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"]).select("conv_id", "turn", X.word_set(F.col("question")).alias("p"), X.word_set(F.col("answer")).alias("g"))


@query(_PAIRS_SQL + """select conv_id, turn, round(case when len(p) + len(g) = 0 then 1 else len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g))) end, 6) as jaccard from w""")
def word_jaccard(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(X.set_jaccard(F.col("p"), F.col("g")), 6).alias("jaccard"))


@query(_PAIRS_SQL + """, h as (select *, len(list_intersect(p, g)) as hit, len(p) as a, len(g) as b from w)
select conv_id, turn, round(case when a = 0 and b = 0 then 1 when a = 0 then 0 else hit / a end, 6) as precision_,
  round(case when a = 0 and b = 0 then 1 when b = 0 then 0 else hit / b end, 6) as recall_,
  round(case when a = 0 and b = 0 then 1 when hit = 0 then 0 else 2.0 * hit / (a + b) end, 6) as f1 from h""")
def set_prf(spark, sf):
    scores = _pairs(spark, sf).select("conv_id", "turn", X.set_scores(F.col("p"), F.col("g")).alias("s"))
    return scores.select("conv_id", "turn", F.round("s.precision", 6).alias("precision_"), F.round("s.recall", 6).alias("recall_"), F.round("s.f1", 6).alias("f1"))


@query("""with f as (select user_id, arg_min(event_type, struct_pack(ts, event_id)) filter (event_type in ('purchase', 'error', 'click')) as x from events group by user_id)
select user_id, case when x is null then 0 else round(1.0 / list_position(['purchase', 'error', 'click'], x), 6) end::double as reciprocal_rank from f""")
def reciprocal_rank(spark, sf):
    """Over all of a user's events: the first that a ranked list has."""
    gold = F.array(F.lit("purchase"), F.lit("error"), F.lit("click"))
    events = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = F.min_by(F.when(F.array_contains(gold, F.col("event_type")), F.col("event_type")), F.when(F.array_contains(gold, F.col("event_type")), F.col("at")))
    rows = events.groupBy("user_id").agg(first.alias("x"))
    return rows.select("user_id", F.round(X.reciprocal_rank(F.array("x"), gold), 6).alias("reciprocal_rank"))


@query("""
with k as (select doc_id, sha256(lower(trim(text))) as k from documents)
select k as text_key, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from k group by k having count(*) > 1""")
def exact_match_norm(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("text_key"))
    return keyed.groupBy("text_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n > 1")


@query("select case when p_size < 10 then '<10' when p_size < 20 then '10-19' when p_size < 30 then '20-29' else '30+' end as bucket, count(*) as n, round(avg(p_retailprice), 4) as mean_price from part group by all")
def rating_buckets(spark, sf):
    size = F.col("p_size")
    bucket = F.when(size < 10, "<10").when(size < 20, "10-19").when(size < 30, "20-29").otherwise("30+")
    return table(spark, sf, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query("select theme, count(*) as n, round(avg(p_size), 6) as mean_size from (select unnest(list_distinct(regexp_split_to_array(lower(p_type), '\\s+'))) as theme, p_size from part) group by theme")
def theme_strata(spark, sf):
    themes = F.explode(F.array_distinct(F.split(F.lower("p_type"), r"\s+")))
    return table(spark, sf, "part").select(themes.alias("theme"), "p_size").groupBy("theme").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("select event_id, try_cast(try_cast(json_extract_string(props, '$.k') as double) as int) as k from events")
def lenient_json_cast(spark, sf):
    return table(spark, sf, "events").select("event_id", X.lenient_int(F.get_json_object("props", "$.k")).alias("k"))


@query("""select page_id, unnest(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))) as href from pages""")
def href_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(X.hrefs(F.col("html"))).alias("href"))


# --- windows ------------------------------------------------------------------

_HISTORY_SQL = """
with e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as ply from events)"""


@query(_HISTORY_SQL + """
select event_id, user_id, ply::bigint as ply, coalesce(array_to_string(list(event_type) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), ' '), '') as history,
  case when ply <= 30 then 'opening' when ply <= 70 then 'middlegame' else 'endgame' end as phase from e""")
def move_history(spark, sf):
    """All events before each, its place in the user's sequence, its phase. The output
    is quadratic in a user's events, as a history before each of them has to be."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    ply = (F.row_number().over(w) - 1).cast("long")
    history = F.array_join(F.collect_list("event_type").over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    return events.select("event_id", "user_id", ply.alias("ply"), history.alias("history")).withColumn("phase", B.game_phase(F.col("ply")))


@query("""
with e as (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as brk from events),
i as (select *, sum(brk) over (partition by user_id order by ts, event_id) as island from e)
select user_id, min(event_id) as first_event, event_type, count(*) as streak from i group by user_id, island, event_type having count(*) >= 3""")
def streaks(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    breaks = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    marked = events.withColumn("brk", breaks).withColumn("island", F.sum("brk").over(w))
    return marked.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("streak")).filter("streak >= 3").drop("island")


@query("""
with g as (select user_id, count(*) as plies, count(*) filter (event_type = 'error') as fallbacks from events group by user_id)
select count(*) as games, count(*) filter (fallbacks = 0) as clean_games, sum(plies)::bigint as plies, sum(fallbacks)::bigint as fallbacks,
  round(avg((plies - fallbacks) / plies), 6) as mean_legal_rate, round(1 - sum(fallbacks) / sum(plies), 6) as legal_rate from g""")
def reliability_two_level(spark, sf):
    games = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("plies"), F.count_if(F.col("event_type") == "error").alias("fallbacks"))
    return games.agg(
        F.count("*").alias("games"), F.count_if(F.col("fallbacks") == 0).alias("clean_games"), F.sum("plies").alias("plies"), F.sum("fallbacks").alias("fallbacks"),
        F.round(F.avg((F.col("plies") - F.col("fallbacks")) / F.col("plies")), 6).alias("mean_legal_rate"),
        F.round(1 - F.sum("fallbacks") / F.sum("plies"), 6).alias("legal_rate"),
    )


@query("""
with s as (select l_partkey, l_suppkey, sum(l_quantity) as w from lineitem group by all), t as (select *, sum(w) over (partition by l_partkey) as a from s)
select l_suppkey, round(sum(w / a), 6) as weight, count(*) as parts from t group by l_suppkey""")
def normalized_weight_merge(spark, sf):
    share = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    whole = share.groupBy("l_partkey").agg(F.sum("w").alias("a"))
    return share.join(whole, "l_partkey").groupBy("l_suppkey").agg(F.round(F.sum(F.col("w") / F.col("a")), 6).alias("weight"), F.count("*").alias("parts"))


@query(_HISTORY_SQL + """, p as (select user_id, ply, event_type, array_to_string(list(event_type) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), ' ') as before from e)
select ply::bigint as prefix_length, md5(coalesce(before, '')) as prefix, event_type as next, count(*) as n from p group by all""")
def prefix_counts(spark, sf):
    """How often each event follows each prefix of a sequence, however long: prefixes
    are grouped by their length and digest."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    before = F.array_join(F.collect_list("event_type").over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    rows = events.select((F.row_number().over(w) - 1).cast("long").alias("prefix_length"), F.md5(before).alias("prefix"), F.col("event_type").alias("next"))
    return rows.groupBy("prefix_length", "prefix", "next").agg(F.count("*").alias("n"))


# --- chat rows ----------------------------------------------------------------


def _messages(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


@query("""select conv_id, count(*) as n, string_agg(role || ': ' || text, '\n' order by turn) as rendered from conversations group by conv_id""")
def chat_rows(spark, sf):
    rendered = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return _messages(spark, sf).select("conv_id", F.size("messages").cast("long").alias("n"), rendered.alias("rendered"))


@query("""
with c as (select conv_id, bool_or(role not in ('system', 'user', 'assistant')) as a, bool_or(coalesce(trim(text), '') = '') as b,
  not bool_or(role = 'assistant') as c, arg_max(role, turn) <> 'assistant' as d from conversations group by conv_id)
select error, count(*) as n from (select unnest([case when a then 'unknown_role' end, case when b then 'empty_content' end, case when c then 'no_assistant' end,
  case when d then 'last_not_assistant' end]) as error from c) where error is not null group by error""")
def chat_validate(spark, sf):
    checked = validate.with_errors(_messages(spark, sf), validate.chat_rules("messages"))
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


# --- boards -------------------------------------------------------------------

# Positions for the queries that need boards: the tables have none.
POSITIONS = (
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1",
    "7k/5Q2/7K/8/8/8/8/8 b - - 0 1",
    "k3r3/8/8/8/8/8/4R3/4K3 w - - 0 1",
    "8/8/8/4k3/8/8/8/4K2R w - - 0 1",
    "8/P7/8/8/8/8/8/4K2k w - - 0 1",
    "rnbqkbnr/ppp1pppp/8/8/3pP3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 3",
    "r1bqkb1r/pppp1ppp/2n2n2/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR w KQkq - 4 4",
    "8/8/8/8/8/8/4P3/4K3 w - - 0 1",
)
_POSITIONS_SQL = ", ".join(f"('{p}')" for p in POSITIONS)


def _positions(spark):
    return spark.createDataFrame([(p,) for p in POSITIONS], "fen string")


@query(f"""
with p(fen) as (values {_POSITIONS_SQL}), b as (select fen, split_part(fen, ' ', 1) as f, array_to_string(list_slice(string_split(fen, ' '), 1, 4), ' ') as pos_key from p)
select fen, pos_key, {"replace(" * 7}replace(f, '/', chr(10)){"".join(f", '{i}', repeat('.', {i}))" for i in range(2, 9))} as placed from b""".replace("as placed", "as placed_raw").replace("select fen, pos_key, ", "select fen, pos_key, replace(").replace(" as placed_raw", ", '1', '.') as placed"))
def fen_board(spark, sf):
    rows = _positions(spark).select("fen", K.position_fields(F.col("fen")).alias("pos_key"), F.array_join(B.ranks(F.col("fen")), "\n").alias("placed"))
    return rows


_PIECES_SQL = " + ".join(f"{v} * ((length(f) - length(replace(f, '{p}', ''))) - (length(f) - length(replace(f, '{p.lower()}', ''))))" for p, v in B.VALUES.items())


@query(f"with p(fen) as (values {_POSITIONS_SQL}), b as (select fen, split_part(fen, ' ', 1) as f from p) select fen, ({_PIECES_SQL})::int as balance from b")
def material(spark, sf):
    return _positions(spark).select("fen", B.material_balance(F.col("fen")).cast("int").alias("balance"))


@query(f"with p(fen) as (values {_POSITIONS_SQL}) select fen, i::int as rank, string_split(split_part(fen, ' ', 1), '/')[i] as packed, true as same from p, range(1, 9) t(i)")
def rank_codec(spark, sf):
    """Ranks expanded and packed again."""
    rows = _positions(spark).select("fen", F.posexplode(F.split(B.board_field(F.col("fen")), "/")).alias("i", "row"))
    packed = B.compress_rank(B.expand_rank(F.col("row")))
    return rows.select("fen", (F.col("i") + 1).cast("int").alias("rank"), packed.alias("packed"), (packed == F.col("row")).alias("same"))


@query()
def chess_rules(spark, sf):
    """The kernel's columns over the positions: key, legal moves, state, structure."""
    from ..functions import chess_udfs as U
    from ..functions import protocol as P

    fen = F.col("fen")
    return _positions(spark).select(
        "fen", P.canonical_key(fen).alias("pos_key"), U.legal_moves(fen).alias("legal_moves"), U.check_state(fen).alias("state"),
        U.hanging_pieces(fen).alias("hanging"), U.exchange_values(fen).alias("exchanges"), U.pawn_structure(fen, F.lit("w")).alias("white_pawns"),
    )


@query()
def legality_reasons(spark, sf):
    from ..functions import chess_udfs as U

    moves = F.explode(F.array(*[F.lit(m) for m in ("e1g1", "e2e4", "e2e5", "e7e5", "a7a8", "a7a8q", "zz", "e1e2", "d4e3")]))
    return _positions(spark).select("fen", moves.alias("move")).select("fen", "move", U.legality_reason(F.col("fen"), F.col("move")).alias("reason"))


@query()
def task_rows(spark, sf):
    """Every board task on every position, without one blocked position."""
    from ..functions.answers import TASKS
    from ..operators import generators

    return generators.task_rows(_positions(spark), sorted(TASKS), _positions(spark).limit(1))
