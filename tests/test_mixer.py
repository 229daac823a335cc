import pytest
from pyspark.sql import functions as F

from plyforge.operators import mixer as X
from plyforge.operators import splits


def rows(spark, n=600):
    return spark.range(n).select("id", (F.col("id") % 3 + 1).cast("int").alias("tier"), F.concat(F.lit("t"), F.col("id") % 4).alias("task"), F.concat(F.lit("k"), F.floor(F.col("id") / 5)).alias("key"))


def no_keys(spark):
    return spark.createDataFrame([], "key string")


def test_counts():
    assert X.apportion(10, [1, 1, 1]) == [4, 3, 3] and sum(X.apportion(7, [0.2, 0.5, 0.3])) == 7 and X.apportion(0, [1]) == [0]
    assert [X.sampled(n, f) for n, f in ((0, 0.5), (1, 0.1), (10, 0.25), (10, 0.0), (9, 1.5))] == [0, 1, 2, 0, 9]
    with pytest.raises(ValueError):
        X.apportion(5, [0.0])


def test_eval_keys_stay_and_tiers_only_add(spark, tmp_path):
    state, data = f"file://{tmp_path}/state", rows(spark)
    first = {r["key"] for r in X.load_or_extend_eval_keys(spark, state, data.filter("tier = 1"), 0.1, 7).collect()}
    assert first and {r["key"] for r in X.load_or_extend_eval_keys(spark, state, data.filter("tier = 1"), 0.9, 8).collect()} == first
    more = {r["key"] for r in X.load_or_extend_eval_keys(spark, state, data, 0.1, 7).collect()}
    assert first <= more
    sided = X.with_side(data, X.load_or_extend_eval_keys(spark, state, data, 0.1, 7))
    assert sided.groupBy("key").agg(F.countDistinct("side").alias("n")).filter("n > 1").count() == 0 and sided.count() == 600


def test_phase(spark):
    data = rows(spark)
    keys = splits.greedy_keys(data.groupBy("key", "task").agg(F.count("*").alias("n")), "key", "task", "n", 0.1, 3).select("key")
    mix = [X.TierMix(1, 0.5), X.TierMix(2, 1.0, 2)]
    train, held = X.build_phase(data, mix, keys, 3, {"t1": 3}, {"t2": 0.4})
    got = train.collect()
    assert sorted(r["position"] for r in got) == list(range(1, len(got) + 1)) and {r["tier"] for r in got} == {1, 2}
    assert not {r["key"] for r in got} & {r["key"] for r in held.collect()}
    for tier in (1, 2):
        own = [r for r in got if r["tier"] == tier]
        assert sum(r["task"] == "t2" for r in own) / len(own) == pytest.approx(0.4, abs=0.02)
    assert [r["id"] for r in train.orderBy("position").collect()] == [r["id"] for r in X.build_phase(data, mix, keys, 3, {"t1": 3}, {"t2": 0.4})[0].orderBy("position").collect()]
    with pytest.raises(ValueError):
        X.build_phase(data, mix, keys, 3, None, {"gone": 0.5})
    with pytest.raises(ValueError):
        X.build_phase(data.limit(0), mix, no_keys(spark))
    assert X.summarize_phase(data, mix, {"t1": 3}) == {"tier_1": 100 + 25 * 2, "tier_2": (200 + 50 * 2) * 2, "total": 750}


def test_schedule_repeats_only_what_ran_out(spark):
    data = rows(spark, 300)
    segments = [X.Segment("a", 0.5, ((1, 1.0),)), X.Segment("b", 0.5, ((1, 0.5), (2, 0.5), (3, 0.0)))]
    train, held, plans = X.build_schedule(data, segments, no_keys(spark), 5, total=240)
    got = train.orderBy("position").collect()
    assert held.count() == 0 and [r["position"] for r in got] == list(range(240)) and [(p.start, p.end) for p in plans] == [(0, 120), (120, 240)]
    assert {r["tier"] for r in got[:120]} == {1} and sum(r["tier"] == 1 for r in got[120:]) == 60
    seen = [r["id"] for r in got if r["tier"] == 1]
    assert len(seen) == 180 and {seen.count(i) for i in set(seen)} == {1, 2} and len(set(seen)) == 100
    assert [r["id"] for r in got] != sorted(r["id"] for r in got)
    with pytest.raises(ValueError):
        X.build_schedule(data.filter("tier <> 2"), segments, no_keys(spark), 5)
    summary = X.summarize_schedule(data, segments, {"t0": 2}, total=240)
    assert summary["tier_pool_sizes"] == {"tier_1": 125, "tier_2": 125} and summary["boundary_steps"] == [4, 8]


def test_targets_need_a_remainder(spark):
    data = rows(spark).filter("task = 't1'")
    with pytest.raises(ValueError):
        X.build_phase(data, [X.TierMix(1)], no_keys(spark), 1, None, {"t1": 0.5})


def test_training_rows(spark):
    schema = "task string, tier int, fen string, metadata map<string,string>, messages array<struct<role:string,content:string>>"
    table = spark.createDataFrame(
        [
            ("a", 1, "f", {"target_move": " E2E4 "}, [("user", "q"), ("assistant", "long")]), ("b", 1, "f", {}, [("assistant", "so <move>D2D4</move>")]),
            ("c", 1, "f", {}, [("user", "q"), ("assistant", "none")]),
        ],
        schema,
    )
    got = {r["task"]: r["messages"][-1]["content"] for r in X.transform_rows(X.check_required(table), exclude=["c"], move_only=["a", "b"]).collect()}
    assert got == {"a": "<think>Choose the final legal move.</think>\n<move>e2e4</move>", "b": "<think>Choose the final legal move.</think>\n<move>d2d4</move>"}
    assert [r["task"] for r in X.transform_rows(table, include=["c"]).collect()] == ["c"] and X.transform_rows(table, include=[]).count() == 0
    for bad in (X.transform_rows(table, move_only=["c"]), X.check_required(table.withColumn("fen", F.lit(None).cast("string")))):
        with pytest.raises(Exception, match="move-only|required"):
            bad.collect()
