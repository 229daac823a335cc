import hashlib
import io
import json
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyforge.functions import keys as K
from plyforge.functions import text as X
from plyforge.operators import dedup, joins, mix, ranking, scoring, splits, validate
from plyforge.sources import readers, schemas, writers
from plyforge.streaming import keep_best


def test_ranks_equal_row_numbers(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 5).cast("string")).alias("g"))
    ranked = ranking.with_rank(rows, ["g"], K.hash_order(1, "id"), "r").collect()
    by = {}
    for r in ranked:
        by.setdefault(r["g"], []).append((r["id"], r["r"]))
    import hashlib

    order = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    for own in by.values():
        assert [i for i, _ in sorted(own, key=lambda x: x[1])] == sorted((i for i, _ in own), key=order)
        assert sorted(r for _, r in own) == list(range(1, len(own) + 1))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(0, 200))
def test_apportionment_by_hand(weights, total):
    quotas = [total * w / sum(weights) for w in weights]
    floors = [int(q) for q in quotas]
    extra = sorted(range(len(weights)), key=lambda i: (-round(quotas[i] - floors[i], 9), i))[: total - sum(floors)]
    assert sum(floors) + len(extra) == total


def test_apportionment(spark):
    got = mix.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int"), "w", 10, ["k"])
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 4, "b": 3, "c": 3}


def test_mcnemar(spark):
    pairs = [(0, 0), (0, 5), (1, 4), (500, 500), (10, 2000)]
    got = spark.createDataFrame(pairs, "b int, c int").select(X.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    from math import comb

    for (b, c), r in zip(pairs, got, strict=True):
        want = min(1.0, 2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_keep_best_ties_keep_the_earlier(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 5, 2), ("a", 5, 3), ("b", None, 4)], "k string, q int, o int")
    got = dedup.keep_best(rows, ["k"], [F.col("q"), -F.col("o")]).orderBy("k").collect()
    assert [(r["k"], r["q"], r["o"]) for r in got] == [("a", 5, 2), ("b", None, 4)]
    assert dedup.keep_first(rows, ["k"], ["o"]).filter("k = 'a'").first()["o"] == 1


def test_answers(spark):
    rows = [
        ("<think>x</think> <move>E2E4</move>", "e2e4", "move_tag", None), ('{"move_uci": "g1f3"}', "g1f3", "json", None), (" e7e8q ", "e7e8q", "bare_uci", None),
        ("I play e2e4 now", "e2e4", "prose_uci", None), ("e2e4 or d2d4", None, "none", "ambiguous UCI moves in prose"), ("nothing", None, "none", "no UCI move found"),
        ("<move>e2e4</move><move>d2d4</move>", None, "none", "ambiguous move tags"), ('{"move_uci": "e2e9"}', None, "none", "no UCI move found"), ('{"move_uci": 5}', None, "none", "no UCI move found"),
        ("b2b4/8/8/8/7k/8/8/K7 w - - 0 1", None, "none", "no UCI move found"),
    ]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(X.parse_answer(F.col("t")).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_set_metrics(spark):
    rows = [(["a"], ["a", "b"], 0.5, 1.0, 0.5), ([], [], 1.0, 1.0, 1.0), ([], ["a"], 0.0, 0.0, 0.0), (["x", "b"], ["a", "b"], 1 / 3, 0.5, 0.5)]
    df = spark.createDataFrame([(p, g) for p, g, *_ in rows], "p array<string>, g array<string>")
    got = df.select(X.set_jaccard(F.col("p"), F.col("g")).alias("j"), X.set_scores(F.col("p"), F.col("g")).alias("s"), X.reciprocal_rank(F.col("p"), F.col("g")).alias("rr"), X.prefix_ratio(F.col("p"), F.col("g")).alias("pr")).collect()
    for r, (_, _, j, p, rec) in zip(got, rows, strict=True):
        assert (r["j"], r["s"]["precision"], r["s"]["recall"]) == pytest.approx((j, p, rec))
    assert [r["rr"] for r in got] == [1.0, 0.0, 0.0, 0.5] and [r["pr"] for r in got] == [0.5, 1.0, 0.0, 0.0]


def test_strict_and_loose_moves(spark):
    texts = ["<think>x</think><move>a7a8q</move>", "<move> E2E4 </move>", "<MOVE>e2e4</MOVE>", "I prefer e2e4 over d2d4.", "no move", "<think>Center.</think>\n<move>e2e4</move>", "<|im_start|>assistant: e2e4<|im_end|>", "assistant:e2e4"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strict_move(F.col("t")).alias("s"), X.first_move(F.col("t")).alias("f"), X.valid_think_move(F.col("t")).alias("v"), X.extract_move(F.col("t")).alias("e")).collect()
    assert [r["s"] for r in got] == ["a7a8q", None, None, None, None, "e2e4", None, None] and [r["v"] for r in got] == [True, False, False, False, False, True, False, False]
    assert [r["f"] for r in got] == ["a7a8q", "e2e4", "e2e4", "e2e4", None, "e2e4", "e2e4", "e2e4"] and [r["e"] for r in got][-2:] == ["e2e4", "e2e4"]


def test_identities_tell_examples_apart(spark):
    rows = spark.createDataFrame([("t", "k", {"a": "x|y", "b": "z"}), ("t", "k", {"a": "x", "b": "y|z"}), ("t", "k", {"b": "z", "a": "x|y", "c": ""}), ("t", "k", {})], "t string, k string, f map<string,string>")
    got = [r["i"] for r in rows.select(K.example_identity(F.col("t"), F.col("k"), F.col("f")).alias("i")).collect()]
    assert got[0] == got[2] and len(set(got)) == 3
    assert got[3] == "t:" + hashlib.sha256(b'{"fen":"k","fields":{},"task":"t"}').hexdigest()[:24]


def test_keys_stay_on_one_side(spark):
    rows = spark.range(500).withColumn("k", F.col("id") % 40)
    got = splits.split_by_key(rows, "k", 0.3, 7).groupBy("k").agg(F.countDistinct("side").alias("n"))
    assert got.filter("n > 1").count() == 0


def greedy(counts, share, existing=()):
    """The rule row by row; sizes are all different, so the order is plain."""
    chosen, out = set(existing), set()
    for task in sorted({t for _, t, _ in counts}):
        own = sorted((n, k) for k, t, n in counts if t == task)
        goal, have = max(1, int(sum(n for n, _ in own) * share)), sum(n for n, k in own if k in chosen)
        rest, first = [x for x in own if x[1] not in chosen], have
        for n, k in rest:
            if have < goal and have + n - goal <= goal - have:
                have += n
                chosen.add(k)
                out.add((k, task))
        if not have and len(rest) >= 2 and not first:
            chosen.add(rest[0][1])
            out.add((rest[0][1], task))
    return out


def test_greedy_keys_follow_the_rule(spark):
    rng = random.Random(2)
    counts = [(f"k{i}", t, 1 + i * 3 + j) for i in range(60) for j, t in enumerate("cab") if rng.random() < 0.6]
    counts += [("x1", "z", 50), ("x2", "z", 60), ("y", "one", 9)]
    frame = spark.createDataFrame(counts, "k string, t string, n long")
    for share in (0.0, 0.02, 0.2):
        got = {(r["key"], r["task"]) for r in splits.greedy_keys(frame, "k", "t", "n", share, 3).collect()}
        assert got == (greedy(counts, share) if share else set())
    held = spark.createDataFrame([("k5",), ("x2",)], "key string")
    assert {(r["key"], r["task"]) for r in splits.greedy_keys(frame, "k", "t", "n", 0.1, 3, held).collect()} == greedy(counts, 0.1, ("k5", "x2"))


def test_repeated_keys_raise(spark):
    with pytest.raises(ValueError):
        joins.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_gate_and_regressions(spark):
    now = spark.createDataFrame([("s", "acc", 0.6), ("s", "n_count", 1.0)], "split string, metric string, value double")
    base = spark.createDataFrame([("s", "acc", 0.7), ("s", "n_count", 9.0)], "split string, metric string, value double")
    assert [r["metric"] for r in scoring.regressions(now, base, ["split", "metric"]).collect()] == ["acc"]
    criteria = spark.createDataFrame([("s", "acc", 0.5, None), ("s", "acpl", None, 200.0), ("s", "n_count", 2.0, None)], "split string, metric string, low double, high double")
    assert {r["metric"]: r["status"] for r in scoring.gate(now, criteria, ["split", "metric"]).collect()} == {"acc": "pass", "acpl": "missing", "n_count": "fail"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"task": "t", "tier": 1, "fen": "f"}\n\nnot json\n{"task": "u", "tier": 2}\n')
    good, bad = readers.split_corrupt(readers.read_jsonl(spark, str(tmp_path / "rows.jsonl"), schemas.SFT_ROW).cache())
    assert good.count() == 2 and [r[0] for r in bad.collect()] == ["not json"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.jsonl", "one\ntwo\n")
        z.writestr("b.txt", "no")
    (tmp_path / "m.zip").write_bytes(data.getvalue())
    assert [(r["member"], r["line_no"], r["line"]) for r in readers.read_zip_lines(spark, str(tmp_path / "m.zip")).orderBy("line_no").collect()] == [("a.jsonl", 0, "one"), ("a.jsonl", 1, "two")]
    e2e4, e7e8q = 12 << 6 | 28, 4 << 12 | 52 << 6 | 60
    (tmp_path / "b.bin").write_bytes(struct.pack(">QHHI", 7, e2e4, 3, 0) + struct.pack(">QHHI", 7, e7e8q, 1, 0) + b"cut")
    moves = readers.weighted_moves(readers.read_polyglot(spark, str(tmp_path / "b.bin"))).first()["moves"]
    assert [(m["uci"], m["weight"]) for m in moves] == [("e2e4", 0.75), ("e7e8q", 0.25)]
    checked = validate.with_errors(good, [(F.col("fen").isNull(), "no_fen")])
    assert writers.write_validated(checked, "errors", str(tmp_path / "out")) == {"rows": 2, "rejected": 1}
    assert [json.loads(x)["task"] for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()] == ["t"]
    writers.write_splits(spark.createDataFrame([("a", "k2"), ("b", "k1"), ("b", None)], "split string, key string"), str(tmp_path / "s"), "split", "key")
    assert readers.read_blocklist(spark, str(tmp_path / "s/blocklist")).count() == 2


def test_stream_keeps_the_best(spark, tmp_path):
    schema = "k string, q int, o int"
    order = lambda: [F.col("q"), -F.col("o")]
    for i, rows in enumerate(([("a", 1, 1), ("b", 9, 2)], [("a", 5, 3), ("b", 9, 4)], [("a", 5, 5), ("c", 0, 6)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        keep_best.run_keep_best(stream, str(tmp_path / "table"), str(tmp_path / "check"), ["k"], order())
    got = keep_best.read_table(spark, str(tmp_path / "table"), stream.schema).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 5, 3), ("b", 9, 2), ("c", 0, 6)] and i == 2
