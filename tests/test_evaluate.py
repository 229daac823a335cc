import json

import pytest
from pyspark.sql import functions as F

from plyforge.functions import chess as C
from plyforge.operators import benchmark as B
from plyforge.operators import evaluate as E
from plyforge.sources import artifacts as A


def frozen(spark):
    extra = '{"best_move":"e2e4","cp":30,"move_a":"e2e4","move_b":"d2d4","better_move":"e2e4"}'
    rows = spark.createDataFrame([(i, C.START, extra) for i in range(6)], "id int, fen string, extra string")
    tasks = ["board_to_fen", "legal_moves", "legality_check", "best_move", "material_count", "binary_choice"]
    prompts = spark.createDataFrame([(t, f"{t} {{fen}}") for t in tasks], "task_type string, template string")
    made = B.freeze_split(rows, "x", tasks, "id", templates=prompts)
    cp = F.map_concat("metadata", F.when(F.col("task_type") == "best_move", F.create_map(F.lit("cp"), F.lit("30"))).otherwise(F.create_map().cast("map<string,string>")))
    return made.withColumn("metadata", cp)


def test_gold_answers_score_one_and_others_less(spark):
    examples = frozen(spark)
    said = lambda f: examples.select("example_id", F.lit(0).alias("sample_index"), f.alias("prediction"), F.lit(None).cast("string").alias("raw_prediction"))
    best = {r["task_type"]: r for r in E.score(examples, said(F.col("gold_answer"))).collect()}
    assert {t: r["primary"] for t, r in best.items()} == dict.fromkeys(best, 1.0) and len(best) == 6 and best["board_to_fen"]["fen_first4"] == 1.0
    assert best["best_move"]["format_compliance"] == 0.0 and best["best_move"]["legal_move"] is None and best["legality_check"]["legality_reason_accuracy"] == 1.0
    none = {r["task_type"]: r["primary"] for r in E.score(examples, said(F.col("gold_answer")).limit(0)).collect()}
    assert len(none) == 6 and set(none.values()) == {0.0}
    wrong = E.score(examples, said(F.lit("<think>hm</think>\n<move>d2d4</move>")))
    got = {r["task_type"]: r for r in wrong.collect()}
    assert got["best_move"]["primary"] == 0.0 and got["best_move"]["legal_move"] == 1.0 and got["best_move"]["format_compliance"] == 1.0 and got["binary_choice"]["primary"] == 0.0
    assert got["legal_moves"]["primary"] == pytest.approx(1 / 20)
    deep = {r["task_type"]: r for r in E.diagnostics(wrong).collect()}
    assert deep["legal_moves"]["uci_set"].asDict() == {"prediction_count": 1, "gold_count": 20, "true_positive_count": 1, "extra_count": 0, "missing_count": 19, "precision": 1.0, "recall": 0.05, "illegal_extra_count": 0}
    assert deep["board_to_fen"]["fen_diagnostics"].asDict() == {"prediction_fen": None, "gold_fen": C.START, "first4_match": False, "full_match": False} and deep["legality_check"]["legality"]["binary_match"] is False
    means = {r["metric"]: r["value"] for r in E.secondary(wrong, ["split"]).collect()}
    assert means["primary"] == pytest.approx(0.05 / 6) and "final_jaccard" not in means


def test_losses(spark):
    examples = frozen(spark).filter("task_type = 'best_move'")
    evals = spark.createDataFrame([(C.START, "d2d4", 10)], "fen string, move string, cp int")
    for text, want in (("d2d4", 20.0), ("a2a3", 1000.0), ("none", 1000.0)):
        said = examples.select("example_id", F.lit(0).alias("sample_index"), F.lit(text).alias("prediction"))
        assert [r["loss"] for r in E.losses(examples, said, evals).collect()] == [want]


def test_files_come_back(spark, tmp_path):
    examples, root = frozen(spark), f"file://{tmp_path}/bench"
    assert A.write_benchmark(examples, root) == {"x": 6}
    back = A.read_benchmark(spark, f"{root}/split=x")
    assert back.count() == 6 and A.read_benchmark(spark, f"{root}/split=x", ["best_move"]).count() == 1 and A.read_benchmark(spark, f"{root}/split=x", most=2).count() == 2
    prompts = A.prompts(examples)
    assert prompts.count() == 6 and prompts.filter("prompt_id = 'x_00000'").first()["messages"][0]["content"].startswith("board_to_fen ")
    with pytest.raises(ValueError):
        A.prompts(examples.union(examples))
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps({"example_id": "a", "prediction": "x"}), json.dumps({"example_id": "a", "prediction": "y", "sample_index": 1, "raw_prediction": "Y"}), "junk", ""]))
    said = A.read_predictions(spark, f"file://{tmp_path}/p.jsonl")
    assert sorted((r["sample_index"], r["prediction"], r["raw_prediction"]) for r in said.collect()) == [(0, "x", "x"), (1, "y", "Y")]
    merged = A.merged_predictions(said, said.withColumn("prediction", F.lit("z")))
    assert sorted((r["sample_index"], r["prediction"]) for r in merged.collect()) == [(0, "x"), (1, "y"), (2, "z"), (3, "z")] and A.first_predictions(merged).first()["prediction"] == "x"
    A.write_predictions(said, f"file://{tmp_path}/out")
    assert sorted(A.read_predictions(spark, f"file://{tmp_path}/out").collect()) == sorted(said.collect())
    (tmp_path / "r.jsonl").write_text('{"fen":"f","candidate_ratings":[{"uci":"e2e4","cp":1}]}\n{"fen":"","candidate_ratings":[]}\n{"fen":"g"}\nx\n')
    assert A.read_rated(spark, f"file://{tmp_path}/r.jsonl").count() == 1
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match="benchmark row"):
        A.read_benchmark(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_scopes(spark):
    assert E.split_names(["a", "b", "c"], ["c", "x", "a"]) == ["a", "c"] and E.split_names(["a"], None, ["b"]) == [] and E.split_names(["a"]) == ["a"]
    assert E.engine_splits(["planning", "x"], "c") == ["planning"] and E.engine_splits(["planning"], "a") == [] and E.engine_splits(["x"], None, full=True) == ["x"] and E.engine_splits(["x"], None, True, True) == []
    rows = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "u")], "split string, task_type string")
    assert sorted(map(tuple, E.in_scope(rows, {"a": ["t"]}).collect())) == [("a", "t"), ("b", "u")]
    keys = spark.createDataFrame([("best_move", ["primary"]), ("best_move", ["primary", "legal_move"]), ("other", ["primary"]), ("other", None)], "t string, k array<string>")
    assert [r["n"] for r in keys.select(E.needs_refresh(F.col("k"), F.col("t"), {"best_move": ("legal_move",)}).alias("n")).collect()] == [True, False, False, True]
    examples = frozen(spark)
    said = lambda text: examples.select("example_id", F.lit(0).alias("sample_index"), text.alias("prediction"), F.lit(None).cast("string").alias("raw_prediction"))
    both = E.compare(examples, said(F.lit("?")), said(F.col("gold_answer"))).agg(F.sum("baseline").alias("b"), F.sum("candidate").alias("c")).first()
    assert (both["b"], both["c"]) == (0.0, 6.0)
