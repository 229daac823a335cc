import random

import corpus_pipeline as C

from .fixtures import awkward_texts, docs, words


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(words(rng, 30))
    rows, labels = [], []
    for i in range(160):
        text = " ".join(words(rng, rng.randint(40, 90)))
        good, toxic = i % 5 != 0, i % 7 == 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = text[: len(text) // 2] + " you stupid idiot moron " + text[len(text) // 2 :]
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    rows += [(500, rows[1][1]), (501, rows[2][1] + " " + item), (502, None), (None, rows[3][1] + " and more")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in C.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(160) if i % 5 and i % 7}
    assert len(clean & got.keys()) >= 0.95 * len(clean)
    assert not {i for i in range(160) if i % 7 == 0} & got.keys()
    assert len({i for i in range(160) if i % 5 == 0} & got.keys()) <= 3
    assert 500 not in got and 501 not in got and all(r["round_trip"] for r in got.values())


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in C.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).collect() == []
    assert C.run(spark, str(tmp_path)).collect() == []


def test_awkward_rows_without_labels_and_benchmark(spark, tmp_path):
    table = docs(spark, awkward_texts())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, table, str(tmp_path))
        assert got.columns == table.columns, name
        if name == "simhash_near_dedup":
            assert set(rows(got)) < set(rows(table))
            assert got.filter("doc_id is null").count() == table.filter("doc_id is null").count()
        else:
            assert rows(got) == rows(table), name
    assert C.STAGES[-1][1](spark, table, str(tmp_path)).count() == table.count()


def test_stage_order():
    assert [name for name, _ in C.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_nbest"]
