import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from plyforge.llm import pu_quality as Q
from plyforge.llm import weak_toxicity as X

from .fixtures import awkward_texts, docs, words


def corpus(spark, n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(20, 80)))
        good, toxic = i % 4 != 0, i % 3 == 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += f" you idiot zzblorg{rng.choice('abcd')} " + text[:20]
        rows.append((i, text))
        if i % 5 != 4:
            labels.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_from_positives_and_unlabelled(spark):
    frame, labels = corpus(spark)
    usable = ~Q.held_out(3, 1)
    model = Q.fit(frame, labels, usable)
    assert 0.5 < model.prior < 0.95
    got = Q.classify(frame.select("doc_id", "text"), model).collect()
    right = [(r["quality_score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean(right) > 0.9


def test_quality_takes_awkward_rows(spark):
    frame, labels = corpus(spark)
    model = Q.fit(frame, labels)
    got = Q.classify(docs(spark).select("doc_id", "text"), model).collect()
    assert len(got) == len(awkward_texts()) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert Q.keep_good(docs(spark), labels).columns == docs(spark).columns
    none = labels.filter("false")
    assert Q.fit(frame, none) is None and Q.fit(docs(spark, []), labels) is None
    assert Q.keep_good(frame, none).count() == frame.count()
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    assert Q.fit(frame, odd) is None


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    pos = rng.normal(3, 1, 4000)
    unl = np.r_[rng.normal(3, 1, 2800), rng.normal(-3, 1, 1200)]
    assert abs(Q.estimate_prior(pos, unl) - 0.7) < 0.05


def test_toxicity_learns_lexicon_and_patterns(spark):
    frame, labels = corpus(spark)
    model = X.fit(frame, labels, ~Q.held_out(5, 0))
    got = frame.select("doc_id", X.scorer(model)("text").alias("s")).collect()
    right = [(r["s"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean(right) > 0.95


def test_toxicity_takes_awkward_rows(spark):
    frame, labels = corpus(spark)
    kept = X.keep_clean(docs(spark), labels)
    assert kept.columns == docs(spark).columns
    model = X.fit(docs(spark, []), labels)
    assert model.weights == {} and kept.count() > 0
    assert X.keep_clean(frame, labels.filter("false")).count() == frame.count()


def test_label_model_posteriors_follow_the_better_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = [np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.004) for _ in range(5)]
    poor = rng.random(4000) < 0.1
    votes = np.stack([good[0], *good, poor], 1).astype(np.int8)  # the first two agree always
    posterior, weights = X.label_model(votes, 0.2)
    assert np.mean((posterior > 0.5) == y) > 0.95
    # the twins share their weight; the voter that knows nothing has none
    assert weights[0] + weights[1] < 1.3 * weights[2:-1].mean() and abs(weights[-1]) < 0.3 * weights[2]


def test_labels_are_no_targets():
    """Rows whose labels mining doesn't read may be labelled in any way."""
    rng = random.Random(5)
    texts, label = [], []
    for i in range(900):
        toxic = i % 5 == 0
        texts.append(" ".join(words(rng, 40)) + (f" {rng.choice(('idiot', 'zzqorg', 'scum'))} {rng.choice(('moron', 'xxrap'))}" if toxic else ""))
        label.append(int(toxic) if i < 600 else -1)
    label = np.array(label)
    names, rows, posterior = X.weak_labels(texts, label)
    # a label changes nothing but patterns and prior: those kept, the posteriors are the votes'
    truth = np.arange(900) % 5 == 0
    assert ((posterior > 0.5) == truth).mean() > 0.98 and not np.isin(posterior[label == 1], (0.0, 1.0)).any()
    few = label.copy()
    few[5], few[6] = 0, 1  # wrong labels of two rows
    assert ((X.weak_labels(texts, few)[2] > 0.5) == truth).mean() > 0.98
    model = X.train_linear(rows, posterior, names)
    assert model.weights.keys() <= set(names) and model.score("you zzqorg xxrap idiot") > 0.5 > model.score("you there")


def held_out_accuracy(frame, kind, divisor, rest):
    truth = dict(duckdb.sql(f"select doc_id, max({kind}) from read_parquet('/root/testdata/sf0.1/labels.parquet') group by 1").fetchall())
    rows = [r for r in frame.filter("held_out").collect() if r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows])


def test_held_out_accuracy_on_documents(spark):
    assert held_out_accuracy(Q.op2_quality_classifier(spark, "/root/testdata/sf0.1"), "quality", 3, 1) > 0.9
    assert held_out_accuracy(X.op4_toxicity(spark, "/root/testdata/sf0.1"), "toxic", 5, 0) > 0.97


def test_samples_of_huge_tables(spark):
    share = Q.sample_share(10**11, 12_000)
    assert share > 0
    n = spark.range(4_000_000, numPartitions=4)
    for want in (5e-6, 1e-4, 0.3):
        got = n.filter(Q.in_sample(F.col("id"), want, 12)).count()
        assert abs(got - 4e6 * want) < 5 * (4e6 * want) ** 0.5
    assert n.limit(10).filter(Q.in_sample(F.col("id"), 1.0, 12)).count() == 10


def test_filters_take_empty_tables_repeats_and_clashing_names(spark):
    frame, labels = corpus(spark)
    repeated = frame.union(frame.limit(7)).withColumn("quality_score", F.lit("own")).withColumn("toxic", F.lit(3))
    for kept in (Q.keep_good(repeated, labels), X.keep_clean(repeated, labels)):
        assert kept.columns == repeated.columns and kept.filter("quality_score = 'own' and toxic = 3").count() == kept.count() > 0
    assert Q.keep_good(docs(spark, []), labels).count() == X.keep_clean(docs(spark, []), labels).count() == 0
