"""The registered queries on the smallest tables: against their SQL where it exists,
and against plain code where it doesn't."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from plyforge.llm import oracle_sql, queries
from plyforge.llm import sentencepiece_nbest as P

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        duckdb.sql(f"create or replace view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, want = queries()[name](spark, SF), duckdb.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    own, got = texts(spark), {r["doc_id"]: r for r in queries()["op6_token_ids"](spark, SF).collect()}
    assert got.keys() == own.keys()
    for i in sorted(own):
        ids = np.array([*library.encode(own[i], add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_lm_base_scores_are_exact_and_scores_are_probabilities(spark):
    own, got = texts(spark), {r["doc_id"]: r for r in queries()["op8_lm_scores"](spark, SF).collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b" "] for i, t in own.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = counts.total(), len(counts)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] <= 1e-9


def test_best_segmentations_round_trip(spark):
    own, vocab = texts(spark), P.vocabulary(P.model_path())
    for r in queries()["op9_sentencepiece_nbest"](spark, SF).collect():
        found = vocab.encode(own[r["doc_id"]], 4)
        assert r["round_trip"] and r["n_best"] == len(found) and r["score"] == found[0][0] and r["last_score"] == found[-1][0]


def test_learned_queries_score_every_document(spark):
    for name, divisor, rest in (("op2_quality_classifier", 3, 1), ("op4_toxicity", 5, 0)):
        got = queries()[name](spark, SF).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(texts(spark))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) for r in got)
