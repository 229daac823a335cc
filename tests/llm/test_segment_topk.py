import math
import random

import numpy as np
from pyspark.sql import functions as F

from plyforge.llm import segment_topk as K


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, dim int, block int")


def vectors(n=300, d=13, seed=1):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.4), 2) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(0, 60, 3)]  # ties
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * (d - 2)), (1020, [float("nan")] * d), (1040, [float("inf")] + [0.0] * (d - 1)), (None, [1.0] * d)]
    rows += [(2000, [1.0, 2.0]), (2001, [0.5, -3.0]), (2020, []), (2021, []), (2040, [7.0, 1.0, 1.0])]
    rows += [rows[40], rows[40], rows[5]]
    return rows


def brute(rows, k=20):
    ok = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, asked = [], {}
    for i, v in ok:
        if i % 20 == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ok if j != i and len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_equals_brute_force(spark):
    rows = vectors()
    frame = table(spark, rows)
    assert got(K.topk(frame, F.col("vec_id") % 20 == 0)) == brute(rows)
    assert got(K.topk(frame, F.col("vec_id") % 20 == 0, query_rows=3, cand_rows=7)) == brute(rows)


def test_empty(spark):
    assert got(K.topk(table(spark, []), F.col("vec_id") % 20 == 0)) == []


def test_levels_are_nested_and_bounds_only_tighten():
    rng = np.random.default_rng(3)
    for dim in (1, 5, 13, 64, 100):
        x = np.floor(rng.normal(0, 40, (200, dim)))
        exact, past = x[:50] @ x.T, np.inf
        for segments in K.levels_of(dim):
            f = K.level_features(x, segments)
            bound = f[:50] @ f.T
            assert (bound >= exact - 1e-6).all() and (bound <= past + 1e-6).all()
            past = bound


def share_multiplied(x, n):
    queries, cands, best = K.Block(np.arange(n), x[:n]), K.Block(np.arange(len(x)), x), K.Best(n, 20)
    seen, multiplied = K.search(queries, cands, best)
    assert seen == n * len(x)
    scores = (x[:n] @ x.T).astype(np.int64)
    scores[np.arange(n), np.arange(n)] = -(2**62)
    assert (best.scores == -np.sort(-scores, axis=1)[:, :20]).all()
    return multiplied / seen


def test_few_pairs_are_multiplied():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (40, 64))
    clustered = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 3, (4000, 64)))
    assert share_multiplied(clustered, 100) < 0.1
    # vectors without any structure, of one length: the more there are, the fewer
    alike = rng.normal(0, 1, (40_000, 64))
    alike = np.floor(64 * alike / np.linalg.norm(alike, axis=1, keepdims=True))
    assert share_multiplied(alike, 40) < 0.4


def test_scores_beyond_floating_point_are_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**30, 3.0]), (2, [2.0**30, 2.0]), (3, [2.0**100, 1.0])]
    assert got(K.topk(table(spark, rows), F.col("vec_id") % 20 == 0)) == [
        (0, 1, 3, 2**63 - 1), (0, 2, 1, 2**62 + 64 * 192), (0, 3, 2, 2**62 + 64 * 128)
    ]


def test_odd_scores_near_the_64_bit_limit_are_told_apart(spark):
    rows = [(0, [2.0**20, 1 / 64]), (1, [2.0**30, 3 / 64]), (2, [2.0**30, 5 / 64]), (3, [2.0**30, 4 / 64])]
    assert got(K.topk(table(spark, rows), F.col("vec_id") % 20 == 0)) == [(0, 1, 2, 2**62 + 5), (0, 2, 3, 2**62 + 4), (0, 3, 1, 2**62 + 3)]


def test_tasks_follow_the_size():
    assert K._salts(1, 13) == 13 and K._salts(1, 100_000) == 1563 and K._salts(60_000, 2_000_000) == 1


def test_query_equals_its_sql(spark):
    import duckdb

    duckdb.sql("create or replace view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = duckdb.sql(K.ORACLE_SQL["op10_exact_topk"]).fetchall()
    assert got(K.op10_exact_topk(spark, "/root/testdata/sf0.001")) == sorted(want)
