import math
import zlib
from collections import Counter

import numpy as np
import pytest

from plyforge.llm import bloom_lm as L
from plyforge.llm.pu_quality import held_out

from .fixtures import awkward_texts, docs


def split(text):
    return [*(text or "").encode().lower().split(), None]


def trains(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def exact(rows):
    counts = Counter(w for i, t in rows if trains(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = split(t)
        out.append((i, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (str(r[0]), *r[1:]))


@pytest.mark.parametrize("frequent", [0, 5, 300_000])
def test_base_score_is_exact(spark, frequent):
    rows = awkward_texts()
    got = L.score_texts(docs(spark), ~held_out(7, 2), frequent=frequent).collect()
    got = by_id([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got])
    for a, b in zip(got, by_id(exact(rows)), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_scores_follow_exact_counts(spark):
    """With quantised counts in place of exact ones, few probes answer wrongly."""
    rows = awkward_texts()
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if trains(i):
            ws = split(t)
            words.update(ws)
            words["start"] += 1
            pairs.update(zip(["start", *ws[:-1]], ws, strict=True))
    n = sum(words.values()) - words["start"]
    v = len(words) - 1
    about = lambda c: float(L.count_of(L.levels_of(np.array([c])))[0]) if c else 0.0
    want = {}
    for i, t in rows:
        ws = split(t)
        want[i] = sum(
            math.log10((about(pairs[a, b]) + 100 * (about(words[b]) + 1) / (n + v + 1)) / (about(words[a]) + 100))
            for a, b in zip(["start", *ws[:-1]], ws, strict=True)
        )
    off = [abs(r["score"] - want[r["doc_id"]]) / r["n_tokens"] for r in L.score_texts(docs(spark), ~held_out(7, 2)).collect() if r["doc_id"] is not None]
    assert np.mean(off) < 0.05 and max(off) < 1


def test_shards_in_turn_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_BYTES", 10_000)
    monkeypatch.setattr(L, "SLICE_CHARS", 500)
    one = L.score_texts(docs(spark), ~held_out(7, 2)).collect()
    many = L.score_texts(docs(spark), ~held_out(7, 2), max_filter_bytes=6000).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_levels_are_read_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.geometric(0.05, len(keys))
    data = L.fill(keys & L._KEY, counts).tobytes()
    shard = L.Shard(1, 0, [len(data)], data)
    got = shard.levels(keys)
    want = L.levels_of(counts)
    assert (got >= want).all() and np.mean(got > want) < 0.06
    absent = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
    assert np.mean(shard.levels(absent) > 0) < 0.06


def test_nothing_to_learn_from(spark):
    got = L.score_texts(docs(spark), held_out(7, 2) & ~held_out(7, 2)).collect()
    assert len(got) == len(awkward_texts()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert L.score_texts(docs(spark, []), ~held_out(7, 2)).count() == 0
