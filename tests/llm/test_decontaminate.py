import random
from collections import Counter

import numpy as np

from plyforge.llm import decontaminate_simhash as D

from .fixtures import awkward_texts, docs, words

ITEMS = "item_id long, text string, fp string, block int"


def items_of(rng):
    return [(i, " ".join(words(rng, n))) for i, n in enumerate((30, 30, 42, 25, 8, 3, 1))] + [(20, None), (21, " "), (None, "a b c d e f g")]


def planted(rng, items):
    rows = []
    for n, (item, text) in enumerate(items[:6]):
        ws = text.split()
        for variant in range(4):
            passage = ws[:]
            if variant == 1 and len(ws) > 20:
                passage[len(ws) // 2] = "other"  # 5 of 26 and more shingles go
            if variant == 2 and len(ws) > 20:
                passage[0] = "edge"
            if variant == 3:
                passage = passage[: len(ws) // 2]  # half: not to be found
            before, after = words(rng, rng.choice((0, 1, 50))), words(rng, rng.choice((0, 1, 50)))
            rows.append((1000 + 10 * n + variant, " ".join([*before, *passage, *after]).upper() if variant == 2 else "\n".join([*before, *passage, *after])))
    rows.append((2000, " ".join([items[0][1]] * 30)))
    rows.append((2000, " ".join([items[0][1]] * 30)))
    return rows


def brute(rows, items, similarity=0.8):
    out = {}
    for doc, text in rows:
        ws = (text or "").lower().split()
        for item, want in items:
            own = (want or "").split()
            if doc is None or item is None or not own or not ws:
                continue
            k = min(5, len(own))
            if len(ws) < k:
                continue
            right = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
            best = (0.0, 0)
            for s in range(max(1, len(ws) - len(own) + 1)):
                w = ws[s : s + len(own)]
                left = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
                both = sum((left & right).values())
                best = max(best, (both / (left.total() + right.total() - both), -s))
            if best[0] >= similarity:
                out[doc, item] = (best[0], -best[1])
    return out


def test_equals_all_windows_against_all_items(spark):
    rng = random.Random(4)
    items = items_of(rng)
    rows = [*planted(rng, items), *[r for r in awkward_texts(n=20) if r[0] != 305]]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in D.contaminated(docs(spark, rows).select("doc_id", "text"), bench, radius=31).collect()}
    want = brute(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    usual = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs(spark, rows).select("doc_id", "text"), bench).collect()}
    assert usual <= want.keys() and len(usual) >= 0.95 * len(want)
    kept = D.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark).columns
    bad = {d for d, _ in usual}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad)


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(0)
    for radius in (2, 16, 31):
        blocks = D.hamming_blocks(radius)
        assert sum(bits for _, bits, _ in blocks) == 64 and sum(errors + 1 for *_, errors in blocks) == radius + 1
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(bin(x >> first & (1 << bits) - 1).count("1") <= errors for first, bits, errors in blocks)


def test_blocks_find_all_near_pairs_and_open_few(spark):
    rng = np.random.default_rng(1)
    items = [(i, 9, int(x)) for i, x in enumerate(rng.integers(-(2**63), 2**63 - 1, 40))]
    found = []
    for n in range(200):
        x = items[n % 40][2] & (1 << 64) - 1
        for b in rng.choice(64, n % 30, replace=False):
            x ^= 1 << int(b)
        found.append((f"w{n}", 9 if n % 7 else 8, x - (1 << 64) if x >> 63 else x))
    left, right = spark.createDataFrame(found, "window_id string, size int, fp long"), spark.createDataFrame(items, "item_id long, size int, fp long")
    got = sorted(tuple(r) for r in D.near_pairs(left, right, 16).collect())
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == sorted((w, i, apart(x, y)) for w, s, x in found for i, t, y in items if s == t and apart(x, y) <= 16)
    # of pairs that have nothing in common, the share that some block pairs up
    x, y = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    hit = np.zeros(20_000, bool)
    for first, bits, errors in D.hamming_blocks(16):
        hit |= np.bitwise_count((x ^ y) >> np.uint64(first) & np.uint64((1 << bits) - 1)) <= errors
    assert hit.mean() < 0.2


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f", "x", 1)], ITEMS)
    assert D.contaminated(docs(spark, []).select("doc_id", "text"), bench).count() == 0
    assert D.contaminated(docs(spark).select("doc_id", "text"), bench.limit(0)).count() == 0


def test_reordered_passages_equal_brute_force(spark):
    rng = random.Random(21)
    items = [(n, " ".join(words(rng, size))) for n, size in enumerate((40, 48, 59, 59))]
    rows = []
    for n, text in items:
        ws = text.split()
        for i, cut in enumerate((len(ws) // 2, len(ws) // 3)):
            rows.append((10 * n + i, " ".join([*words(rng, 100), *ws[cut:], *ws[:cut], *words(rng, 100)])))
        rows.append((10 * n + 2, " ".join([*ws[20:], *ws[:20]])))
        rows.append((10 * n + 3, " ".join([*ws[: len(ws) - 4], *words(rng, 30)])))
        rows.append((10 * n + 4, " ".join(ws[4:])))
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    found = D.contaminated(docs(spark, rows).select("doc_id", "text"), bench, radius=31).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in found}
    want = brute(rows, items)
    assert {(10 * n, n) for n in range(4)} <= want.keys()
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_edits_inside_very_long_texts_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(n, " ".join(words(rng, size))) for n, size in enumerate((36, 50, 58))]
    rows = []
    for n, text in items:
        ws = text.split()
        edited = {
            "swapped": [*ws[18:], *ws[:18]], "inserted": [*ws[:9], "one", "two", *ws[9:]], "deleted": [*ws[:7], *ws[10:]],
            "repeated": [*ws[:20], *ws[15:]], "lost": ws[::2],
        }
        for i, own in enumerate(edited.values()):
            rows.append((10 * n + i, " ".join([*words(rng, 3000), *own, *words(rng, 3000)])))
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in D.contaminated(docs(spark, rows).select("doc_id", "text"), bench, radius=31).collect()}
    want = brute(rows, items)
    assert {10, 20, 21} <= {d for d, _ in want} and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_query_runs_on_its_tables(spark):
    found = D.op7_benchmark_decontamination(spark, "/root/testdata/sf0.001")
    assert found.columns[:2] == ["doc_id", "item_id"] and found.count() == found.select("doc_id", "item_id").distinct().count()
