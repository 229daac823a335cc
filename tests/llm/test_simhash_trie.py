import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plyforge.llm import simhash_trie as S
from plyforge.llm.graph import components, spread_join

from .fixtures import awkward_texts, docs, words


def plain_fingerprint(text, k=4):
    tokens = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not tokens:
        return 0
    grams = [b" ".join(tokens)] if len(tokens) <= k else [b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]
    votes = Counter()
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def plain_components(fps, budget):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= budget and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    return label


def classes(labels):
    seen = {}
    for i, x in enumerate(labels):
        seen.setdefault(x, set()).add(i)
    return {frozenset(v) for v in seen.values()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.sets(st.integers(0, 63), max_size=7)), max_size=20), st.integers(0, 5))
def test_trie_finds_the_classes_of_all_links(seeds, flips, budget):
    values = set(seeds)
    for at, bits in flips:
        values.add(seeds[at % len(seeds)] ^ sum(1 << b for b in bits))
    fps = sorted(values)
    label = S.trie_forest(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), budget, step=3)
    assert classes(label) == classes(plain_components(fps, budget))


def test_masks_meet_for_all_numbers_within_the_budget():
    rng = np.random.default_rng(0)
    masks = S.block_masks(list(range(64)), 4)
    assert len(masks) == 15
    for _ in range(300):
        bits = rng.choice(64, 4, replace=False)
        x = sum(1 << int(b) for b in bits)
        assert any(x & m == 0 for m in masks)


def test_groups_equal_brute_force(spark):
    rows = awkward_texts()
    found = S.near_groups(docs(spark)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps, 4)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least.get(x)) for (i, _), f, x in zip(rows, fps, label, strict=True))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in found) == want


def test_hot_groups_are_cut_again_without_loss(spark):
    rng = np.random.default_rng(5)
    fps = {int(rng.integers(0, 2**40)) for _ in range(30)} | {1 << b for b in range(40)} | {3 << b for b in range(40)}
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    wide = {(r["u"], r["v"]) for r in S.links(nodes, 2).collect()}
    cut = {(r["u"], r["v"]) for r in S.links(nodes, 2, group_limit=6).collect()}
    order = sorted(fps)

    def labels(edges):
        parent = {f: f for f in order}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in edges:
            parent[find(u)] = find(v)
        return [find(f) for f in order]

    assert classes(labels(wide)) == classes(labels(cut)) == classes(plain_components(order, 2))


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    frame = docs(spark)
    kept = S.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(7) == 3 and 100 not in ids and 301 not in ids and 300 in ids


def flood(n, pairs):
    """The least member of each class of 0 .. n - 1 under the pairs."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_word_edges_equal_brute_force(spark):
    texts = [t for _, t in awkward_texts()]
    views = list(dict.fromkeys(tuple(S.word_fingerprints(t, 3)) for t in texts))
    nodes = spark.createDataFrame([(i, *v) for i, v in enumerate(views)], "node long, f0 long, f1 long, f2 long")
    near = [
        (i, j) for i in range(len(views)) for j in range(i)
        if any(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in zip(views[i], views[j], strict=True))
    ]
    got = [(r["u"], r["v"]) for r in S._word_edges(nodes, ["f0", "f1", "f2"], 4).collect()]
    assert near and flood(len(views), got) == flood(len(views), near)


def test_components_with_hubs_equal_brute_force(spark):
    rng = random.Random(6)
    # two hubs with many neighbours, a long chain that ends in one, loose pairs
    pairs = [(0, i) for i in range(1, 400)] + [(900, i) for i in range(500, 900)] + [(i, i + 1) for i in range(1000, 1040)] + [(1040, 700)]
    pairs += [(i, i + 1) for i in range(1100, 1140, 2)] + [(7, 7)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs + pairs[:50]], "u long, v long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    want = flood(1200, pairs)
    assert got == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(frame.limit(0)).count() == 0


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(900)], "id long, k long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("more", rows.groupBy("k").count()["k"] * 2)
    got = spread_join(rows, table, "k", 900)
    assert sorted(got.columns) == ["id", "k", "more"] and sorted((r["id"], r["more"]) for r in got.collect()) == [(i, 2 if i % 3 else 2 * i) for i in range(900)]


def test_pairs_in_a_crowd_are_found(spark):
    """Texts that share their larger half, nearly all in some bucket together, and near
    copies of every fourth: the pairs that finer buckets propose grow with the members."""
    rng = random.Random(31)
    shared, rows, want = words(rng, 170), [], set()
    for i in range(240):
        own = shared + words(rng, 100)
        rows.append((i, " ".join(own)))
        if i % 4 == 0:
            copy = own + words(rng, 20)
            rows.append((1000 + i, " ".join(copy)))
            want.add(i)
    assert all(exact_similarity(rows[i][1], rows[j][1]) < 0.7 for i, j in ((0, 2), (4, 9), (10, 30)))
    label = {r["doc_id"]: r["component_id"] for r in S.shingle_groups(docs(spark, rows)).collect()}
    assert all(label[i] == i for i in range(240))
    assert sum(label[1000 + i] == i for i in want) >= 0.95 * len(want)


def test_empty_table(spark):
    assert S.near_groups(docs(spark, [])).count() == 0
    assert S.shingle_groups(docs(spark, [])).count() == 0 and S.keep_one(docs(spark, [])).count() == 0


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op1_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    own = [S.fold(S.text_hashes(texts[i], 4)) & (1 << 64) - 1 for i in ids]
    label = flood(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(own[a] ^ own[b]).count("1") <= 4])
    assert got == {i: (f"{f:016x}", ids[x]) for i, f, x in zip(ids, own, label, strict=True)}


def exact_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_keep_one_keeps_texts_below_the_similarity(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    order = rng.sample(base, len(base))
    spread = [w if i % 30 else "changed" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(order)), (3, " ".join([base[-1], *base[:-1]])), (4, " ".join(spread))]
    assert exact_similarity(rows[0][1], rows[1][1]) < 0.1 and exact_similarity(rows[0][1], rows[2][1]) > 0.8
    wanted = {1, 2} | ({4} if exact_similarity(rows[0][1], rows[3][1]) < 0.8 else set())
    assert {r["doc_id"] for r in S.keep_one(docs(spark, rows)).collect()} == wanted


def test_block_and_spread_edits_are_found(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for n in range(150):
        base = words(rng, rng.choice((110, 250, 600)))
        size, kind = len(base), n % 3
        if kind == 0:
            copy = base + words(rng, size // 5)
        elif kind == 1:
            copy = base[size * 17 // 100 :]
        else:
            copy = [w if i % 30 else "changed" for i, w in enumerate(base)]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
        if exact_similarity(rows[-2][1], rows[-1][1]) >= 0.8:
            want.add(n)
    assert len(want) >= 95
    label = {r["doc_id"]: r["component_id"] for r in S.shingle_groups(docs(spark, rows)).collect()}
    joined = {n for n in range(150) if label[2 * n] == label[2 * n + 1]}
    assert joined <= want and len(joined) >= 0.98 * len(want)


def test_a_hub_without_links_hides_no_pair(spark):
    """Many texts that share their larger half, and near copies of some of them."""
    rng = random.Random(13)
    shared, rows = words(rng, 150), []
    for i in range(30):
        own = shared + words(rng, 60)
        rows += [(i, " ".join(own)), (100 + i, " ".join([*own, "more"]))]
    label = {r["doc_id"]: r["component_id"] for r in S.shingle_groups(docs(spark, rows)).collect()}
    assert label == {i: i % 100 for i in label}
