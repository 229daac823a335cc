"""SimHash near-duplicate groups by a binary trie self-join.

Every text becomes a 64-bit fingerprint; equal fingerprints are merged before
anything is compared, so a mass of exact copies is one node. Two fingerprints
link when they differ in at most ``budget`` bits. The bits are cut in
``budget + 2`` blocks: of two linked fingerprints at least two blocks agree in
full, so each pair of blocks keys one table whose groups are the subtries below
an error-free path. In a group a binary trie is joined with itself: node pairs
descend together, differing bits add up, and a pair is dropped as soon as its
errors pass the budget. A group above ``group_limit`` fingerprints is cut again
by the same rule over its remaining bits, so no task holds an unbounded group,
and pairs known to be connected are not opened: a group gives a spanning forest
of its links, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .graph import components, spread_join
from .store import stash, unstash

BITS = 64
#: Words are runs of anything but these: space and x09 to x0D, the white space
#: of bytes.split(); bytes.lower() changes A-Z only.
SEED = 42
_CHUNK = 1 << 16


def text_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included. Fewer
    words than a shingle has: the whole sequence; no words or null: none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype="<u8")
    if len(tokens) <= words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(g, SEED) for g in grams], dtype="<u8")


def fold(hashes: np.ndarray) -> int:
    """The signed fingerprint of shingle hashes: a bit is 1 if set in over half."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int32
        )
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row of docs; null and empty texts have fp 0."""

    def run(batches):
        for batch in batches:
            out = [fold(text_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find whose labels are read for whole arrays at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]: labels fall to the least of their class, by
        rounds of hooking and pointer jumping."""
        label = self.label
        while len(a):
            ra, rb = label[a], label[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            # the roots that were hooked, then whoever pointed to them
            while True:
                nxt = label[label]
                if (nxt == label).all():
                    break
                label[:] = nxt


def _uniform(label: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether all labels in each range are the same."""
    ends = np.stack([lo, hi], 1).ravel()
    padded = np.r_[label, 0]
    return np.minimum.reduceat(padded, ends)[::2] == np.maximum.reduceat(padded, ends)[::2]


def _members(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all ranges, and the number of the range of each."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def trie_forest(fps: np.ndarray, group: np.ndarray, budget: int, step: int = 200_000) -> np.ndarray:
    """Labels of fps (unsigned, sorted by group, then value, distinct within a
    group): two positions share a label if links of at most ``budget`` bits
    within their group join them. Node pairs are ranges of the sorted array and
    descend one bit at a time, at most ``step`` pairs together."""
    n = len(fps)
    forest = _Forest(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], n] if n else starts
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    # (lows and highs of both nodes, errors); all pairs of one entry stand at its depth
    work = [(np.stack([starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int64)]), 0)] if len(starts) else []
    while work:
        pairs, depth = work.pop()
        if pairs.shape[1] > step:
            half = pairs.shape[1] // 2
            work += [(pairs[:, :half], depth), (pairs[:, half:], depth)]
            continue
        alo, ahi, blo, bhi, err = pairs
        label = forest.label
        # a pair whose two ranges are known to be one class has nothing to add
        go = np.ones(len(alo), dtype=bool)
        known = np.flatnonzero((label[alo] == label[blo]) & (label[ahi - 1] == label[alo]) & (label[bhi - 1] == label[alo]))
        if len(known):
            known = known[_uniform(label, alo[known], ahi[known]) & _uniform(label, blo[known], bhi[known])]
            go[known] = False
        # the bits that are left fit in the budget: all of both ranges link, so a star says it
        whole = np.flatnonzero(go & (err + (BITS - depth) <= budget))
        if len(whole):
            for lo, hi in ((alo, ahi), (blo, bhi)):
                members, of = _members(lo[whole], hi[whole])
                forest.link(members, alo[whole][of])
            go[whole] = False
        single = np.flatnonzero(go & (ahi - alo == 1) & (bhi - blo == 1))
        if len(single):
            a, b = alo[single], blo[single]
            near = (a != b) & (popcount(fps[a] ^ fps[b]) <= budget)
            forest.link(a[near], b[near])
            go[single] = False
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = pairs[:, go]
        same = alo == blo
        amid, bmid = _split(fps, alo, ahi, depth), _split(fps, blo, bhi, depth)
        kids = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, err]), np.stack([amid, ahi, bmid, bhi, err]),
                np.stack([alo, amid, bmid, bhi, err + 1]), np.stack([amid, ahi, blo, bmid, err + 1])[:, ~same],
            ],
            axis=1,
        )
        a0, a1, b0, b1, e = kids
        kids = kids[:, (e <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))]
        if kids.shape[1]:
            work.append((kids, depth + 1))
    return forest.label


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First position in [lo, hi) whose bit at depth (from the top) is 1: the
    range is sorted and agrees above that bit, so a binary search finds it."""
    shift = np.uint64(BITS - 1 - depth)
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        bit = (fps[np.where(open_, mid, 0)] >> shift) & one
        right = open_ & (bit == 0)
        left = open_ & (bit == 1)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(left, mid, hi)


def block_masks(bits: list[int], budget: int) -> list[int]:
    """Masks of all pairs of budget + 2 blocks that the given bits are dealt to:
    numbers that differ in at most budget of these bits agree on one mask."""
    blocks = [list(b) for b in np.array_split(np.array(bits), budget + 2)]
    return [sum(1 << int(i) for i in (*blocks[x], *blocks[y])) for x, y in combinations(range(len(blocks)), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, budget: int, group_limit: int) -> DataFrame:
    """(path, mask, key, fp): fp once for each subtrie it belongs to. Groups above
    group_limit are cut again over the bits that their masks leave open."""
    masks = block_masks(list(range(BITS)), budget)
    level = nodes.select(
        "fp",
        F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"),
    ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    parts = []
    open_masks = masks
    while True:
        # a mask that leaves a few bits open has small groups whatever the texts are
        wide = [m for m in open_masks if 64 - m.bit_count() > budget + 2]
        sizes = level.groupBy("mask", "key").count().filter((F.col("count") > group_limit) & F.col("mask").isin([_signed(m) for m in wide]))
        hot = stash(sizes.select("mask", "key"), "hot")
        if hot.isEmpty():
            unstash(hot)
            return _union([*parts, level])
        parts.append(level.join(hot, ["mask", "key"], "left_anti"))
        finer, cases = [], None
        for m in wide:
            rest = [i for i in range(BITS) if not m >> i & 1]
            more = [m | x for x in block_masks(rest, budget)]
            finer += more
            lit = F.array(*[F.lit(_signed(x)) for x in more])
            test = F.col("mask") == F.lit(_signed(m))
            cases = F.when(test, lit) if cases is None else cases.when(test, lit)
        level = (
            level.join(hot, ["mask", "key"], "left_semi")
            .select("fp", F.explode(cases).alias("mask"))
            .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        )
        open_masks = list(dict.fromkeys(finer))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Rows of keyed fingerprints that a task works through at a time, and holds at all.
_BATCH_ROWS, _TASK_ROWS = 500_000, 4_000_000


def _trie_links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, budget: int) -> pa.RecordBatch:
    """The edges (u, v) of whole groups (equal mask and key) of fingerprints."""
    order = np.lexsort((fp.view(np.uint64), key, mask))
    mask, key, fp = mask[order], key[order], fp[order].view(np.uint64)
    group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    label = trie_forest(fp, group, budget)
    far = np.flatnonzero(label != np.arange(len(label)))
    out = np.unique(np.stack([fp[far].view(np.int64), fp[label[far]].view(np.int64)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def links(nodes: DataFrame, budget: int = 4, group_limit: int = 200_000) -> DataFrame:
    """(u, v): for the distinct fingerprints nodes(fp), edges whose components
    are those of all pairs that differ in at most ``budget`` bits. Groups come to a
    task in order and are worked through a batch at a time, so it holds a batch and
    one group at most. Counting runs jobs while the plan is built."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i).to_numpy() for i in range(3)]
            held.append(columns)
            rows += b.num_rows
            if rows < _BATCH_ROWS:
                continue
            mask, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            # the last group may go on in the next batch
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _trie_links(mask[:cut], key[:cut], fp[:cut], budget)
            held, rows = [[mask[cut:], key[cut:], fp[cut:]]], len(mask) - cut
        if held:
            yield _trie_links(*(np.concatenate(c) for c in zip(*held, strict=True)), budget)

    spark = nodes.sparkSession
    ship(spark)
    keyed = _keyed(nodes, budget, group_limit).select("mask", "key", "fp")
    tasks = -(-nodes.count() * len(block_masks(list(range(BITS)), budget)) // _TASK_ROWS)
    usual = tasks <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition("mask", "key") if usual else keyed.repartition(tasks, "mask", "key")
    return dealt.sortWithinPartitions("mask", "key").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, words: int = 4, budget: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: component_id is the
    smallest doc_id that links reach, its own included. Null and empty texts have
    fingerprint 0 and link to each other; a null doc_id keeps its row and never
    names a component; repeated rows give repeated rows; an empty table, none. Texts
    are read whole, however long; columns besides doc_id and text play no part. A bit
    that is set in exactly half the shingles' hashes is 0."""
    marked = stash(fingerprints(docs, words, text), "fp")
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    named = _named(nodes.withColumnRenamed("fp", "node"), components(links(nodes.select("fp"), budget)))
    return spread_join(marked, named.withColumnRenamed("node", "fp"), "fp", marked.count()).select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n, component_id) of nodes(node, n, least), where n rows have a node and
    least is the smallest doc_id of these; components that roots(node, root) doesn't
    name are single nodes."""
    joined = nodes.join(roots, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    joined = stash(joined, "roots")
    heads = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")).withColumnRenamed("_n", "n")
    return stash(spread_join(joined.withColumnRenamed("n", "rows"), stash(heads, "heads"), "root", joined.count()).select("node", F.col("rows").alias("n"), "component_id"), "named")


#: Odd multipliers that make independent fingerprints of one word's hash.
_VIEWS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9))


def word_fingerprints(text: str | None, views: int) -> list[int]:
    """Independent signed fingerprints of a text's distinct words; 0 without words."""
    tokens = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    hashed = xxhash.xxh64_intdigest
    base = np.array(sorted(hashed(w, SEED) for w in tokens), dtype="<u8")
    out = []
    for m in _VIEWS[:views]:
        x = (base ^ (base >> np.uint64(31))) * m
        x = (x ^ (x >> np.uint64(29))) * _VIEWS[-1]
        out.append(fold(x ^ (x >> np.uint64(32))))
    return out


def _word_edges(nodes: DataFrame, names: list[str], budget: int) -> DataFrame:
    """(u, v) of nodes(node, *names): for each fingerprint column, edges whose
    components are those of all pairs that differ in at most ``budget`` bits."""
    edges = []
    for n in names:
        first = stash(nodes.groupBy(n).agg(F.min("node").alias("first")), "first")
        edges.append(nodes.join(first, n).filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")))
        near = stash(links(first.select(F.col(n).alias("fp")), budget), "near")
        ends = near.join(first.select(F.col(n).alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col(n).alias("v"), F.col("first").alias("b")), "v")
        edges.append(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return _union(edges)


#: Words of a shingle of the pipeline's stage.
_WORDS = 5
#: Sampled views: shingles of one fingerprint, and the orders that choose them.
_SAMPLE, _SAMPLES = 5, 16
_ORDERS = np.array([xxhash.xxh64_intdigest(f"order {i}", SEED) | 1 for i in range(_SAMPLE * _SAMPLES)], "<u8")


def sampled_fingerprints(shingles: np.ndarray) -> np.ndarray:
    """Signed fingerprints of _SAMPLES samples of a shingle set; none of an empty
    one. A sample is the first shingle in each of _SAMPLE orders: two sets of
    similarity s have the same with probability s ** _SAMPLE, wherever they differ,
    so of pairs of 0.8 some 0.2 % have no sample in common."""
    if not len(shingles):
        return np.zeros(0, "<i8")
    best, least = None, None
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024]
        ranks = part[None, :] * _ORDERS[:, None]
        at = ranks.argmin(axis=1)
        rank = ranks[np.arange(len(_ORDERS)), at]
        if best is None:
            best, least = rank, part[at]
        else:
            less = rank < best
            best, least = np.where(less, rank, best), np.where(less, part[at], least)
    bits = np.unpackbits(least.view(np.uint8).reshape(_SAMPLES, _SAMPLE, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(axis=1) * 2 > _SAMPLE, axis=1, bitorder="little").view("<i8")[:, 0]


def _shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingle hashes of a text, sorted."""
    return np.unique(text_hashes(text, _WORDS))


def _set_id(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], "<u8").view("<i8")[0])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of nodes(node, copy, least): copy is the hash of a text of docs,
    least the doc_id that has it (null: rows without one). One row of each mass of
    copies is read again, so a mass isn't moved."""

    def run(batches):
        for batch in batches:
            found = [_shingle_set(t).view("<i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_copy"), F.col("text").cast("string").alias("text"))
    own = texts.join(nodes, (texts["_copy"] == nodes["copy"]) & texts["_id"].eqNullSafe(nodes["least"]))
    return stash(own.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, shingles array<long>"), "sets")


def _sizes_allow(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m members can have that Jaccard similarity."""
    return F.least(n, m) / F.greatest(n, m) >= similarity


def _verified(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have that Jaccard similarity or more. Sets of too
    different sizes are out before any set is moved, so what a hub's set is copied
    for is in proportion to the sets of its partners."""
    once = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    able = (
        once.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("n")), "u").join(sizes.select(F.col("node").alias("v"), F.col("n").alias("m")), "v")
        .filter(_sizes_allow(F.col("n"), F.col("m"), similarity)).select("u", "v")
    )
    both = able.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return stash(both.filter(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v"), "verified")


def _bucket(view: Column | str, key: Column | str) -> Column:
    return F.xxhash64(view, key)


def _stars(members: DataFrame, total: int) -> DataFrame:
    """members(bucket, node, ...) of buckets with more than one, with first and last:
    two hubs that all members are compared with, so a bucket of n costs 2 n pairs."""
    ends = stash(members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).filter("first <> last"), "ends")
    return spread_join(members, ends, "bucket", total)


def _edges(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("node").alias("u"), F.explode(F.array("first", "last")).alias("v"))
    return both.filter("u <> v")


def _finer(shared: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): more candidates for buckets of shared(bucket, used, node) whose members
    roots(node, root) leave in several components: a member that isn't like either hub
    may be like another member. Such members are dealt to finer buckets, one for each
    further sample, and compared with the hubs of these."""
    rest = shared.select("bucket", "used", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = stash(rest, "rest")
    split = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("bucket", "n")
    open_ = stash(spread_join(rest, stash(split, "split"), "bucket", rest.count()), "open")
    further = F.expr(f"filter(sequence(0, {_SAMPLES - 1}), w -> w <> used)")
    finer = open_.join(nodes.select("node", "samples"), "node").select("bucket", "node", "root", "samples", F.explode(further).alias("view"))
    # the same two samples in either order are one bucket
    members = finer.select(F.col("bucket").bitwiseXOR(_bucket("view", F.get("samples", F.col("view")))).alias("bucket"), "node", "root").distinct()
    members = stash(members, "finer")
    mixed = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", "n")
    total = members.count()
    return _edges(_stars(spread_join(members, stash(mixed, "mixed"), "bucket", total), total)).distinct()


def shingle_groups(docs: DataFrame, similarity: float = 0.8, views: int = 3, budget: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row of docs, linked where the sets of their
    five-word shingles (a shorter text is one) have that Jaccard similarity or
    more: fingerprints of distinct words (SimHash, joined by the trie) and of sampled
    shingles only propose pairs, the sets decide. Rows are treated as in near_groups;
    texts without words are equal. Runs jobs while the plan is built."""
    ship(docs.sparkSession)
    names = [f"f{v}" for v in range(views)]

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [_shingle_set(t) for t in texts]
            found = [word_fingerprints(t, views) for t in texts]
            columns = [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([f[v] for f in found], pa.int64()) for v in range(views)]
            columns.append(pa.array([sampled_fingerprints(s) for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "copy", "node", "size", *names, "samples"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", "copy long", "node long", "size long", *(f"{n} long" for n in names), "samples array<long>"])
    marked = stash(kept.mapInArrow(run, schema), "views")
    firsts = [F.first(c).alias(c) for c in ("size", *names, "samples")]
    copy = F.coalesce(F.min_by("copy", "doc_id"), F.min("copy"))
    nodes = stash(marked.groupBy("node").agg(F.min("doc_id").alias("least"), copy.alias("copy"), F.count("*").alias("n"), *firsts), "nodes")
    sizes = nodes.select("node", F.col("size").alias("n"))
    member = nodes.select("node", F.posexplode("samples").alias("used", "key")).select("node", "used", _bucket("used", "key").alias("bucket"))
    shared = stash(_stars(member, nodes.count() * _SAMPLES), "shared")
    edges = stash(_word_edges(nodes.select("node", *names), names, budget).union(_edges(shared)).filter("u <> v").distinct(), "edges")
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    sets = _sets(docs, nodes.select("node", "copy", "least").join(ends, "node"))
    sure = _verified(edges, sizes, sets, similarity)
    more = _finer(shared, components(sure), nodes)
    named = _named(nodes.select("node", "n", "least"), components(sure.union(_verified(more, sizes, sets, similarity))))
    return spread_join(marked, named, "node", marked.count()).select("doc_id", "component_id")


def keep_one(docs: DataFrame, views: int = 3, budget: int = 4) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its shingle_groups group; rows
    without a doc_id stay, rows that repeat one go or stay together. All columns of
    docs, whatever their names, are kept as they are."""
    gone = shingle_groups(docs.select("doc_id", "text"), views=views, budget=budget)
    gone = stash(gone.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
#: Fingerprints and reachability are tested against brute force; SQL has no XXH64.
ORACLE_SQL: dict[str, str] = {}

__all__ = ["fingerprints", "fold", "keep_one", "links", "near_groups", "sampled_fingerprints", "shingle_groups", "text_hashes", "trie_forest", "word_fingerprints"]
