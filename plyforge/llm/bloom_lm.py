"""Language-model scores from a log-frequency Bloom filter.

Every n-gram of the training texts (words and pairs) is stored with its count on a
logarithmic scale: an n-gram of level q is put in once for each level 1..q, and its
level is read back by probing 1, 2, ... until a probe misses (Talbot and Osborne,
2007). Pair counts are smoothed towards word counts (Dirichlet prior):
p(w | v) = (c(v, w) + k * p(w)) / (c(v) + k), p(w) = (c(w) + 1) / (N + V + 1).

Counting: each batch of texts merges its own n-grams and deals them, as packed
keys, to segments of a hash space; a segment's task adds up the counts and fills its
own part of the filter, beside the exact counts of its words. The number of segments
follows the size of the training texts, so a task's share is the same at any size,
however frequent a word is. The filter grows with the corpus. It is broadcast in shards of at most
``max_filter_bytes``; with more than one shard the texts pass the shards in turn and
carry the levels found so far, so that memory stays bounded at any corpus size.

The base score needs exact counts: those of the ``frequent`` most frequent words (a
bounded table) are broadcast, all others are joined in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .pu_quality import held_out
from .store import stash

#: Stand for the end of a text and for what is before it; words hold no blank.
END, START = b" ", b"  "
#: Bytes of training text for each segment; some two million tokens.
SEGMENT_BYTES = 12 << 20
#: Characters of texts that a scoring task takes at a time.
SLICE_CHARS = 3_000_000
BITS_PER_ENTRY, HASHES, LEVELS = 8, 4, 40
_KEY = np.uint64((1 << 48) - 1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M3
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h + _M1)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * _M1 + second)


class _Index(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct tokens, place of each token in them, tokens per text):
    words of the lower-cased (A-Z) text, then one end. Null counts as empty."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        found = (t or "").encode("utf-8", "surrogatepass").lower().split()
        words += found
        words.append(END)
        sizes.append(len(found) + 1)
    index = _Index()
    places = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in index], dtype=np.uint64), places, np.array(sizes, dtype=np.int64)


_START = np.uint64(xxhash.xxh64_intdigest(START))


def histories(hashes: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash before each token; the start's for a text's first."""
    here = hashes[places]
    before = np.r_[_START, here[:-1]]
    before[np.cumsum(sizes)[:-1]] = _START
    return before


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts)).astype(np.int64) + 1, LEVELS)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts: 0, 1, 2.5, 5.5, ..."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def _places(keys: np.ndarray, level: int, bits: np.ndarray | np.uint64):
    """The HASHES bit positions of keys at a level, one array each."""
    h = mix((keys & _KEY) + np.uint64(level * int(_M1) & (1 << 64) - 1))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for j in range(HASHES):
        yield (low + np.uint64(j) * high) % bits


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of a segment that holds distinct keys with their counts."""
    level = levels_of(counts)
    bits = np.uint64(max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 64) * 64))
    out = np.zeros(int(bits), dtype=bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in _places(keys[level >= q], q, bits):
            out[place] = True
    return np.packbits(out, bitorder="little")


class Shard:
    """Segments [first, first + len(sizes)) of a filter: their bytes, one after another."""

    def __init__(self, segments: int, first: int, sizes: list[int], data: bytes):
        self.segments, self.first, self.n = segments, first, len(sizes)
        own = np.array(sizes, dtype=np.int64)
        self.bits = (own * 8).astype(np.uint64)
        self.start = np.cumsum(own) - own
        self.data = np.frombuffer(data, np.uint8)

    def levels(self, keys: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The level of each key; keys of other shards keep what is known of them."""
        out = np.zeros(len(keys), np.uint8) if known is None else known.copy()
        seg = segment_of(keys, self.segments).astype(np.int64) - self.first
        alive = np.flatnonzero((seg >= 0) & (seg < self.n))
        for q in range(1, LEVELS + 1):
            if not len(alive):
                break
            k, s = keys[alive], seg[alive]
            ok = np.ones(len(alive), bool)
            for place in _places(k, q, self.bits[s]):
                at = np.flatnonzero(ok)
                p = place[at].astype(np.int64)
                ok[at] = (self.data[self.start[s[at]] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
            alive = alive[ok]
            out[alive] = q
        return out


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def build_filter(docs: DataFrame) -> tuple[DataFrame, int]:
    """((segment, n_tokens, n_words, data, words, word_counts), number of segments) for
    the words and pairs of docs(text): the filter's bytes, and the hashes and exact
    counts of the segment's words."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text") + 6).alias("b")).first()["b"] or 0
    segments = max(1, -(-size // SEGMENT_BYTES))

    def deal(batches):
        for batch in batches:
            hashes, places, sizes = tokens(batch.column(0).to_pylist())
            if not len(sizes):
                continue
            keys, n = np.unique(pair_keys(histories(hashes, places, sizes), hashes[places]), return_counts=True)
            keys, n = np.r_[keys, word_keys(np.array([_START]))], np.r_[n, len(sizes)]
            seg = segment_of(keys, segments)
            order = np.argsort(seg, kind="stable")
            keys, n, seg = keys[order], n[order], seg[order]
            own, counts = segment_of(word_keys(hashes), segments), np.bincount(places, minlength=len(hashes)).astype("<u4")
            order = np.argsort(own, kind="stable")
            words, counts, own = hashes[order], counts[order], own[order]
            for s in np.union1d(seg, own):
                a, b = np.searchsorted(seg, [s, s + np.uint64(1)])
                c, d = np.searchsorted(own, [s, s + np.uint64(1)])
                k, m = keys[a:b], n[a:b]
                once = m == 1
                cells = [_pack(k[once]), _pack(k[~once]), m[~once].astype("<u4").tobytes(), words[c:d].astype("<u8").tobytes(), counts[c:d].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], _DEALT)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        words, word_counts = _sum(read("words", "<u8").astype(np.uint64), read("word_counts", "<u4"))
        once, more = _unpack(b"".join(pdf["once"])), _unpack(b"".join(pdf["more"]))
        keys, counts = _sum(
            np.concatenate((once, more, word_keys(words) & _KEY)), np.concatenate((np.ones(len(once), np.int64), read("counts", "<u4"), word_counts))
        )
        return pd.DataFrame(
            {
                "segment": [pdf["segment"].iloc[0]], "n_tokens": [int(word_counts.sum())], "n_words": [len(words)],
                "data": [fill(keys, counts).tobytes()], "words": [words.astype("<u8").tobytes()], "word_counts": [word_counts.astype("<i8").tobytes()],
            }
        )

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(deal, "segment int, once binary, more binary, counts binary, words binary, word_counts binary")
    filled = dealt.groupBy("segment").applyInPandas(gather, "segment int, n_tokens long, n_words long, data binary, words binary, word_counts binary")
    return stash(filled, "filter"), segments


_DEALT = ["segment", "once", "more", "counts", "words", "word_counts"]


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def word_counts(filled: DataFrame) -> DataFrame:
    """(h, c): the exact number of each word's occurrences, from build_filter's table."""

    def run(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<i8")), pa.array(np.frombuffer(c, "<i8"))], ["h", "c"])

    return filled.select("words", "word_counts").mapInArrow(run, "h long, c long")


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words with the highest counts, ``most`` of them at
    most: all that reach the lowest count for which that holds."""
    top = 1 << 20
    hist = counts.groupBy(F.least("c", F.lit(top)).alias("c")).count().filter("c > 1").orderBy(F.desc("c")).collect()
    least, n = None, 0
    for r in hist:  # a row for each count that occurs, 2^20 at most
        n += r["count"]
        if n > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.filter(F.col("c") >= least).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int64)[order]


def score_texts(
    docs: DataFrame, training: Column, prior: float = 100.0, frequent: int = 300_000, max_filter_bytes: int = 256 << 20
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of
    docs(doc_id, text), learning from the rows that meet ``training``. Repeated rows
    give repeated rows and count each; null texts count as empty; a null doc_id is a
    row like any other. Without training rows every count is 0."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    filled, segments = build_filter(docs.filter(training))
    counts = stash(word_counts(filled), "counts")
    total = filled.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
    n_train, base = total["n"] or 0, (total["n"] or 0) + (total["v"] or 0) + 1
    seen_h, seen_c = frequent_words(counts, frequent)
    table = spark.sparkContext.broadcast((seen_h, seen_c))
    sizes = {r["segment"]: r["n"] for r in filled.select("segment", F.octet_length("data").alias("n")).collect()}
    shards: list[list[int]] = [[]]
    held = 0
    for s in range(segments):
        if shards[-1] and held + sizes.get(s, 8) > max_filter_bytes:
            shards.append([])
            held = 0
        shards[-1].append(s)
        held += sizes.get(s, 8)

    def send(own: list[int]):
        got = {r["segment"]: bytes(r["data"]) for r in filled.filter(F.col("segment").between(own[0], own[-1])).select("segment", "data").toLocalIterator()}
        parts = [got.pop(s, bytes(8)) for s in own]
        return spark.sparkContext.broadcast((segments, own[0], [len(p) for p in parts], b"".join(parts)))

    rows = docs.withColumn("levels", F.lit(None).cast("binary"))
    for own in shards[:-1]:
        sent = send(own)
        rows = stash(rows.mapInArrow(_pass(sent), "doc_id long, text string, levels binary"), "levels")
        sent.destroy()  # the levels are written: nothing reads this shard again
    marked = stash(rows.mapInArrow(_last(send(shards[-1]), table, base, prior), _MARKED), "scored")

    known = marked.filter("h is null").drop("h", "n")
    rare = marked.filter("h is not null").select("row", "h", "n").join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(base)))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    return known.join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


_MARKED = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, h long, n long"


def _slices(texts: list[str | None]):
    """Ranges of texts of about SLICE_CHARS characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > SLICE_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _probe(shard: Shard, texts: list, levels: list) -> tuple:
    """Tokens of texts and their levels: of the token, its history and the pair."""
    hashes, places, sizes = tokens(texts)
    here = hashes[places]
    before = histories(hashes, places, sizes)
    if levels[0] is None:
        word, word_known, pair_known = shard.levels(word_keys(hashes))[places], None, None
        start_known = None
    else:
        word_known, past_known, pair_known = (np.frombuffer(b"".join(levels), np.uint8).reshape(-1, 3)[:, i] for i in range(3))
        word, start_known = shard.levels(word_keys(here), word_known), past_known[:1]
    # a token's history is the token before it, or the start
    past = np.r_[np.zeros(1, np.uint8), word[:-1]]
    past[np.cumsum(sizes) - sizes] = shard.levels(word_keys(before[:1]), start_known)[0]
    return hashes, places, sizes, word, past, shard.levels(pair_keys(before, here), pair_known)


def _pass(sent):
    def run(batches):
        shard = Shard(*sent.value)
        for batch in batches:
            texts, levels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in _slices(texts):
                _, _, sizes, *found = _probe(shard, texts[part], levels[part])
                raw, stop = np.stack(found, 1), np.cumsum(sizes)
                packed = [raw[a:b].tobytes() for a, b in zip(stop - sizes, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], batch.column(1)[part.start : part.stop], pa.array(packed, pa.binary())], ["doc_id", "text", "levels"])

    return run


def _cut(batches):
    for batch in batches:
        texts, levels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for part in _slices(texts):
            yield batch.column(0)[part.start : part.stop], texts[part], levels[part]


def _last(sent, table, base: int, prior: float):
    def run(batches):
        shard = Shard(*sent.value)
        seen_h, seen_c = table.value
        # rows are numbered within their partition, which a repeated task reads in the same order
        row = TaskContext.get().partitionId() << 40
        for ids, texts, levels in _cut(batches):
            hashes, places, sizes, word, past, pair = _probe(shard, texts, levels)
            starts = np.cumsum(sizes) - sizes
            unigram = (count_of(word) + 1) / base
            # a false hit of the pair alone may not pass its history: p stays below 1
            pair = np.minimum(pair, past)
            logs = np.log10((count_of(pair) + prior * unigram) / (count_of(past) + prior))
            score = np.add.reduceat(logs, starts)
            at = np.searchsorted(seen_h, hashes)
            hit = np.zeros(len(hashes), bool)
            inside = at < len(seen_h)
            hit[inside] = seen_h[at[inside]] == hashes[inside]
            exact = np.zeros(len(hashes), np.int64)
            exact[hit] = seen_c[at[hit]]
            token_hit = hit[places]
            part = np.where(token_hit, np.log10((exact[places] + 1) / base), 0.0)
            rows = row + np.arange(len(sizes))
            row += len(sizes)
            n_rows = len(sizes)
            null = pa.nulls(n_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), ids, pa.array(sizes), pa.array(np.add.reduceat(token_hit.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(part, starts)), pa.array(score), null, null,
                ],
                _NAMES,
            )
            # what the broadcast table doesn't have: one row for each text and word
            rest = np.flatnonzero(~token_hit)
            owner = np.repeat(np.arange(n_rows), sizes)[rest]
            both, n = np.unique(owner * len(hashes) + places[rest], return_counts=True)
            m = len(both)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[both // len(hashes)]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(hashes[both % len(hashes)].view(np.int64)), pa.array(n.astype(np.int64)),
                ],
                _NAMES,
            )

    return run


_NAMES = [x.split()[0] for x in _MARKED.split(", ")]


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, ~held_out(7, 2)).select(
        "doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op8_lm_scores": op8_lm_scores}
#: SQL has no filter of this kind: tested against exact counts.
ORACLE_SQL: dict[str, str] = {}
