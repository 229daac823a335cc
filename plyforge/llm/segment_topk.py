"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into equal segments; for each, its mean and standard deviation
bound any inner product: over a segment of l components, sum(q * c) is at most
l * (mq * mc + sq * sc), which is the lower bound l * ((mq - mc)^2 + (sq - sc)^2)
on the squared distance, written for inner products (what the means leave is
bounded by Cauchy-Schwarz). Levels have 4, 8, 16, ... segments of two components
at least; their segments are nested, so a finer level only tightens the bound.
Candidates are taken coarse to fine: a pair whose bound is below the query's k-th
best score so far is dropped. Of the pairs that are left, each query's best-bounded
are scored first, which raises its k-th best score, and only then the survivors of
that; no other pair is multiplied.

Queries and candidates are packed into blocks of bounded size. Each candidate
block goes once to every query block (all pairs of blocks, in blocks: the search
is exact for a stated query set), dealt to several tasks per query block; a
task holds one query block, one candidate block and k results per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .store import stash

SCALE = 64
_LONG = (1 << 63) - 1
#: Sums below these are exact in floating point of 24 and 53 bits.
_SINGLE, _EXACT = 2.0**24, 2.0**52
#: Queries and candidates that are compared at a time within their blocks.
_ROWS, _COLUMNS = 512, 4096
#: A level that drops less than this share of a chunk is left out of the next ones.
_USEFUL, _AGAIN = 0.05, 16
#: Segments of the finest level, at most.
_FINEST = 64


def quantise(vector: np.ndarray) -> np.ndarray:
    """floor(64 * x) of every component, x as double."""
    return np.floor(SCALE * vector.astype(np.float64))


def level_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are upper bounds of those of x's rows: scaled
    means and deviations of each segment. Sizes differ by one at most."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def levels_of(dim: int) -> list[int]:
    """Segments of each level: 4, 8, 16, ... of two components at least."""
    return [n for n in (4 << i for i in range(16)) if n <= min(_FINEST, max(4, dim // 2))]


class Block:
    """Ids and quantised vectors, with the features of every level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.size = float(np.abs(x).max(initial=0))
        self.levels = [level_features(x, s) for s in levels_of(x.shape[1])]

    def single(self) -> None:
        """Goes over to single precision, in which small integers are as exact."""
        self.x, self.levels = self.x.astype(np.float32), [f.astype(np.float32) for f in self.levels]


class Best:
    """The k best (score, id) of each query so far: higher scores, then smaller
    ids. Scores are 64-bit integers; ``real`` says which places are taken."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -_LONG - 1, dtype=np.int64)
        self.ids = np.full((n, k), _LONG, dtype=np.int64)
        self.real = np.zeros((n, k), dtype=bool)
        #: What the k-th best score reaches at least, known beforehand.
        self.least = np.full(n, -np.inf)
        #: By level: chunks to pass before it is tried again.
        self.idle: dict[int, int] = {}

    def floor(self, rows: np.ndarray) -> np.ndarray:
        """What the k-th best score reaches at least, as a float that may be off by
        some 2^-53 of itself."""
        return np.maximum(self.least[rows], np.where(self.real[rows, -1], self.scores[rows, -1].astype(np.float64), -np.inf))

    def look_within(self, queries: Block) -> None:
        """First floors: queries are rows of the table too, so a query's k-th best
        score among them is reached. Ids are distinct; large numbers are left out."""
        n = len(queries.ids)
        largest = queries.size * queries.size * max(1, queries.x.shape[1])
        if n <= self.k or largest >= _EXACT:
            return
        x = queries.x.astype(np.float32) if largest < _SINGLE else queries.x
        for a in range(0, n, _ROWS):
            scores = x[a : a + _ROWS] @ x.T
            scores[np.arange(len(scores)), a + np.arange(len(scores))] = -np.inf
            self.least[a : a + _ROWS] = np.partition(scores, n - self.k, axis=1)[:, n - self.k]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        """Matrices of candidates for distinct rows; those that aren't real don't count."""
        s = np.concatenate((self.scores[rows], scores), axis=1)
        i = np.concatenate((self.ids[rows], ids), axis=1)
        r = np.concatenate((self.real[rows], real), axis=1)
        # ~s falls as s rises, without the overflow of -s
        order = np.lexsort((i, ~s, ~r), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows], self.real[rows] = (np.take_along_axis(x, order, 1) for x in (s, i, r))


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    """The inner products q[i] * c[j], i in order, as 64-bit integers: by floating
    point where that is exact, else by integers of any size, held to 64 bits."""
    if not exact:
        whole = {(side, n): [int(v) for v in x[n]] for side, x, ns in ((0, q, i), (1, c, j)) for n in np.unique(ns)}
        sums = (sum(x * y for x, y in zip(whole[0, a], whole[1, b], strict=True)) for a, b in zip(i, j, strict=True))
        return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], dtype=np.int64)
    out = np.zeros(len(i), np.int64)
    stop = np.searchsorted(i, np.arange(len(q) + 1))
    for n in np.flatnonzero(np.diff(stop)):
        part = slice(stop[n], stop[n + 1])
        out[part] = c[j[part]] @ q[n]
    return out


def search(queries: Block, cands: Block, best: Best) -> tuple[int, int]:
    """Offers each query its candidates of other ids; (pairs seen, pairs multiplied)."""
    seen = multiplied = 0
    dim = max(1, queries.x.shape[1])
    largest = queries.size * cands.size * dim
    if largest < _SINGLE:
        for block in (queries, cands):
            block.single()
    exact = largest < _EXACT
    # a little room for rounding keeps ties alive
    slack = (1e-5 if largest < _SINGLE else 1e-6) * (1 + largest)
    for a in range(0, len(queries.ids), _ROWS):
        rows = np.arange(a, min(a + _ROWS, len(queries.ids)))
        q = queries.x[rows]
        for b in range(0, len(cands.ids), _COLUMNS):
            c, ids = cands.x[b : b + _COLUMNS], cands.ids[b : b + _COLUMNS]
            alive = queries.ids[rows, None] != ids[None, :]
            seen += alive.size
            bound = _coarse_to_fine(queries, cands, best, rows, slice(b, b + _COLUMNS), alive, slack)
            # first the best-bounded pairs of each query, then what their scores leave
            if bound is not None and len(ids) > 2 * best.k:
                bound[~alive] = -np.inf
                top = np.argpartition(bound, len(ids) - best.k, axis=1)[:, len(ids) - best.k :]
                real = np.take_along_axis(alive, top, 1)
                i, n = np.nonzero(real)
                scores = np.zeros(top.shape, np.int64)
                scores[i, n] = products(q, c, i, top[i, n], exact)
                best.offer(rows, scores, ids[top], real)
                multiplied += len(i)
                alive[i, top[i, n]] = False
                alive &= ~(bound < best.floor(rows)[:, None] - slack)
            i, j = np.nonzero(alive)
            multiplied += len(i)
            if len(i):
                _offer_pairs(best, rows, i, ids[j], products(q, c, i, j, exact))
    return seen, multiplied


def _coarse_to_fine(queries: Block, cands: Block, best: Best, rows: np.ndarray, cols: slice, alive: np.ndarray, slack: float) -> np.ndarray | None:
    """Clears the pairs of ``alive`` whose bound is below the query's floor and gives
    the finest bounds there are; None if no pair is left. Of the levels before the
    last, those that drop hardly any pair rest for some chunks."""
    floor = best.floor(rows)[:, None] - slack
    last = len(queries.levels) - 1
    bound = None
    for level, (fq, fc) in enumerate(zip(queries.levels, cands.levels, strict=True)):
        if level < last and best.idle.get(level, 0):
            best.idle[level] -= 1
            continue
        i, j = alive.any(1), alive.any(0)
        if not i.any():
            return None
        before = int(alive.sum())
        if i.all() and j.all():
            bound = fq[rows] @ fc[cols].T
            alive &= ~(bound < floor)
        else:
            part = np.ix_(np.flatnonzero(i), np.flatnonzero(j))
            if bound is None:
                bound = np.full(alive.shape, np.inf, fq.dtype)
            bound[part] = fq[rows[i]] @ fc[cols][j].T
            alive[part] &= ~(bound[part] < floor[i])
        if level < last and int(alive.sum()) > (1 - _USEFUL) * before:
            best.idle[level] = _AGAIN
    return bound if alive.any() else None


def _offer_pairs(best: Best, rows: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Offers pairs (rows[i], ids) with their scores: each row's k best of them."""
    good = scores.astype(np.float64) >= best.floor(rows)[i]
    i, ids, scores = i[good], ids[good], scores[good]
    if not len(i):
        return
    order = np.lexsort((ids, ~scores, i))
    i, ids, scores = i[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[first, len(i)])
    place = np.arange(len(i)) - np.repeat(first, size)
    of = np.repeat(np.arange(len(first)), size)
    kept = place < best.k
    shape = (len(first), int(min(best.k, size.max())))
    s, n, r = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    s[of[kept], place[kept]], n[of[kept], place[kept]], r[of[kept], place[kept]] = scores[kept], ids[kept], True
    best.offer(rows[i[first]], s, n, r)


_PACKED = "dim int, block long, ids binary, x binary"


def pack_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, block, ids, x): the usable rows of vectors(vec_id, embedding) in blocks
    of at most ``rows`` rows of one length, quantised. Null ids and vectors, and
    vectors with null or non-finite components, are left out."""
    ship(vectors.sparkSession)

    def run(batches):
        held: dict[int, list] = {}
        made = 0

        def close(dim):
            nonlocal made
            ids, x = zip(*held.pop(dim), strict=True)
            data = np.stack(x).reshape(len(ids), dim)
            made += 1
            # a block's name follows from its rows, so that a task run twice gives the same
            name = (int(ids[0]) * 1_000_003 + made) & 0x7FFFFFFFFFFF
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()), pa.array([name], pa.int64()),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([data.astype("<f8").tobytes()], pa.binary()),
                ],
                ["dim", "block", "ids", "x"],
            )

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values
                if key is None or values is None or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                held.setdefault(len(x), []).append((key, quantise(x)))
                if len(held[len(x)]) == rows:
                    yield close(len(x))
        for dim in list(held):
            yield close(dim)

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.filter("vec_id is not null and embedding is not null").mapInArrow(run, _PACKED)


def _open(dim: int, ids: bytes, x: bytes) -> Block:
    keys = np.frombuffer(ids, "<i8")
    return Block(keys, np.frombuffer(x, "<f8").reshape(len(keys), dim))


def _salts(parts: int, blocks: int, per_task: int = 64, least: int = 48, most: int = 20_000) -> int:
    """Tasks per query block: a task takes ``per_task`` candidate blocks or fewer
    where there are few query blocks; ``most`` tasks in all, however many there are."""
    return max(1, min(blocks, max(-(-blocks // per_task), least // parts), most // parts))


def topk(vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 8192, cand_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of vectors(vec_id, embedding)
    whose row meets is_query, its k best rows of the same length and another id by
    inner product of floor(64 * x); ties go to the smaller id. Fewer candidates:
    all. A query id that stands on several rows is searched once, by the row whose
    vector sorts first; as candidates every row counts, but no row of the query's
    own id. Vectors may have any length; a block holds cand_rows of them. Scores
    beyond 64 bits are held to them. An empty table gives no rows. Counting and
    packing the queries runs jobs while the plan is built."""
    ship(vectors.sparkSession)
    asked = (
        vectors.filter(is_query).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )
    asked = stash(asked, "queries")
    parts = max(1, -(-asked.count() // query_rows))
    queries = stash(pack_blocks(asked.repartition(parts), query_rows), "query-blocks")
    # names of blocks alone pass through the window, one row a block
    number = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1
    numbers = stash(queries.select("dim", "block").withColumn("qb", number.cast("int")), "numbers")
    queries = queries.join(numbers, ["dim", "block"])
    most = numbers.groupBy("dim").agg(F.max("qb").alias("last"))
    cands = pack_blocks(vectors, cand_rows).join(F.broadcast(most), "dim")  # a row for each length of vectors
    salts = _salts(parts, -(-vectors.count() // cand_rows))
    pairs = (
        queries.select("dim", "qb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "ids", "x")
        .unionByName(
            cands.select(
                "dim", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("qb"),
                F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "ids", "x",
            )
        )
    )

    def run(batches: Iterator[pa.RecordBatch]):
        at, queries_, best = None, None, None

        def results():
            i, j = np.nonzero(best.real)
            return pa.RecordBatch.from_arrays(
                [pa.array(queries_.ids[i]), pa.array(best.ids[i, j]), pa.array(best.scores[i, j])],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["dim"], r["qb"], r["salt"])
                if r["kind"] == 0:
                    if at is not None:
                        yield results()
                    at, queries_ = key, _open(r["dim"], r["ids"], r["x"])
                    best = Best(len(queries_.ids), k)
                    best.look_within(queries_)
                elif key == at:
                    search(queries_, _open(r["dim"], r["ids"], r["x"]), best)
        if at is not None:
            yield results()

    found = (
        pairs.repartition(max(1, parts * salts), "dim", "qb", "salt").sortWithinPartitions("dim", "qb", "salt", "kind")
        .mapInArrow(run, "query_id long, vec_id long, score long")
    )
    # k rows of each of a query's tasks; Spark keeps the k best of each partition first
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op10_exact_topk": op10_exact_topk}
ORACLE_SQL = {
    "op10_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""
}

__all__ = ["pack_blocks", "search", "topk"]
