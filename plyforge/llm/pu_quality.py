"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled text are used for the fit. A first network
told to separate positives from unlabelled rows gives the class prior (the best
bin of its held-back scores, Garg et al., 2021); a second one minimises the
non-negative unbiased risk (Kiryo et al., 2017) at that prior. The fit reads a
sample of at most ``max_positive`` and ``max_unlabelled`` rows, chosen by a hash
of doc_id; every row is scored, over its whole text, in one pass without shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: ASCII marks that get a share of their own.
MARKS = b"!#$%&*|.,;:?-_/=<>@()[]{}\"'`~^+\\"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_LETTER = re.compile(r"[^\W\d_]")
#: Shares of words that carry one of these marks outside full stops and commas.
_ODD = re.compile(r"[!#$%&*|<>{}\[\]=@~^\\]")


def features(text: str | None) -> np.ndarray:
    """Bounded numbers of one whole text; a null text counts as an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n if raw else np.zeros(256)
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = text.split("\n")
    odd = repeated = upper = bare = 0
    for w, k in seen.items():
        if _ODD.search(w):
            odd += k
        if len(w) > 1 and w.isupper():
            upper += k
        if not _LETTER.search(w):
            bare += k
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    line_words = [len(x) for x in lines]
    out = [
        *np.sqrt(counts[list(MARKS)]),
        counts[list(_UPPER)].sum(),
        counts[list(_LOWER)].sum(),
        np.sqrt(counts[list(_DIGITS)].sum()),
        counts[list(_SPACE)].sum(),
        counts[128:].sum(),
        counts[:9].sum() + counts[14:32].sum(),
        odd / m,
        upper / m,
        bare / m,
        repeated / m,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        min(2.0, sum(map(len, words)) / m / 10),
        len(set(lines)) / len(lines),
        min(2.0, len(lines) / m),
        min(2.0, float(np.median(line_words)) / 400),
        np.log1p(len(words)) / 12,
        float(not words),
    ]
    return np.array(out, dtype=np.float32)


WIDTH = len(features("a"))


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, hidden: int, seed: int) -> list:
    """Adam over full batches. prior None: plain separation of pos from unl;
    else the non-negative risk: prior * l(pos) + max(0, l'(unl) - prior * l'(pos))."""
    rng = np.random.default_rng(seed)
    width = pos.shape[1]
    w = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def grads(x, dz, h):
        dh = np.outer(dz, w[2]) * (1 - h**2)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    for t in range(1, steps + 1):
        hp, hu = np.tanh(pos @ w[0] + w[1]), np.tanh(unl @ w[0] + w[1])
        sp = 1 / (1 + np.exp(-np.clip(hp @ w[2] + w[3], -40, 40)))
        su = 1 / (1 + np.exp(-np.clip(hu @ w[2] + w[3], -40, 40)))
        share_p, share_u = 1 / len(pos), 1 / len(unl)
        if prior is None:
            dp, du = (sp - 1) * share_p, su * share_u
        else:
            # logistic loss: l(+) has slope sp - 1 and l(-) slope sp
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            if negative >= 0:
                dp, du = prior * ((sp - 1) - sp) * share_p, su * share_u
            else:  # the bracket went below zero: step back up along it
                dp, du = prior * sp * share_p, -su * share_u
        g = [a + b for a, b in zip(grads(pos, dp, hp), grads(unl, du, hu), strict=True)]
        for i, a in enumerate(g):
            a = a + (1e-4 + 1 / (len(pos) + len(unl))) * w[i]
            first[i] = 0.9 * first[i] + 0.1 * a
            second[i] = 0.999 * second[i] + 0.001 * a * a
            w[i] = w[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos_scores: np.ndarray, unl_scores: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled rows, by the best bin: over all
    thresholds, the least upper bound of P(unl >= t) / P(pos >= t)."""
    cuts = np.unique(np.r_[pos_scores, unl_scores])
    n_p, n_u = len(pos_scores), len(unl_scores)
    q_p = 1 - np.searchsorted(np.sort(pos_scores), cuts, "left") / n_p
    q_u = 1 - np.searchsorted(np.sort(unl_scores), cuts, "left") / n_u
    ok = q_p > 0.02
    slack = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    bound = np.where(ok, q_u / np.maximum(q_p, 1e-9) + (1 + gamma) * slack / np.maximum(q_p, 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def fit_network(pos: np.ndarray, unl: np.ndarray, hidden: int = 24, seed: int = 7) -> Network | None:
    """The network for feature rows of positives and unlabelled texts; None if
    either is missing."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    pos, unl = pos.astype(np.float64), unl.astype(np.float64)
    mean, scale = unl.mean(0), unl.std(0) + 0.01
    p, u = np.clip((pos - mean) / scale, -8, 8), np.clip((unl - mean) / scale, -8, 8)
    w = _train(p[::2], u[::2], None, 150, hidden, seed)
    held = [np.tanh(x[1::2] @ w[0] + w[1]) @ w[2] + w[3] for x in (p, u)]
    prior = estimate_prior(*held)
    return Network(mean, scale, _train(p, u, prior, 400, hidden, seed + 1), prior)


def sample_share(n: int, most: int) -> float:
    return min(1.0, most / max(1, n))


def in_sample(key: Column, share: float, seed: int) -> Column:
    """True for a fixed share of keys, whatever their order or partition. The hash
    counts to 53 bits, so shares of 1e-12 and less still choose their rows."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(key, F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5 < share


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_positive: int = 6_000, max_unlabelled: int = 12_000
) -> Network | None:
    """Fits on rows of docs(doc_id, text): positives are rows that labels(doc_id,
    quality) mark 1 throughout, unlabelled rows are any. ``usable`` (over doc_id)
    says which rows may be learned from at all. The expected sizes of the samples
    are max_positive and max_unlabelled at most; ids without a row, null ids and
    null labels take no part. None: nothing to learn from. Drawing the sample runs jobs."""
    ship(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(usable)
    trusted = (
        labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(usable)
        .groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    )
    n_trusted, n_docs = trusted.count(), docs.select("doc_id").count()
    trusted = trusted.filter(in_sample(F.col("doc_id"), sample_share(n_trusted, max_positive), 11))
    chosen = docs.join(F.broadcast(trusted.withColumn("pos", F.lit(True))), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("pos", F.lit(False)).alias("pos"),
        in_sample(F.col("doc_id"), sample_share(n_docs, max_unlabelled), 12).alias("unl"),
    ).filter("pos or unl")

    def run(batches):
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "unl": pdf["unl"], "x": [r.tobytes() for r in rows]})

    got = chosen.mapInPandas(run, "doc_id long, pos boolean, unl boolean, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH)
    return fit_network(x[got["pos"].to_numpy(bool)], x[got["unl"].to_numpy(bool)])


def scorer(model: Network | None):
    """A column function text -> score in [0, 1] (1: good). Null texts score as
    empty ones. Without a model every score is 0.5."""

    ship()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.stack([features(t) for t in texts])))

    return score


def classify(docs: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """docs with quality_score, in place of a column of that name; one row per row,
    ties and repeats included, each scored over its whole text, however long."""
    return docs.withColumn("quality_score", scorer(model)(F.col(text).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, all columns unchanged. Every
    row is judged by its own whole text: rows without a doc_id, repeated rows and rows
    that share a doc_id alike; null texts count as empty. An empty table gives an empty
    one; without labels every row scores 0.5 and stays."""
    model = fit(docs, labels)
    return docs.filter(scorer(model)(docs["text"].cast("string")) >= threshold)


def held_out(divisor: int, rest: int) -> Column:
    """crc32 of doc_id as text leaves this rest; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out(3, 1))
    return docs.select(
        "doc_id", held_out(3, 1).alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
#: A trained model: tested by held-out accuracy, SQL can't express it.
ORACLE_SQL: dict[str, str] = {}
