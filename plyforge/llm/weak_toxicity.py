"""Toxicity by weak supervision.

Many voters look at a text: one for each lexicon word, and one for each word
beginning ("pattern") that a bounded sample of labelled rows shows to go with
toxic texts. That, and the share of toxic rows, is all that hand labels are used
for: a generative label model (two classes, EM) estimates how sure each voter is
from the voters' votes alone; voters that agree beyond what the classes explain
share their weight, so a cluster of correlated voters speaks about once. Its
posteriors, never a label, are what a linear classifier over words and their
beginnings is trained on. Every row is then scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .pu_quality import held_out, in_sample, sample_share

# Insults of four languages, each a voter of its own.
LEXICON = (
    "idiot moron imbecile stupid dumb dumbass loser clown trash garbage scum filth worthless pathetic disgusting "
    "bastard bitch asshole jerk freak retard pig vermin shit fuck fucking crap hate kill "
    "idiota imbécil estúpido estúpida basura asqueroso asquerosa mierda puta cabrón gilipollas payaso inútil "
    "imbécile stupide crétin ordure salaud salope merde connard connasse minable dégoûtant débile "
    "dumm dummkopf arschloch scheiße abschaum müll verlierer wertlos erbärmlich widerlich trottel schwachkopf"
).split()
# Fixed values end.

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that patterns and features use.
BEGINNINGS = (4, 5, 6)
#: Length at which several words of one beginning count as a mark of their own.
STEM = 7


def marks(text: str | None) -> set[str]:
    """What voters and features see of a whole text: its words ("idiot$"), their
    beginnings, and beginnings that two or four distinct words share ("stem+2",
    "stem+4"), case folded, each once. Null counts as empty."""
    words = set(_WORD.findall((text or "").lower()))
    found = {w + "$" for w in words}
    for k in BEGINNINGS:
        found.update({w[:k] for w in words if len(w) >= k})
    for stem, n in Counter([w[:STEM] for w in words if len(w) >= STEM]).items():
        found.add(stem)
        if n > 1:
            found.add(stem + "+2")
            if n > 3:
                found.add(stem + "+4")
    return found


def mine_patterns(rows: list[np.ndarray], toxic: np.ndarray, names: list[str], most: int = 200) -> list[int]:
    """Marks (positions in names) that cover toxic rows and hardly any others:
    greedily the one that covers most rows not covered thrice yet. Ties go to the
    shorter, then to the first in order."""
    n_t, n_c = int(toxic.sum()), int((~toxic).sum())
    if n_t < 5 or n_c < 5:
        return []
    bad = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t]), minlength=len(names))
    good = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if not t]), minlength=len(names))
    pure = (bad >= max(3, 0.002 * n_t)) & (good / n_c <= 0.02 * bad / n_t)
    holders: dict[int, list[int]] = {}
    for i, r in enumerate(r for r, t in zip(rows, toxic, strict=True) if t):
        for m in r[pure[r]]:
            holders.setdefault(int(m), []).append(i)
    need = np.full(n_t, 3)
    gain = {m: len(v) for m, v in holders.items()}
    chosen: list[int] = []
    while gain and len(chosen) < most:
        m = min(gain, key=lambda x: (-gain[x], len(names[x]), names[x]))
        now = int((need[holders[m]] > 0).sum())
        if now < gain[m]:  # counts only fall: look again at the new figure
            gain[m] = now
            if now:
                continue
        del gain[m]
        if now:
            chosen.append(m)
            need[holders[m]] -= 1
    return chosen


def _at_mean(logit: np.ndarray, mean: float) -> np.ndarray:
    """Probabilities of logits, moved together so that their mean is as given."""
    low, high = -60.0, 60.0
    for _ in range(50):
        middle = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(logit + middle, -40, 40)))
        low, high = (middle, high) if p.mean() < mean else (low, middle)
    return p


def label_model(votes: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for a two-class model of voters that say "toxic" or nothing. Returns the
    posteriors of class 1 and each voter's log ratio for a vote. No label goes in:
    rows with votes start as likely toxic, and rates and posteriors follow in turn.

    What one voter leaves unsaid is no evidence, for insults stand for each other;
    that no voter speaks is a vote of its own. Correlations: the ratio of a voter is
    divided by the summed squares of its correlations within the classes with all
    voters, itself included; they are estimated again in each round. The mean of the
    posteriors is held to the prior."""
    n, k = votes.shape
    # voters that never speak would only seem to agree with each other
    heard = np.flatnonzero(votes.any(0))
    v = votes[:, heard].astype(np.float64)
    quiet = ~votes.any(1)
    p = np.where(quiet, 0.02, 0.9)
    weights = np.zeros(len(heard))
    for _ in range(rounds):
        a, b = p.sum(), (1 - p).sum()
        # what smoothing there is leans towards voters that are right
        hit1, hit0 = (v.T @ p + 0.1) / (a + 0.2), (v.T @ (1 - p) + 0.01) / (b + 1)
        silent = np.log((p[quiet].sum() + 0.01) / (a + 1)) - np.log(((1 - p)[quiet].sum() + 0.1) / (b + 0.2))
        left = v - np.outer(p, hit1) - np.outer(1 - p, hit0)
        spread = np.sqrt((left**2).mean(0)) + 1e-9
        strength = np.abs(left.T @ left / n / np.outer(spread, spread))
        strength[strength < 0.1] = 0
        np.fill_diagonal(strength, 1)
        weights = np.log(hit1 / hit0) / (strength**2).sum(1)
        new = _at_mean(v @ weights + quiet * silent, prior)
        moved = np.abs(new - p).max(initial=0)
        p = new
        if moved < 1e-6:
            break
    out = np.zeros(k)
    out[heard] = weights
    return p, out


@dataclass
class Linear:
    """Weights of marks; a mark that is not listed weighs nothing."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        z = self.bias
        if self.weights:
            z += sum(self.weights[m] for m in sorted(marks(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train_linear(rows: list[np.ndarray], target: np.ndarray, names: list[str], steps: int = 1500) -> Linear:
    """Logistic regression on the marks that the targets explain well, voters or
    not, by Adam over the whole sample, with L2. Weights stay at zero or above:
    what a long text says besides can't outweigh an insult in it."""
    n = len(rows)
    base = float(np.clip(target.mean(), 0.005, 0.995))
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    col = np.concatenate(rows)
    have = np.bincount(col, minlength=len(names)).astype(float)
    bad = np.bincount(col, weights=target[row], minlength=len(names))
    z = np.where(have >= 4, (bad - have * base) / np.sqrt(np.maximum(have, 1) * base * (1 - base)), 0)
    # marks that speak for toxicity: the rest of a long text then weighs nothing
    z[bad < 0.3 * have] = 0
    top = np.flatnonzero(z > 4)
    place = np.full(len(names), -1)
    place[top] = np.arange(len(top))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    w, b = np.zeros(len(top)), 0.0
    # toxic rows are few: both classes weigh alike, so one sure mark is enough
    even = np.where(target > 0.5, 0.5 / base, 0.5 / (1 - base)) / n
    m1, m2 = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for t in range(1, steps + 1):
        logit = b + np.bincount(row, weights=w[col], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target) * even
        g = np.r_[np.bincount(col, weights=err[row], minlength=len(top)) + 3e-6 * w, err.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return Linear(float(b), {names[i]: float(x) for i, x in zip(top, w, strict=True) if x})


def weak_labels(texts: list[str], label: np.ndarray) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The names of marks, those of each text, and the label model's posteriors.
    label: 1, 0 or -1 (unlabelled) per text; it picks patterns and the prior."""
    known = label >= 0
    # only marks of several toxic rows can become voters or features
    often: Counter = Counter()
    for t, y in zip(texts, label, strict=True):
        if y == 1:
            often.update(marks(t))
    names = list(dict.fromkeys([*(w + "$" for w in LEXICON), *sorted(m for m, k in often.items() if k >= 3)]))
    place = {m: i for i, m in enumerate(names)}
    del often
    rows = [np.array(sorted(place[m] for m in marks(t) & place.keys()), dtype=np.int32) for t in texts]
    prior = float(np.clip(label[known].mean(), 0.01, 0.9))
    seen = [r for r, k in zip(rows, known, strict=True) if k]
    voters = np.array(list(dict.fromkeys([*range(len(LEXICON)), *mine_patterns(seen, label[known] == 1, names)])))
    slot = np.full(len(names), -1)
    slot[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters)), dtype=np.int8)
    for i, r in enumerate(rows):
        votes[i, slot[r][slot[r] >= 0]] = 1
    return names, rows, label_model(votes, prior)[0]


def fit_texts(texts: list[str], label: np.ndarray) -> Linear:
    """label: 1, 0 or -1 (unlabelled) per text."""
    if not len(texts) or not (label >= 0).any():
        return Linear(float(np.log(0.1 / 0.9)))
    names, rows, posterior = weak_labels(texts, label)
    return train_linear(rows, posterior, names)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_labelled: int = 8_000, max_unlabelled: int = 4_000
) -> Linear:
    """Fits on bounded samples (expected sizes as given, chosen by a hash of
    doc_id) of rows that labels(doc_id, toxic) mark and of rows without a label.
    Rows marked both ways count as toxic; null ids and labels take no part. With
    nothing to learn from, every text scores 0.1. Drawing the sample runs jobs."""
    ship(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(usable)
    marked = (
        labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(usable)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n_marked, n_docs = marked.count(), docs.select("doc_id").count()
    marked = marked.filter(in_sample(F.col("doc_id"), sample_share(n_marked, max_labelled), 21))
    got = (
        docs.join(F.broadcast(marked), "doc_id", "left")
        .filter(F.col("toxic").isNotNull() | in_sample(F.col("doc_id"), sample_share(n_docs, max_unlabelled), 22))
        .select("doc_id", F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"), "text")
    )

    def run(batches):
        # only what training reads of a text goes to the driver: its distinct words
        for pdf in batches:
            words = [" ".join(sorted(set(_WORD.findall((t or "").lower())))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": words})

    sample = got.mapInPandas(run, "doc_id long, toxic int, words string").toPandas().sort_values(["doc_id", "words"])
    return fit_texts(list(sample["words"]), sample["toxic"].to_numpy(np.int64))


def scorer(model: Linear):
    """A column function text -> score in [0, 1] (1: toxic). Null counts as empty."""

    ship()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below ``threshold``, all columns unchanged. Every
    row is judged by its own whole text, however long: rows without a doc_id, repeated
    rows and rows that share a doc_id alike; null texts count as empty and stay. An
    empty table gives an empty one; without labels every row stays."""
    model = fit(docs, labels)
    return docs.filter(scorer(model)(docs["text"].cast("string")) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out(5, 0))
    return docs.select(
        "doc_id", held_out(5, 0).alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
#: A trained model: tested by held-out accuracy, SQL can't express it.
ORACLE_SQL: dict[str, str] = {}
