"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them
in turn, writing each result as Parquet in the shared folder and reading it back.
All stages but the last return rows of ``documents`` with their columns unchanged,
columns of other names and types included. In every stage an empty table gives an
empty one, null texts count as empty, and texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyforge.llm import decontaminate_simhash, pu_quality, sentencepiece_nbest, simhash_trie, weak_toxicity
from plyforge.llm.store import stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good. Each row is judged by its
    own text, rows without a doc_id and repeated rows alike; equal texts get equal
    verdicts, a score of exactly 0.5 stays. Without labels every row stays."""
    return pu_quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't taken for toxic, each row judged by its own text. Empty
    texts stay; a score of exactly 0.5 goes. Without labels every row stays."""
    return weak_toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each near-duplicate group. Rows without a
    doc_id stay; rows that share a doc_id stay or go together. Texts without a word
    are copies of one another: the smallest doc_id of them stays."""
    return simhash_trie.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Rows without a doc_id stay;
    rows that share one go together if any of them holds a passage. Null and empty
    benchmark items have no passage; an empty benchmark lets every row stay."""
    return decontaminate_simhash.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest of each document's best segmentations, decoded and compared: one row per
    row, repeated rows and rows without a doc_id included; empty texts have no piece."""
    return sentencepiece_nbest.digest(docs, sentencepiece_nbest.model_path())


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_nbest", encoding),
]

#: Trained models and fingerprints: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
