"""Sinks: validated JSON lines, splits with their block list, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..store import stash


def write_validated(df: DataFrame, errors: str, path: str, rejected_path: str | None = None) -> dict:
    """Writes rows without errors as JSON lines; returns the counts, observed in the
    same pass. Rejected rows go to a folder of their own if one is named; the rows are
    then stored in between, so they are made once."""
    seen = Observation()
    if rejected_path:
        df = stash(df, "checked")
    bad = F.size(F.col(errors)) > 0
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected")).filter(~bad).drop(errors).write.mode("overwrite").json(path)
    if rejected_path:
        df.filter(bad).write.mode("overwrite").json(rejected_path)
    return dict(seen.get)


def write_splits(df: DataFrame, path: str, split: str, key: str) -> None:
    """One folder per split and the sorted, distinct keys of all of them."""
    df.write.mode("overwrite").partitionBy(split).json(f"{path}/splits")
    df.select(F.col(key).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").write.mode("overwrite").text(f"{path}/blocklist")


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def file_stats(df: DataFrame) -> DataFrame:
    """Rows of each file that df was read from."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
