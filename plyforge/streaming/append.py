"""A task's output that grows by rows it doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import hash_sample
from .keep_best import _fs, _versions

# How many candidates are asked for each row that is missing.
CANDIDATES_PER_MISSING = 4
# Fixed values end.


def candidate_budget(target: int, have: int, per_missing: int = CANDIDATES_PER_MISSING) -> int:
    """Candidates to ask a generator for: as many again as are there and wanted, or
    several for each missing row if that is more."""
    missing = max(0, target - have)
    return target if not missing else max(target + have, have + missing * per_missing)


def extend_output(spark: SparkSession, table: str, rows: DataFrame, identity: str, target: int, seed_order) -> dict[str, int]:
    """Brings the table below ``table`` to ``target`` rows with unseen rows, each
    identity once, the first by an order; returns the counts. A version is written whole
    beside the one before it, which stays until it is complete; a run that finds the
    target reached writes nothing. Raises, and leaves the table as it is, if rows lack
    an identity or the target can't be reached."""
    done = _versions(spark, table, "_SUCCESS")
    have = spark.read.schema(rows.schema).parquet(f"{table}/v{done[-1]}") if done else spark.createDataFrame([], rows.schema)
    n = have.count()
    if n >= target:
        return {"previous": n, "appended": 0, "final": n, "duplicates": 0}
    fresh = rows.join(have.select(identity).distinct(), identity, "left_anti").select(*rows.columns)
    once = fresh.groupBy(F.col(identity).alias("_id")).agg(F.min_by(F.struct(*rows.columns), seed_order).alias("_r")).select("_r.*")
    seen = rows.agg(F.count("*").alias("n"), F.count(identity).alias("named")).first()
    if seen["named"] < seen["n"]:
        raise ValueError(f"{seen['n'] - seen['named']} rows have no identity")
    more = hash_sample(once, seed_order, target - n)
    version = f"{table}/v{done[-1] + 1 if done else 1}"
    have.unionByName(more).write.mode("overwrite").parquet(version)
    final = spark.read.schema(rows.schema).parquet(version).count()
    if final < target:
        path, fs = _fs(spark, version)
        fs.delete(path, True)
        raise ValueError(f"underfilled: {final} of {target} rows")
    for old in done[:-1]:
        path, fs = _fs(spark, f"{table}/v{old}")
        fs.delete(path, True)
    return {"previous": n, "appended": final - n, "final": final, "duplicates": seen["n"] - once.count()}


def read_output(spark: SparkSession, table: str, schema) -> DataFrame:
    done = _versions(spark, table, "_SUCCESS")
    return spark.read.schema(schema).parquet(f"{table}/v{done[-1]}") if done else spark.createDataFrame([], schema)
