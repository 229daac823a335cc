"""Files of the evaluation: benchmark splits, prompts, predictions, rated positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import assert_unique
from .readers import CORRUPT, is_json, read_jsonl

EXAMPLE = T.StructType([
    T.StructField("example_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("task_type", T.StringType()), T.StructField("fen", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("gold_answer", T.StringType()), T.StructField("metric_type", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
PREDICTION = T.StructType([
    T.StructField("example_id", T.StringType()), T.StructField("sample_index", T.IntegerType()), T.StructField("prediction", T.StringType()), T.StructField("raw_prediction", T.StringType()),
])
_RATING = T.StructType([T.StructField(n, t) for n, t in (("uci", T.StringType()), ("move", T.StringType()), ("cp", T.IntegerType()), ("centipawn", T.IntegerType()), ("mate", T.IntegerType()), ("pv_line", T.StringType()))])
RATED = T.StructType([T.StructField("fen", T.StringType()), T.StructField("candidate_ratings", T.ArrayType(_RATING))])


def read_benchmark(spark: SparkSession, path: str | list[str], task_types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Examples of benchmark files (a folder's are path/*.jsonl), of the named tasks only;
    with ``most`` the first by id. Lines that aren't JSON raise when they are read."""
    rows = read_jsonl(spark, path, EXAMPLE)
    fine = F.when(is_json(rows), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a benchmark row: "), F.col(CORRUPT))).cast("boolean"))
    rows = rows.filter(fine).drop(CORRUPT)
    if task_types is not None:
        rows = rows.filter(F.col("task_type").isin(*task_types) if task_types else F.lit(False))
    return rows if most is None else rows.orderBy("example_id").limit(max(0, most))


def read_benchmark_dir(spark: SparkSession, root: str, splits: list[str] | None = None) -> DataFrame:
    """All examples of a frozen benchmark's folder, of the named splits only."""
    rows = read_benchmark(spark, f"{root.rstrip('/')}/*.jsonl")
    return rows if splits is None else rows.filter(F.col("split").isin(*splits))


def write_benchmark(examples: DataFrame, root: str) -> dict[str, int]:
    """One JSON-lines folder for each split; returns their counts."""
    examples.write.mode("overwrite").partitionBy("split").json(root)
    return {r["split"]: r["count"] for r in examples.groupBy("split").count().collect()}  # splits are few


def prompts(examples: DataFrame) -> DataFrame:
    """(prompt_id, messages, fen, task_type, metadata) of examples; a repeated id raises,
    and so does, when it is read, a row without id or prompt."""
    needed = F.when(F.col("example_id").isNotNull() & F.col("prompt").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a benchmark row lacks example_id or prompt")).cast("boolean"))
    own = assert_unique(examples.filter(needed), ["example_id"])
    metadata = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(
        F.lit("benchmark.split"), F.col("split"), F.lit("benchmark.task_type"), F.col("task_type"), F.lit("benchmark.gold_answer"), F.col("gold_answer"), F.lit("benchmark.metric_type"), F.col("metric_type"),
    ))
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return own.select(F.col("example_id").alias("prompt_id"), message.alias("messages"), "fen", "task_type", metadata.alias("metadata"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, with the raw text where a row has none of its own."""
    rows = read_jsonl(spark, path, PREDICTION)
    rows = rows.filter(is_json(rows)).drop(CORRUPT)
    return rows.withColumn("raw_prediction", F.coalesce("raw_prediction", "prediction")).withColumn("sample_index", F.coalesce("sample_index", F.lit(0)))


def write_predictions(scored: DataFrame, path: str) -> None:
    """Scored predictions as JSON lines in order of example and sample; a raw text that
    says no more than the prediction is left out."""
    raw = F.when(F.col("raw_prediction") != F.col("prediction"), F.col("raw_prediction"))
    scored.withColumn("raw_prediction", raw).repartitionByRange("example_id").sortWithinPartitions("example_id", "sample_index").write.mode("overwrite").json(path)


def merged_predictions(greedy: DataFrame, sampled: DataFrame) -> DataFrame:
    """Greedy predictions and sampled ones behind them, numbered anew for each example."""
    after = greedy.groupBy("example_id").agg((F.max("sample_index") + 1).alias("_n"))
    moved = sampled.join(after, "example_id", "left").withColumn("sample_index", (F.col("sample_index") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return greedy.unionByName(moved.select(*greedy.columns))


def first_predictions(predictions: DataFrame) -> DataFrame:
    """Each example's first prediction."""
    return predictions.groupBy("example_id").agg(F.min_by(F.struct("prediction", "raw_prediction"), "sample_index").alias("p")).select("example_id", "p.prediction", "p.raw_prediction")


def read_rated(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a position and rated moves; others are left out."""
    rows = read_jsonl(spark, path, RATED)
    return rows.filter(is_json(rows) & (F.coalesce("fen", F.lit("")) != "") & F.col("candidate_ratings").isNotNull()).drop(CORRUPT)
