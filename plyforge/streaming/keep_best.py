"""A keep-best table that a stream of rows updates, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_best


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, table: str, mark: str = "manifest/_SUCCESS") -> list[int]:
    """The complete versions: those that have the file written last."""
    p, fs = _fs(spark, table)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(_fs(spark, f"{table}/{n}/{mark}")[0])]
    return sorted(done)


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """Which version holds each bucket, as a version's manifest says."""
    rows = spark.read.schema("bucket int, version int").parquet(f"{table}/v{version}/manifest").collect()  # a row a bucket
    return {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, table: str, schema, held: dict[int, int]) -> DataFrame:
    paths = [f"{table}/v{v}/data/_bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, table: str, schema) -> DataFrame:
    """The table's last complete version; empty before the first."""
    versions = _versions(spark, f"{table}")
    return _read(spark, table, schema, _manifest(spark, table, versions[-1]) if versions else {})


def run_keep_best(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list, keep_versions: int = 2, buckets: int = 64):
    """Drains a stream into the table and returns the finished query. Keys are dealt to
    ``buckets``; each batch writes, as version batch_id + 1, the buckets that it has rows
    for and a manifest of where all buckets are, so a batch touches what it changes. It
    builds on the version before it: a batch that is run again after a failure gives
    the same version."""
    schema = stream.schema
    columns = stream.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = [v for v in _versions(spark, table) if v <= batch_id]
        held = _manifest(spark, table, older[-1]) if older else {}
        rows = batch.select(*columns)
        touched = {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}  # ``buckets`` at most
        if touched:
            rows = _read(spark, table, schema, {b: v for b, v in held.items() if b in touched}).unionByName(rows)
            best = keep_best(rows, keys, order).select(*columns, bucket.alias("_bucket"))
            best.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/v{batch_id + 1}/data")
        held = {**held, **dict.fromkeys(touched, batch_id + 1)}
        # the manifest comes last: a version without it doesn't count
        spark.createDataFrame(sorted(held.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{table}/v{batch_id + 1}/manifest")
        kept = [*older, batch_id + 1][-keep_versions:]
        wanted = {v for k in kept for v in (k, *_manifest(spark, table, k).values())}
        for v in older:
            if v not in wanted:
                p, fs = _fs(spark, f"{table}/v{v}")
                fs.delete(p, True)

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
