"""Tables written to the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back: the files survive a lost executor, and their size is known to the planner,
which then chooses between broadcast and shuffle joins by a measured figure.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary
    folder serves a local master (tests); a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="plyforge-"))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in a folder of its own below the shared folder. The file system
    removes that folder when the driver's JVM ends, whether the session was stopped
    before or not."""
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return f"{folder}/data"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and returns it as read from there. The
    files go with unstash(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in turn on all cores, several parts for each, ahead of a step that costs far
    more than its rows weigh: the planner cuts and merges tasks by their bytes, and a
    few megabytes of positions would be worked out by a single one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def unstash(df: DataFrame) -> None:
    """Deletes the files of a stashed frame that no later plan reads."""
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


__all__ = ["delete", "fresh_path", "shared_dir", "spread", "stash", "unstash"]
