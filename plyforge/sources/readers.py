"""Readers: JSON lines, ZIP members, opening books, block lists, tiers."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: Column that holds a line which isn't JSON.
CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON lines under a schema; a line that isn't JSON keeps its text in
    ``_corrupt``, blank lines are dropped."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def is_json(df: DataFrame) -> Column:
    """Whether a line was JSON. Another column is looked at too, as Spark refuses to
    read the column of corrupt lines alone, which a plain count would come to."""
    return F.col(CORRUPT).isNull() & (F.coalesce(F.length(F.col(df.columns[0]).cast("string")), F.lit(0)) >= 0)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(is_json(df)).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def first_present(df: DataFrame, *names: str) -> Column:
    """The first non-null of those alternative columns that df has."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_tier(spark: SparkSession, root: str, tier: int, schema: T.StructType) -> DataFrame:
    """All files of a tier with the file each row comes from; hidden ones aside."""
    return read_jsonl(spark, f"{root}/tier{tier}/*.jsonl", schema).withColumn("source_file", F.col("_metadata.file_path"))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("key")).filter("key <> ''").distinct()


def read_zip_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line_no, line) of the text members of ZIP archives, one
    archive per task; an archive is opened in memory, its members are streamed."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        rows = []
                        with z.open(member) as f:
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8", errors="replace")):
                                rows.append((name, member, i, line.rstrip("\n")))
                                if len(rows) == 5000:
                                    yield pd.DataFrame(rows, columns=_ZIP)
                                    rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=_ZIP)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, line_no long, line string")


_ZIP = ["archive", "member", "line_no", "line"]


def polyglot_uci(raw: int) -> str:
    """The move of a book record; promotion pieces by number."""
    square = lambda v: "abcdefgh"[v & 7] + str((v >> 3 & 7) + 1)
    return square(raw >> 6) + square(raw) + " nbrq"[raw >> 12 & 7].strip()


def read_polyglot(spark: SparkSession, path: str) -> DataFrame:
    """(book, key, uci, weight, learn) of the 16-byte records of opening books; keys
    are signed 64-bit, a record that is cut off is left out."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, k, polyglot_uci(m), w, x) for k, m, w, x in struct.iter_unpack(">qHHI", data[: len(data) // 16 * 16])]
                yield pd.DataFrame(rows, columns=["book", "key", "uci", "weight", "learn"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "book string, key long, uci string, weight int, learn long")


def weighted_moves(book: DataFrame) -> DataFrame:
    """(key, moves): each position's moves with their share of weight, heaviest first."""
    share = book.groupBy("book", "key", "uci").agg(F.sum("weight").alias("w"))
    per = share.groupBy("book", "key").agg(F.sum("w").alias("all"))
    merged = share.join(per, ["book", "key"]).groupBy("key", "uci").agg(F.sum(F.col("w") / F.nullif(F.col("all"), F.lit(0))).alias("weight"))
    order = F.struct((-F.col("weight")).alias("o"), F.col("uci"), F.col("weight"))
    return merged.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: F.struct(s["uci"].alias("uci"), s["weight"].alias("weight"))).alias("moves"))
