"""Block lists of positions: every FEN of a row is looked up, under both variants
where the rules are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol as P

# What counts as a FEN inside a row's texts.
ROW_FEN = r"[pnbrqkPNBRQK1-8]+(?:/[pnbrqkPNBRQK1-8]+){7} [wb] (?:-|[KQkqA-Ha-h]+) (?:-|[a-h][1-8])(?: \d+ \d+)?"
# Fixed values end.


def is_chess960(is_960: Column, chess960_id: Column, fen: Column) -> Column:
    """A row's own mark, an id of a start, or a position that only Chess960 allows."""
    return F.coalesce(is_960, F.lit(False)) | chess960_id.isNotNull() | F.coalesce(P.variant_key(fen).startswith("960:"), F.lit(False))


def block_keys(positions: DataFrame, fen: str = "fen", chess960: Column | bool = False) -> DataFrame:
    """(key) of positions to keep out: their own, and the other variant's where no
    castling is left."""
    return positions.filter(F.col(fen).isNotNull()).select(F.explode(P.blocking_keys(F.col(fen), chess960=chess960)).alias("key")).distinct()


def load_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key) of a block list's lines, written anew; blank lines don't count."""
    text = F.trim(F.col(column))
    return lines.filter(text != "").select(P.normalized_key(text).alias("key")).distinct()


def _fen_hits(rows: DataFrame, id_: str, fens: Column, blocked: DataFrame, chess960: Column) -> DataFrame:
    """(id, fen) of rows' FENs that stand in blocked(key) under any of their keys."""
    each = rows.select(id_, chess960.alias("_960"), F.explode(F.array_distinct(fens)).alias("fen"))
    keyed = each.select(id_, "fen", F.explode(P.blocking_keys(F.col("fen"), chess960=F.col("_960"))).alias("key"))
    return keyed.join(blocked, "key", "left_semi").select(id_, "fen").distinct()


def row_fens(fen: Column, metadata: Column, messages: Column) -> Column:
    """The FENs of a row: its own, values of metadata (a map) whose name has "fen" in it
    and that are FENs, and all that its assistant messages hold."""
    named = F.map_values(F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: F.contains(F.lower(k), F.lit("fen")) & F.trim(v).rlike(f"^{ROW_FEN}$")))
    said = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.regexp_extract_all(F.coalesce(m["content"], F.lit("")), F.lit(ROW_FEN), F.lit(0))))
    own = F.when(F.coalesce(fen, F.lit("")) != "", F.array(fen)).otherwise(F.array().cast("array<string>"))
    return F.concat(own, F.transform(named, F.trim), F.coalesce(said, F.array().cast("array<string>")))


def contaminated(rows: DataFrame, blocked: DataFrame, id_: str) -> DataFrame:
    """(id, fens): the blocked FENs of rows(id, fen, is_chess960, metadata, messages)
    that have any, sorted. Null fields hold none."""
    fens = row_fens(F.col("fen"), F.col("metadata"), F.col("messages"))
    hits = _fen_hits(rows, id_, fens, blocked, F.coalesce(F.col("is_chess960"), F.lit(False)))
    return hits.groupBy(id_).agg(F.array_sort(F.collect_set("fen")).alias("fens"))


def without_contaminated(rows: DataFrame, blocked: DataFrame, id_: str) -> DataFrame:
    """The rows without a blocked FEN."""
    return rows.join(contaminated(rows, blocked, id_).select(id_), id_, "left_anti")


def audit_files(files: DataFrame, blocked: DataFrame) -> DataFrame:
    """(path, rows, fens) of the files of files(path, line, fen, is_chess960, metadata,
    messages) that have contaminated rows: how many, and the first FEN of each."""
    keyed = files.withColumn("_id", F.struct("path", "line"))
    hits = contaminated(keyed, blocked, "_id").select("_id.path", "_id.line", F.get("fens", F.lit(0)).alias("fen"))
    by_line = F.transform(F.array_sort(F.collect_list(F.struct("line", "fen"))), lambda x: x["fen"])
    return hits.groupBy("path").agg(F.count("*").alias("rows"), by_line.alias("fens"))
