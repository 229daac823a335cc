"""Keys, identities and the seeded order that replaces random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a seeded order that make a radix bucket.
RADIX_DIGITS = 3


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """sha256("seed:key:key"): a total order that is random for every seed and the
    same in every run, on every partitioning. A null key counts as empty."""
    parts = [F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def radix(order: Column) -> Column:
    """The bucket of a hash order: rows of one bucket lie together in it."""
    return F.conv(F.substring(order, 1, RADIX_DIGITS), 16, 10).cast("int")


def position_fields(fen: Column) -> Column:
    """The first four fields of a FEN: board, side, castling, en passant."""
    return F.array_join(F.slice(F.split(F.trim(fen), r"\s+"), 1, 4), " ")


def example_identity(task: Column, fen_key: Column, fields: Column) -> Column:
    """task, a colon and 24 hexadecimal digits of the digest of what makes an example:
    its position's key and those of ``fields`` (a map) that aren't empty, as one JSON
    object in order of the names, so that no two different examples are written alike."""
    own = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != "")))
    quoted = lambda c: F.regexp_replace(F.substring(F.to_json(F.struct(c.alias("x"))), 6, 1 << 30), r"\}$", "")
    body = F.concat(F.lit('{"fen":'), quoted(fen_key), F.lit(',"fields":'), F.to_json(F.map_from_entries(own)), F.lit(',"task":'), quoted(task), F.lit("}"))
    return F.concat(task, F.lit(":"), F.substring(F.sha2(body, 256), 1, 24))


def game_id(moves: Column) -> Column:
    return F.substring(F.sha2(moves, 256), 1, 16)
