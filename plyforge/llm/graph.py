"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash, unstash


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


#: Keys that hold more rows than this, and than their share of _MOST_HOT, are hot.
_HOT_ROWS, _MOST_HOT = 10_000, 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table(key, n, ...) on key, without n. table has each key once,
    n says how many of the ``total`` rows have it. Keys with very many rows, of which
    there can be _MOST_HOT at most, are broadcast, so their rows stay where they are;
    all others are joined as Spark sees fit."""
    if total <= _HOT_ROWS:
        return rows.join(table.drop("n"), key)
    hot = table.filter(F.col("n") > max(_HOT_ROWS, total // _MOST_HOT))
    hot = stash(hot.drop("n"), "hot")
    if hot.isEmpty():
        unstash(hot)
        return rows.join(table.drop("n"), key)
    names = hot.select(F.col(key).alias("_hot"))
    cold = rows.join(F.broadcast(names), rows[key] == names["_hot"], "left_anti").join(table.drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges(u, v): root is the smallest node that
    can be reached. Alternates large-star and small-star steps (Kiveris et al.,
    2014): each is a minimum per node, combined before the shuffle, and a join
    that leaves the edges of hubs where they are. Loops and null ends are ignored;
    repeated edges count once; an empty table gives no rows. Runs jobs while the
    plan is built, two or three a round."""
    links = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    links = stash(links, "links")
    before = _signature(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.sum(F.when(F.col("v") > F.col("u"), 1).otherwise(0)).alias("n"))
        # tables that more than one job reads are written out, small ones are made again
        keep = stash if before[0] > _HOT_ROWS else lambda df, _: df
        low = keep(low, "low")
        # each edge seen from its lower end: the higher one goes to the least node around
        turned = spread_join(links.select(F.col("v").alias("u"), F.col("u").alias("far")), low, "u", before[0])
        large = turned.select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = spread_join(large, low.filter("n > 1"), "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after_links = stash(small, "links")
        unstash(links)
        links, after = after_links, _signature(after_links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
