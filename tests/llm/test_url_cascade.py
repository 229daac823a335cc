import duckdb
import pandas as pd
from pyspark.sql import functions as F

from plyforge.llm import url_cascade as U

URLS = [
    "http://a.net/x", "http://a.net", "https://EXAMPLE.net/en/1?x=://q", "https://www.example.net/en", "ftp://x.example.com/de/", "http://example.com/den",
    "http://b.org/fr/1", "http://org/fr/", "http://xorg/fr/", "no scheme", "", None, "://", "http://?q", "http://h#f/en/", "a://b://c/d",
    "http://spam-farm.example.com/", "http://deep.www.spam-farm.example.com/x", "http://notspam-farm.example.com/", "http://É.Example.COM/\nx", "http://casino-win.example.net/en/1",
]


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "z", "k") for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string, html string, key string")


def listed(spark):
    return spark.createDataFrame([(d,) for d in [*U.LISTED, None]], "domain string")


def rows(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=str)


def test_verdicts_equal_sql(spark):
    got = rows(U.judge(pages(spark), listed(spark)))
    db = duckdb.connect()
    db.register("pages", pd.DataFrame([(r["page_id"], r["url"]) for r in pages(spark).collect()], columns=["page_id", "url"]))
    want = sorted(db.sql(U.ORACLE_SQL["op3_url_filter"]).fetchall(), key=str)
    assert got == want


def test_a_set_too_large_to_broadcast_is_joined(spark):
    assert rows(U.judge(pages(spark), listed(spark), max_bits=0)) == rows(U.judge(pages(spark), listed(spark)))


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"))
    inside = universe.filter(F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    cascade = U.build_cascade(universe, inside)
    assert len(cascade.levels) > 2
    wrong = universe.filter(cascade.listed(F.col("key")) != (F.pmod(F.xxhash64("key"), F.lit(5)) == 0))
    assert wrong.count() == 0


def test_extremes(spark):
    universe = spark.range(50).select(F.col("id").cast("string").alias("key"))
    assert universe.filter(U.build_cascade(universe, universe).listed(F.col("key"))).count() == 50
    assert universe.filter(U.build_cascade(universe, universe.limit(0)).listed(F.col("key"))).count() == 0
    assert U.judge(pages(spark, []), listed(spark)).count() == 0
    assert {r["verdict"] for r in U.judge(pages(spark), listed(spark).limit(0), rules=()).collect()} == {"allow"}
