"""URL filtering by rules and by a Bloom filter cascade, in DataFrame functions.

The cascade stores a set of listed hosts for one known universe: all distinct
hosts of the corpus. Level 0 is a Bloom filter of the listed hosts; level 1 holds
the hosts of the universe that level 0 takes in wrongly; level 2 the listed hosts
that level 1 takes in wrongly; and so on until a level has no false positives.
The first level that misses a host tells whether it is listed, exactly, for each
host of the universe: pages are judged by bit tests, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands before, in and after the host of a url.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Host suffix, path prefix, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Domains that are listed with all their subdomains.
LISTED = tuple(
    f"{name}.example.{zone}"
    for name in ("ads-track", "spam-farm", "casino-win", "cheap-pills", "adult-x", "free-bets")
    for zone in ("com", "net", "org")
)
# Fixed values end.


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; '' without one."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, say in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    bits: int
    hashes: int
    words: DataFrame  # one row: words, array<bigint>

    def positions(self, key: Column, number: int) -> list[Column]:
        first = F.pmod(F.xxhash64(key, F.lit(2 * number)), F.lit(self.bits))
        second = F.pmod(F.xxhash64(key, F.lit(2 * number + 1)), F.lit(self.bits))
        return [F.pmod(first + second * j, F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column, number: int) -> Column:
        words = self.words.scalar()
        tests = [
            F.getbit(F.element_at(words, F.shiftright(p, 6).cast("int") + 1), F.pmod(p, F.lit(64)).cast("int")) == 1
            for p in self.positions(key, number)
        ]
        return reduce(lambda a, b: a & b, tests)


def bloom_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A Bloom filter of the n keys at a false positive rate. Its bits are or-ed
    per 64-bit word on the executors; one row gathers the words, n * log2(1/rate)
    * 1.45 bits, which the caller has bounded."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    level = Level(bits, hashes, keys)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key"), number))).alias("p"))
    set_bits = at.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("bits")
    )
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "w")
    words = every.join(set_bits, "w", "left").agg(
        F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).getField("bits").alias("words")
    )
    level.words = stash(words, "level")
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """True for listed keys of the universe, false for its others."""
        said = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            said = F.when(~self.levels[i].holds(key, i), F.lit(i % 2 == 1)).otherwise(said)
        return said


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = 1 << 26) -> Cascade | None:
    """The cascade of listed(key), a part of universe(key); both distinct and
    without nulls. None if its first level would pass max_bits (8 MB): then the
    caller joins. Later levels are smaller by construction."""
    others = stash(universe.join(listed, "key", "left_anti"), "others")
    inside = stash(listed.join(universe, "key", "left_semi"), "inside")
    n_in, n_out = inside.count(), others.count()
    rate = min(0.5, max(1e-6, n_in * math.sqrt(0.5) / max(1, n_out)))
    if n_in * math.log2(1 / rate) * 1.45 > max_bits:
        return None
    levels: list[Level] = []
    encoded, n, tested = inside, n_in, others
    while n:
        number = len(levels)
        level = bloom_level(encoded, n, rate if number == 0 else 0.5, number)
        levels.append(level)
        wrong = stash(tested.filter(level.holds(F.col("key"), number)), "wrong")
        encoded, n, tested = wrong, wrong.count(), encoded
    return Cascade(levels)


def listed_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The keys of hosts that are one of domains(domain) or lie below one."""
    parts = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return (
        hosts.select("key", F.explode(ends).alias("domain"))
        .join(domains.select("domain").distinct(), "domain", "left_semi").select("key").distinct()
    )


def judge(pages: DataFrame, domains: DataFrame, rules=RULES, max_bits: int = 1 << 26) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages(page_id, url).
    Rules go first, the longest that fits; else hosts that domains(domain) lists
    are blocked and all others allowed. Null urls and urls without :// have an
    empty host and path and are allowed; repeated rows and rows without a page_id give
    rows of their own, an empty table gives none, other columns are left out. Urls are
    read whole, however long. Of equally long rules that fit, the host that sorts last
    decides; an empty list of domains blocks nothing."""
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    universe = stash(parsed.select(F.col("host").alias("key")).distinct(), "hosts")
    listed = stash(listed_hosts(universe, domains.filter("domain is not null")), "listed")
    cascade = build_cascade(universe, listed, max_bits)
    if cascade is None:  # too large to hand to every task
        parsed = parsed.join(listed.withColumn("hit", F.lit(True)), parsed["host"] == listed["key"], "left")
        blocked = F.coalesce("hit", F.lit(False))
    else:
        blocked = cascade.listed(F.col("host"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return parsed.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    domains = spark.sql("select explode(split(:names, ' ')) as domain", args={"names": " ".join(LISTED)})
    return judge(pages, domains)


_FITS = " ".join(
    f"when (host = '{h}' or host like '%.{h}') and path like '{p}%' then '{h}{p}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
_SAYS = " ".join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in RULES)
_LISTED = " or ".join(f"host = '{d}' or host like '%.{d}'" for d in LISTED)
_PATTERN = r"^(?:.|\n)*?://([^/?#]*)([^?#]*)"

QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE_SQL = {
    "op3_url_filter": f"""
with cut as (
  select page_id,
         translate(coalesce(regexp_extract(url, '{_PATTERN}', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '{_PATTERN}', 2), '') as path
  from pages),
ruled as (select *, case {_FITS} end as rule from cut)
select page_id, host, path, rule,
       case {_SAYS} when {_LISTED} then 'block' else 'allow' end as verdict
from ruled"""
}
