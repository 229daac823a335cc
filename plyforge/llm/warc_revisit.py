"""WARC archives with revisit resolution.

Headers (id, payload digest, length) are grouped by digest; of equal payloads one
record stays a response and the others become revisit records that refer to it.
Payloads are joined only with the digests that occur more than once, a table whose
size the planner knows, so that payloads move only if that table is large. The
archives are written with fresh headers by Spark's own text sink (a record ends
with two line breaks, which is its line separator), so a task that is lost is
written again and committed once, on any file system. Reading parses each file by
the content lengths and joins revisits to their originals.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .store import fresh_path, stash

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_READ = (
    "page_id long, record_id string, record_type string, refers_id string, refers_page long, "
    "payload_digest string, payload_bytes long, target_uri string, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _B32)


def record_id(page: Column, digest: Column) -> Column:
    """A URN that follows from page and payload, so that a task run twice writes
    the same record."""
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, original) of each payload of at least min_bytes that more than one
    row of pages(page_id, payload) has: original is the largest page_id."""
    return (
        pages.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n"))
        .filter(F.col("n") >= min_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("k"))
        .filter("k > 1 and original is not null").select("digest", "original")
    )


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 32 << 20
) -> None:
    """Writes one record for each row of pages(page_id, url, html) below path, in
    gzip files of about file_bytes before compression. Null html is an empty
    payload, a null url becomes an urn, a null page_id is left out of the headers;
    rows that repeat the original's page_id are responses like it."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    same = stash(originals(rows, min_bytes), "digests")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload") + 900).alias("b")).first()
    per_file = max(1, file_bytes * size["n"] // max(1, size["b"] or 1))
    found = rows.withColumn("digest", base32_sha1(F.col("payload"))).join(same, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("original"), F.col("digest")), F.lit(">"))),
                line("X-Refers-To-Page-ID", F.col("original").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    (
        found.select(F.concat(header, block).alias("value")).write.option("lineSep", END)
        .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    )


def _inflate(data: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several."""
    while data:
        z = zlib.decompressobj(31)
        for i in range(0, len(data), chunk):
            yield z.decompress(data[i : i + chunk])
            if z.eof:
                data = z.unused_data + data[i + chunk :]
                break
        else:
            if z.flush() or not z.eof:
                raise ValueError("a gzip member is cut off")
            return


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC stream, by content length; a
    stream that is cut off or has other bytes between records raises."""
    source, held = iter(chunks), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        at = 0
        while (end := held.find(END.encode(), at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record's headers are cut off")
        version, *lines = bytes(held[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"a record begins with {version[:20]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        del held[: end + 4]
        n = int(headers["content-length"])
        if not fill(n + 4) or held[n : n + 4] != END.encode():
            raise ValueError("a record's block is cut off")
        block = bytes(held[:n])
        del held[: n + 4]
        yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record below path: ids, type, what it refers to, digest and length
    of the payload in the record (a response's are computed from its bytes, and a
    response that contradicts its header raises), and the payload if asked for."""

    def one(headers: dict[str, str], block: bytes) -> tuple:
        body = block.partition(END.encode())[2]
        said = headers["warc-payload-digest"].removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != said:
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have the digest in its header")
        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        return (
            page and int(page), headers["warc-record-id"].strip("<>"), kind,
            headers.get("warc-refers-to", "").strip("<>") or None, refers and int(refers), said,
            len(body) if kind == "response" else None, headers.get("warc-target-uri"),
            body if payloads and kind == "response" else None,
        )

    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for headers, block in records(_inflate(content)):
                    rows.append(one(headers, block))
                    if len(rows) == 1000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("page_id", "refers_page", "payload_bytes"):
            out[c] = out[c].astype("Int64")
        return out

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _READ)


def resolve(found: DataFrame) -> DataFrame:
    """The rows of read_archives with each revisit's payload length taken from the
    response that it refers to. Many revisits may refer to one response: the join
    is on the response's id, unique on that side, and Spark may split the other."""
    found = stash(found, "records")
    first = found.filter("record_type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("full"))
    first = stash(first.withColumnRenamed("record_id", "original_id"), "responses")
    back = found.filter("record_type = 'revisit'")
    back = back.join(first, back["refers_id"] == first["original_id"], "left").drop("payload_bytes", "original_id")
    return found.filter("record_type = 'response'").unionByName(back.withColumnRenamed("full", "payload_bytes"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to")
    )


_DIGIT = " || ".join(
    f"substr('{_B32}', ((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {s}) & 31)::int + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)

QUERIES = {"op5_warc_revisits": op5_warc_revisits}
ORACLE_SQL = {
    "op5_warc_revisits": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as original from p group by h)
select p.page_id, p.payload_bytes::bigint as payload_bytes,
       {_DIGIT} as payload_digest,
       case when p.page_id = g.original then 'response' else 'revisit' end as record_type,
       case when p.page_id <> g.original then g.original end as refers_to
from p join (select h as gh, original from g) g on p.h = g.gh"""
}
