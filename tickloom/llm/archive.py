"""Content-addressed web archive: payload bytes once by digest, exact record headers apart.

``write`` makes a WARC record of every page and stores two tables: ``headers``
(one exact header block a record, with the digest it points to) and ``payloads``
(each distinct payload once, under its SHA-256).  ``read`` joins them back,
checks every payload against its digest and every header against its payload,
and reads the record's fields from the header block itself; ``records`` gives
the records' original bytes.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder

REVISIT_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    headers: str
    payloads: str


def record_id(id_: Column) -> Column:
    """A stable record name made from the page's number."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(id_.cast("string"), F.lit(""))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header(id_: Column, url: Column, kind: Column, digest: Column, size: Column, refers: Column) -> Column:
    """The header block up to and with its blank line; a null url has no line."""
    line = lambda name, v: F.concat(F.lit(name + ": "), v, F.lit(END))
    safe = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    none = F.lit("")
    return F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", kind), line("WARC-Record-ID", record_id(id_)), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), none), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", record_id(refers)), line("WARC-Refers-To-Page", refers.cast("string")))).otherwise(none),
        line("X-Payload-Length", size.cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.lit(END),
    )


def write(pages: DataFrame, *, id_: str = "page_id", url: str = "url", body: str = "html", folder: str | None = None) -> Archive:
    """Archive every row of ``pages``; null bodies are empty payloads.

    Of the records with one payload of at least 100 bytes the least id is a
    response, those with other ids revisit it; shorter ones are all responses.
    Rows that repeat an id and payload repeat its record; without any id every
    record is a response.

    Digests are grouped after combining in the tasks, so a payload that many
    pages share moves once from each task.
    """
    spark = pages.sparkSession
    root = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    out = Archive(f"{root}/headers", f"{root}/payloads")
    raw = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), raw.alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    one = p.groupBy("digest").agg(F.first("payload").alias("payload"), (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload"))).alias("agree"))
    one.write.option("compression", "zstd").parquet(out.payloads)
    first = p.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"))
    h = p.drop("payload").join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    block = header(F.col("id"), F.col("url"), kind, F.col("digest"), F.col("size"), F.col("first"))
    h.select("id", "digest", block.alias("header")).write.option("compression", "zstd").parquet(out.headers)
    return out


def field(name: str) -> Column:
    """A field of the header block, null if it has none."""
    v = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(v != "", v)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record: id, header, payload (of the full content, also for revisits), digest,
    payload_bytes, record_type, refers_to.

    A payload that is not what its digest says, or a header whose length is not
    its payload's, raises an error; a missing payload does too.
    """
    store = spark.read.parquet(archive.payloads)
    sound = (F.sha2("payload", 256) == F.col("digest")) & F.col("agree")
    store = store.select("digest", "payload", F.octet_length("payload").cast("long").alias("size"), sound.alias("sound"))
    r = spark.read.parquet(archive.headers).join(store, "digest", "left")
    fits = F.coalesce(F.col("sound") & (field("X-Payload-Length").cast("long") == F.col("size")) & (F.substring_index(field("WARC-Payload-Digest"), ":", -1) == F.col("digest")), F.lit(False))
    size = F.when(fits, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("damaged record for payload "), F.col("digest"))).cast("long"))
    return r.select(
        "id", "header", "payload", "digest", size.alias("payload_bytes"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
    )


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, record): the records' own bytes, revisits without a payload."""
    r = read(spark, archive)
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return r.select("id", F.concat(F.encode("header", "UTF-8"), body, F.lit((END * 2).encode())).alias("record"))


def parse(files: DataFrame, content: str = "content") -> DataFrame:
    """(header, payload) of every record in archive files read as binary, plain or gzipped.

    Records are cut by their Content-Length, so a payload may hold anything.
    """

    def cut(data: bytes) -> Iterator[tuple[str, bytes]]:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        at = 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at) + 4
            head = data[at:stop].decode("utf-8")
            size = next(int(x.split(":")[1]) for x in head.split(END) if x.lower().startswith("content-length:"))
            yield head, data[stop : stop + size]
            at = stop + size + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = list(cut(data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.binary())], ["header", "payload"])

    return files.select(content).mapInArrow(run, "header string, payload binary")


ORACLE_SQL = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
