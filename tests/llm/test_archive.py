"""Archive: exact records back, payloads once, damage noticed, odd rows."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import archive as A

LONG = "é<p>" * 40
ROWS = [
    (5, "http://a/5", LONG, 1), (2, "http://a/2\r\nX-Evil: 1", LONG, 1), (2, "http://a/2\r\nX-Evil: 1", LONG, 1), (9, None, LONG, 2), (None, "http://n", LONG, 3),
    (7, "u", None, 4), (8, "u", "", 5), (3, "u", "WARC/1.1\r\n\r\n" * 3, 6), (4, "u", "short", 7), (1, "u", "short", 8), (None, None, "x" * 200, 9), (6, "u", "y" * 1_000_000, 10),
]


@pytest.fixture
def made(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest int")
    return A.write(df, folder=str(tmp_path / "w"))


def test_rows(spark, made):
    got = A.read(spark, made).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert bytes(r.payload) == ("" if r.id in (7, 8) else bytes(r.payload).decode()).encode()
        assert r.payload_bytes == len(r.payload) and r.digest == hashlib.sha256(bytes(r.payload)).hexdigest()
    by = sorted((str(r.id), r.record_type, r.refers_to) for r in got)
    assert by == sorted([("5", "revisit", 2), ("2", "response", None), ("2", "response", None), ("9", "revisit", 2), ("None", "revisit", 2), ("None", "response", None)]
                        + [(str(i), "response", None) for i in (7, 8, 3, 4, 1, 6)])
    assert spark.read.parquet(made.payloads).count() == 6


def test_records_parse_back(spark, made):
    whole = [bytes(r.record) for r in A.records(spark, made).collect()]
    files = spark.createDataFrame([(b"".join(whole[:4]),), (gzip.compress(b"".join(whole[4:])),), (None,), (b"",)], "content binary")
    got = A.parse(files).collect()
    assert sorted(r.header.encode() + bytes(r.payload) + b"\r\n\r\n" for r in got) == sorted(whole)
    assert all(r.header.count("\r\nX-Evil") == 0 for r in got)


def test_damage_is_noticed(spark, made, tmp_path):
    p = spark.read.parquet(made.payloads)
    p.withColumn("payload", F.encode(F.concat(F.decode("payload", "UTF-8"), F.lit("!")), "UTF-8")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged record"):
        A.read(spark, A.Archive(made.headers, str(tmp_path / "bad"))).select("payload_bytes").collect()
    p.limit(1).write.parquet(str(tmp_path / "few"))
    with pytest.raises(Exception, match="damaged record"):
        A.read(spark, A.Archive(made.headers, str(tmp_path / "few"))).collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert A.read(spark, A.write(df, folder=str(tmp_path / "e"))).count() == 0
