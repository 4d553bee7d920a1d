"""Kernel values against sets, held-out accuracy, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid as L
from tickloom.llm import queries

SF = "/root/testdata/sf0.01"


def grams(text):
    return {text[i : i + n] for n in L.SIZES for i in range(len(text) - n + 1)}


def test_kernel_is_the_normalised_intersection():
    texts = ["the cat sat on the mat", "der hund und die katze", "the cat", "日本語のテキスト"]
    sets = np.zeros((4, L.DIM), np.uint8)
    for t, row in zip(texts, sets):
        L.present(t, row)
    k = L.scaled(sets) @ L.scaled(sets).T
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert k[i, j] == pytest.approx(want, abs=0.03)  # hashed n-grams may meet


def test_pieces_do_not_change_the_set(monkeypatch):
    text = "abcdefghij" * 50 + "xyz"
    a, b = np.zeros(L.DIM, np.uint8), np.zeros(L.DIM, np.uint8)
    L.present(text, a)
    monkeypatch.setattr(L, "PIECE", 7)
    L.present(text, b)
    assert (a == b).all() and not np.zeros(1).any()


def test_held_out_accuracy(spark):
    got = queries.op2_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    r = got.join(docs, "doc_id").filter("held_out AND n >= 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a > 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0 and got.count() == docs.count()


def test_odd_rows(spark):
    rows = [(i, ("the cat sat on it " if i % 2 else "der hund und die katze ") * (1 + i % 3), "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(50, None, "en", None), (51, "", "de", None), (52, "123 !!", None, None), (53, "the cat " * 5000, None, None), (None, "und die", "de", None), (3, "the cat sat", "en", None), (3, "the cat sat", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ string")
    m = L.train(df, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2, order=F.col("doc_id"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identified(df, m).collect()]
    by = {d: p for d, p, _ in got}
    assert len(got) == len(rows) and by[50] == by[51] == by[52] == "und" and by[53] == "en" and by[None] == "de"
    assert all(p == ("en" if d % 2 else "de") for d, p, _ in got if d is not None and d < 40)
    assert L.train(df.filter("false"), learn=F.lit(True), order=F.col("doc_id")) is None
    assert [r.lang_pred for r in L.identified(df, None).collect()] == ["und"] * len(rows)
