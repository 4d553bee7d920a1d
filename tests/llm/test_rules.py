"""Rule ledger: measurements against a plain form, policies, ablations, odd rows."""

import random
import re
from collections import Counter

import pytest

from tickloom.llm import rules as R


def plain(text):
    """The measurements by their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(win)
    hit = {i + k for i, w in enumerate(win) if n[w] > 1 for k in range(3)}
    count = lambda rx: len(re.findall(rx, text))
    return (len(words), sum(map(len, words)), count(r"[#*$%&|<>]"), dup, len(hit), len(lines), count("[A-Z]"), count("[A-Za-z]"), count("!"))


@pytest.mark.parametrize("seed", range(4))
def test_measurements(seed):
    rng = random.Random(seed)
    for _ in range(250):
        t = "".join(rng.choices(["a ", "b ", "cd", " ", "\n", "\x0b", "é ", "日本 ", "#", "!", "A", "\xa0", "a b\n", "x y z "], k=rng.randint(0, 60)))
        assert R.measure(t) == plain(t), t


def test_many_words_use_wide_keys(monkeypatch):
    words = [b"%d" % i for i in range(3000)] + [b"1", b"2", b"3"]
    assert R.repeated(words) == 6
    assert R.measure("  x\x1cy")[:2] == (2, 4)


def ok(n=60):
    return " ".join(f"word{chr(97 + i % 26)}{chr(97 + i * i % 23)}{i}" for i in range(n))


def test_bits_policies_and_ablations(spark):
    rows = [
        (1, ok(), None), (1, ok(), None), (2, None, 1), (3, "", 2), (4, "a b c " * 30, 3), (5, ok().upper(), 4), (6, ok() + " #" * 20, 5),
        (None, ok(40_000), 6), (8, "\n".join([ok(12)] * 6), 7), (9, ok() + " !" * 40, 8), (10, "x " * 10, 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = R.judged(df, prefix="q_").collect()
    by = [(r.doc_id, r.q_fail_bits, r.q_kept) for r in got]
    assert [d for d, _, k in by if k] == [1, 1, None] and len(got) == len(rows)
    bits = {d: b for d, b, _ in by}
    assert bits[2] == bits[3] == 1 and bits[4] & 2 and bits[5] == 32 and bits[6] & 4 and bits[8] & 8 and bits[9] & 64
    assert all(r.q_base_failed == bool(r.q_fail_bits & 3) for r in got)
    led = R.ledger(df.select("doc_id", "text"))
    names = [n for n, _ in R.RULES]
    for r in R.ablations(led).collect():
        p = next(p for p in R.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit = 1 << names.index(r.rule)
        all_bits = [b for _, b, _ in by]
        assert (r.n_rejected, r.n_failed, r.n_only) == (sum(b & p.mask != 0 for b in all_bits), sum(b & bit != 0 for b in all_bits), sum(b & p.mask == bit for b in all_bits))
    assert R.ablations(led).count() == sum(p.mask.bit_count() for p in R.POLICIES)
    assert R.judged(df.filter("false").drop("kept")).count() == 0


def test_taken_names_get_underscores(spark):
    df = spark.createDataFrame([("x " * 60, "mine", 7)], "text string, KEPT string, n_words int")
    got = R.judged(df)
    assert got.columns[:3] == ["text", "KEPT", "n_words"] and {"n_words_", "fail_bits", "base_failed", "kept_"} <= set(got.columns)
    r = got.first()
    assert (r.KEPT, r.n_words, r.n_words_) == ("mine", 7, 60)
    assert r.base_failed == R.judged(df.select("text")).first().base_failed


def test_the_stored_ledger_answers_as_the_texts_do(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = R.stored(docs, "doc_id")
    assert "text" not in kept.columns and "MapInArrow" not in kept._jdf.queryExecution().toString()
    for p in R.POLICIES:
        a = {(r.doc_id, r.kept) for r in R.verdicts(kept, p).select("doc_id", "kept").collect()}
        b = {(r.doc_id, r.kept) for r in R.judged(docs, p).select("doc_id", "kept").collect()}
        assert a == b
