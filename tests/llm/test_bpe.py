"""Streaming byte-pair transducer against the tokenizers library; bounded memory; decoding."""

import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe as B
from tickloom.llm import queries

SF = "/root/testdata/sf0.01"
V = B.Vocabulary(queries.vocabulary())
T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "b", "th", "ing", "er", "é", "é", "日", "ñ", "Σ", "1", "!", "<|endoftext|>", " ", "\x1c", " ", "ﬁ", "İ", "\n", "'s", "'LL", "ſ", "Ⅷ", "²", "_", "\x85", "J̌", "\U0001f600"]


def ids(text):
    return T.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_equals_the_library(seed):
    rng, e = random.Random(seed), B.Encoder(V)
    for _ in range(400):
        s = "".join(rng.choices(PARTS, k=rng.choice([0, 1, 5, 40, 400])))
        got = e.encode(s)
        assert got == ids(s), s
        assert " ".join(V.names[i] for i in got) == T.decode(got, skip_special_tokens=False)


def test_long_words_stream_to_the_same_tokens():
    rng, words = random.Random(7), [w.removesuffix("</w>") for w in V.names.values()]
    for _ in range(12):
        s = "".join(c for c in "".join(rng.choices(words, k=900)).lower() if c.isascii() and c.isalpha())
        t, most, out = B.Transducer(V), 0, []
        for i in range(0, len(s), 97):
            out += t.feed(s[i : i + 97].encode())
            most = max(most, len(t.buffer))
        out += t.close()
        assert out == ids(s) and most <= 3 * V.lookahead + 98 and not t.buffer
    assert B.Encoder(V).encode("a" * 40_000) == ids("a" * 40_000)


def test_lookahead_is_needed():
    """A window far below the lookahead emits too early for some word."""
    rng, wrong = random.Random(3), 0
    for _ in range(300):
        s = "".join(rng.choices(["th", "er", "in", "an", "re", "on", "at", "en", "or", "st"], k=60))
        t = B.Transducer(V, window=1)
        wrong += [*t.feed(s.encode()), *t.close()] != ids(s)
    assert wrong


def test_merge_orders_agree():
    rng = random.Random(1)
    for _ in range(200):
        x = [V.inner[ord(c)] for c in rng.choices("etaoinshr", k=rng.randint(1, 60))]
        assert V.merge(list(x)) == V._merge_long(list(x))


def test_decoding_is_incremental():
    text = "hello wörld 日本 x"
    m, out = B.ByteToText(V), ""
    for i in ids(text) + [V.special["<|endoftext|>"]]:
        out += "".join(m.feed([i]))
    assert out + m.close() == "hello wörld 日本 x <|endoftext|>"
    m = B.ByteToText(V)
    assert "".join(m.feed([V.inner[0xE6]])) + m.close() == "�"


def test_query_and_odd_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.op3_bpe(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        x = ids(t)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(x), sha(" ".join(map(str, x)))) and got[d].decoded_sha256 == sha(T.decode(x, skip_special_tokens=False))
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "Ab cd", "c"), (4, "word " * 50_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_ string")
    e = B.encode_documents(df, queries.vocabulary())
    back = B.decode_ids(B.decode_ids(e, queries.vocabulary()), queries.vocabulary(), out="spelled", spell=True).collect()
    assert [list(r.ids) for r in back] == [ids(t or "") for _, t, _ in rows]
    assert back[3].decoded == "ab cd " and back[3].spelled == "ab</w> cd</w>"
    assert B.digests(df.filter("false"), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("piece", ["a1", "a", "1", "é", "-", "日"])
def test_long_runs_take_time_by_length(piece):
    times = []
    for size in (1 << 16, 1 << 18):
        e = B.Encoder(V)
        t0 = time.perf_counter()
        e.encode(piece * size)
        times.append(time.perf_counter() - t0)
    assert times[1] < 4 * 3 * times[0] + 0.5


def test_decoder_is_fed_in_pieces(monkeypatch):
    text = "one two three <|endoftext|> four é 日本 " * 40
    got = B.Encoder(V).encode(text)
    want = hashlib.sha256(T.decode(got, skip_special_tokens=False).encode()).hexdigest()
    for n in (1, 7, 4096):
        monkeypatch.setattr(B, "FEED", n)
        m = B.ByteToText(V, spell=True)
        assert [B.decoded_digest(m, x) for x in (got, [], got)] == [want, hashlib.sha256(b"").hexdigest(), want]
