"""Lossless WebP: every transform and coding feature round-trips; foreign bytes; the media query."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from tickloom.llm import media as M
from tickloom.llm import queries
from tickloom.llm import webp as W

SF = "/root/testdata/sf0.01"
SHAPES = [(1, 1), (1, 9), (7, 1), (16, 9), (33, 21)]


def pictures(w, h):
    rng, n = np.random.default_rng(w * h), w * h
    yield rng.integers(0, 1 << 32, n, dtype=np.uint32)
    yield rng.choice(rng.integers(0, 1 << 32, 5, dtype=np.uint32), n)
    yield rng.choice(np.array([1, 2], np.uint32), n)
    yield np.full(n, 7, np.uint32)
    yield np.arange(n, dtype=np.uint32) * np.uint32(0x01010101)
    yield np.tile(rng.integers(0, 1 << 32, -(-n // 7), dtype=np.uint32), 7)[:n]


def same(px, w, **how):
    width, height, got = W.decode([W.encode(px, w, **how)])[0]
    assert (width, height) == (w, len(px) // w) and (got == px).all(), how


@pytest.mark.parametrize("shape", SHAPES)
def test_round_trips(shape):
    w, h = shape
    rng = np.random.default_rng(1)
    blocks = ((w + 3) // 4) * ((h + 3) // 4)
    modes = rng.integers(0, 16, blocks).astype(np.uint32) << np.uint32(8) | np.uint32(W.BLACK)
    cross = rng.integers(0, 1 << 24, blocks).astype(np.uint32) | np.uint32(W.BLACK)
    for px in pictures(w, h):
        same(px, w)
        same(px, w, copies=False)
        for bits in (1, 3, 11):
            same(px, w, cache_bits=bits)
        same(px, w, transforms=(("predictor", 2, modes),))
        same(px, w, transforms=(("cross", 2, cross),))
        same(px, w, transforms=(("green",),))
        same(px, w, transforms=(("predictor", 2, modes), ("cross", 2, cross), ("green",)), cache_bits=4, meta_bits=2)
        if len(np.unique(px)) <= 256:
            same(px, w, transforms=(("palette",),))


def plain_unpredict(ch, mode, w):
    """Pixel after pixel, as the format's text has it."""
    out = ch.copy()
    for i in range(len(ch)):
        m = int(mode[i])
        p = [out[max(i - d, 0)] for d in (1, w, w + 1, w - 1)]
        out[i] = ch[i] + W.predicted(np.array([m]), *(x[None] for x in p))[0] & 255
    return out


def test_slanted_order_equals_plain_order():
    rng = np.random.default_rng(5)
    for w, h in ((1, 4), (5, 1), (6, 7), (13, 3)):
        part = rng.integers(0, 14, ((w + 3) // 4) * ((h + 3) // 4)).astype(np.uint32) << np.uint32(8)
        px = rng.integers(0, 1 << 32, w * h, dtype=np.uint32)
        want = plain_unpredict(W.channels(px), W._modes(w, h, 2, part).ravel(), w)
        assert (W.channels(W.unpredict(px, w, h, 2, part)) == want).all()


def test_a_published_file_and_damage():
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert [(w, h, len(p)) for w, h, p in W.decode([one])] == [(1, 1, 1)]
    good = W.encode(np.arange(400, dtype=np.uint32), 20)
    for bad in (b"", b"RIFF", good[:30], one[:20] + b"\x00" * 10, good[:21] + b"\xff" * (len(good) - 21)):
        with pytest.raises((ValueError, IndexError)):
            W.decode([bad])


def test_codes_are_complete_and_bounded():
    rng = np.random.default_rng(0)
    for most in (7, 15):
        for _ in range(200):
            counts = (rng.pareto(0.5, rng.integers(2, 100)) * 3).astype(np.int64)
            n = W.code_lengths(counts, most)
            used = n[n > 0]
            assert (n > 0).sum() == (counts > 0).sum() and n.max(initial=0) <= most
            assert len(used) < 2 or (2.0 ** -used).sum() == 1


def test_texts(spark):
    rows = [(1, "", "a"), (2, None, "b"), (3, "x" * 576, "c"), (4, "é" * 300, "d"), (4, "é" * 300, "d"), (None, "日本" * 40_000, "e"), (7, "Et Et Et ouy " * 3000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = M.round_trip(df).collect()
    assert len(got) == len(rows)
    for r, (d, t, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        data = (t or "").encode()
        want = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = M.encode_payload(want)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    images = M.pixels(M.stored(df.select("doc_id", "text")).select("doc_id", "media")).filter("doc_id = 3").first().images
    assert [(i.width, i.height) for i in images] == [(144, 1)] and images[0].pixels == [0x78787878] * 144
    assert M.round_trip(df.filter("false")).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op1_webp(spark, SF).collect()
    assert {r.doc_id: r.payload_sha256 for r in got} == {d: hashlib.sha256(M.payload_of(t)).hexdigest() for d, t in docs.items()}


def test_payloads_use_the_transforms_that_fit_them():
    """Tiles of slopes, of grey noise, of tied channels, of some colours and of few: each step is stored where it helps, and read back."""
    rng = np.random.default_rng(2)
    n = M.WIDTH * M.TILE_ROWS
    noise, alpha = rng.integers(0, 256, n), np.full(n, 255)
    half = (noise.astype(np.uint8).astype(np.int8).astype(int) >> 1) & 255
    slope = (np.arange(n) // 3 + rng.integers(0, 3, n)) & 255
    made = {
        "predictor": np.stack([slope, slope * 3 & 255, slope * 5 & 255, alpha], 1), "green": np.stack([noise, noise, noise, alpha], 1),
        "cross": np.stack([half, noise, half, alpha], 1), "palette": np.stack([noise & 1, noise & 1, noise & 3, alpha], 1),
        "cache": rng.integers(0, 256, (200, 4))[rng.integers(0, 200, n)], "none": rng.integers(0, 256, (n, 4)),
    }
    for name, x in made.items():
        data = x.astype(np.uint8).tobytes()
        steps, bits = M.transforms_of(M.to_pixels(data))
        assert name in ([s[0] for s in steps] + ["cache"] * bool(bits) or ["none"]), name
        (images,) = M.decode_media([M.encode_payload(data)])
        assert b"".join(M.to_bytes(p) for *_, p in images) == data
    assert sum(len(M.encode_payload(made[k].astype(np.uint8).tobytes())) for k in ("predictor", "green", "cross")) < 0.7 * 3 * 4 * n


def test_quick_lookup_agrees_with_search():
    rnd = np.random.default_rng(3)
    long, lone = W.code_lengths((2.0 ** np.arange(15)).astype(np.int64)), np.zeros(15, np.int64)
    lone[4] = 1
    sizes = [long, lone, W.code_lengths(np.arange(15))]
    quick, plain = W.Tables.of(sizes, True), W.Tables.of(sizes)
    group, window = rnd.integers(0, 3, 4000), rnd.integers(0, 1 << 62, 4000).astype(np.uint64)
    window[:64] = np.arange(64, dtype=np.uint64) << np.uint64(9) | np.uint64(511)
    group[:64] = 0
    assert long.max() > W.QUICK
    for a, b in zip(quick.read(group, window), plain.read(group, window)):
        assert (a == b).all()


def test_codes_of_very_many_symbols():
    """A full colour cache beside all literals: more symbols than short codes have room for."""
    rng = np.random.default_rng(4)
    colours = rng.integers(0, 1 << 32, 40_000, dtype=np.uint32)
    slot = (W.HASH * colours.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(21)
    colours = colours[np.unique(slot, return_index=True)[1]]
    assert len(colours) == 2048
    same(rng.choice(colours, 144 * 150), 144, cache_bits=11, copies=False)


def test_all_images_are_decoded_in_one_pass(monkeypatch):
    rng = np.random.default_rng(6)
    noise, few = rng.integers(0, 1 << 32, 600, dtype=np.uint32), rng.integers(0, 3, 600).astype(np.uint32)
    part = np.full(2, 1 << 8 | W.BLACK, np.uint32)
    files = [W.encode(noise, 20), W.encode(few, 20, transforms=(("palette",),)), W.encode(noise, 20, transforms=(("predictor", 4, part.repeat(2)), ("cross", 4, part.repeat(2)))), W.encode(noise, 20, meta_bits=3)]
    calls, read = [], W.read_pixels
    monkeypatch.setattr(W, "read_pixels", lambda asked: calls.append([q.width * q.height for q in asked]) or read(asked))
    got = W.decode(files)
    assert all((a == b).all() for (*_, a), b in zip(got, (noise, few, noise, noise)))
    assert len(calls[-1]) == 4 and all(max(c) < 10 * 20 for c in calls[:-1])


def test_forms_are_judged_by_their_entropy():
    rng = np.random.default_rng(7)
    for n in (1, 144, 4608):
        forms = [rng.integers(0, k, (n, 4)).astype(np.uint8) for k in (1, 7, 256)]
        for got, x in zip(M.costs(forms), forms):
            p = [np.unique(x[:, c], return_counts=True)[1] / n for c in range(4)]
            assert got == pytest.approx(-n * sum((q * np.log2(q)).sum() for q in p), abs=1e-6)
        px = rng.integers(0, 50, n, dtype=np.uint32)
        assert M.distinct(px) == len(np.unique(px))


def test_a_stream_that_ends_in_its_pixels_is_refused():
    """Also between two looks, and where another stream follows it."""
    rng = np.random.default_rng(8)
    whole = W.encode(rng.integers(0, 1 << 32, 400, dtype=np.uint32), 20)
    body = W.vp8l(whole)
    for cut in (8, 200, 700):
        short = whole[:16] + (len(body) - cut).to_bytes(4, "little") + body[:-cut]
        for files in ([short], [short, whole], [whole, short, whole]):
            with pytest.raises(ValueError):
                W.decode(files)
