"""Media columns: byte payloads stored as lossless WebP tiles, and pixel arrays read back.

A payload is cut into rows of ``WIDTH`` pixels, four bytes (red, green, blue,
alpha) a pixel, and tiles of at most ``TILE_ROWS`` rows; each tile is a WebP file
of its own, one after the other.  So a long payload needs no large image, and
one image's memory is bounded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import webp
from tickloom.llm.common import append_arrow, texts_of

WIDTH = 144
ROW_BYTES = 4 * WIDTH
TILE_ROWS = 32
FILL = b"\xff"
SMALL_PALETTE = 16
CACHED = 256
# Side of a transform's block, as a power of two, and the share of its bits that a tile must come down to.
BITS = 5
WORTH = 0.95
BATCH = 16 << 20
# n * log2(n) of all counts in a tile.
LOGS = np.arange(WIDTH * TILE_ROWS + 1) * np.log2(np.maximum(np.arange(WIDTH * TILE_ROWS + 1), 1))


# What cross-colour takes away for each multiplier (signed, from -128 on) and each byte of green.
CROSSED = (np.arange(-128, 128)[:, None] * np.arange(256, dtype=np.uint8).view(np.int8) >> 5).astype(np.uint8)


def payload_of(text: str) -> bytes:
    """UTF-8, filled with bytes 255 up to a positive multiple of ``ROW_BYTES``."""
    data = text.encode()
    return data + FILL * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def to_pixels(data: bytes) -> np.ndarray:
    """ARGB pixels of bytes in the order red, green, blue, alpha."""
    x = np.frombuffer(data, np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(x[:, [2, 1, 0, 3]]).view("<u4").ravel().astype(np.uint32)


def to_bytes(px: np.ndarray) -> bytes:
    return np.ascontiguousarray(px.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]).tobytes()


def costs(kinds: list[np.ndarray]) -> list[float]:
    """Bits of a tile's channels at their entropy, each channel with a code of its own, for each form of the tile."""
    n, k = len(kinds[0]), len(kinds)
    lanes = (np.arange(4 * k, dtype=np.uint16) << 8).reshape(k, 1, 4)
    counts = np.bincount((np.stack(kinds) + lanes).ravel(), minlength=1024 * k)
    return (4 * LOGS[n] - LOGS[counts].reshape(k, 1024).sum(1)).tolist()


def distinct(px: np.ndarray) -> int:
    """The number of different pixels."""
    s = np.sort(px)
    return 1 + int(np.count_nonzero(s[1:] != s[:-1]))


def transforms_of(px: np.ndarray) -> tuple[tuple, int]:
    """(transforms, bits of the colour cache) of a tile: each is used where it makes the tile smaller.

    Predictor from the left or above, then cross-colour with fitted multipliers or
    the green transform on what is left; a palette for few colours and a cache for some.
    """
    colours = distinct(px[: 8 * SMALL_PALETTE]) if len(px) > 8 * SMALL_PALETTE else 0
    colours = distinct(px) if colours <= SMALL_PALETTE else colours
    if colours <= SMALL_PALETTE:
        return (("palette",),), 0
    height, blocks = len(px) // WIDTH, -(-WIDTH >> BITS) * -(-len(px) // WIDTH >> BITS)
    ch = px.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)  # differences wrap as the format's do
    forms, steps = [ch], []
    for back in (1, WIDTH) if height > 1 else ():
        left = ch.copy()
        left[back:] -= ch[:-back]
        forms.append(left)
    best, *bits = costs(forms)
    for mode, b in enumerate(bits, 1):
        if b < best * WORTH:
            best, ch, steps = b, forms[mode], [("predictor", BITS, np.full(blocks, mode << 8 | webp.BLACK, np.uint32))]
    signed = ch.view(np.int8)
    green = signed[:, 1].astype(np.float64)
    square = float(green @ green) or 1.0
    fit = [min(max(round(32 * float(signed[:, c] @ green) / square), -128), 127) for c in (0, 2)]
    # Red to blue stays 0; green to blue and green to red are fitted.
    crossed, less = ch.copy(), ch.copy()
    for c, m in zip((0, 2), fit):
        crossed[:, c] -= CROSSED[m + 128].take(ch[:, 1])
        less[:, c] -= ch[:, 1]
    bits = costs([less, crossed])
    if min(bits) < best * WORTH:
        part = np.full(blocks, webp.BLACK | (fit[1] & 255) | (fit[0] & 255) << 8, np.uint32)
        steps.append(("green",) if bits[0] <= bits[1] else ("cross", BITS, part))
    # A cache pays where few colours come back often.
    few = not steps and colours * 8 <= len(px) and distinct(px) <= min(CACHED, len(px) // 8)
    return tuple(steps), 8 if few else 0


def encode_payload(data: bytes) -> bytes:
    """The tiles of a payload, each with the transforms that fit it."""
    out = []
    for i in range(0, len(data), TILE_ROWS * ROW_BYTES):
        px = to_pixels(data[i : i + TILE_ROWS * ROW_BYTES])
        transforms, cache_bits = transforms_of(px)
        out.append(webp.encode(px, WIDTH, transforms=transforms, cache_bits=cache_bits))
    return b"".join(out)


def files_of(media: bytes) -> Iterator[bytes]:
    """The WebP files that lie one after the other."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def decode_media(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """The images of each stored form, all decoded in step."""
    files = [list(files_of(m)) for m in media]
    images = iter(webp.decode([f for fs in files for f in fs]))
    return [[next(images) for _ in fs] for fs in files]


def features(images: list[tuple[int, int, np.ndarray]]) -> str:
    """size, mean sample, horizontal contrast and distinct colours, as whole numbers."""
    px = images[0][2] if len(images) == 1 else np.concatenate([p for *_, p in images])
    s = px.view(np.uint8)
    rows = s.reshape(-1, 4 * images[0][0])
    # Bytes apart: the larger less the smaller.
    a, b = rows[:, 1:], rows[:, :-1]
    step = int((np.maximum(a, b) - np.minimum(a, b)).sum(dtype=np.int64))
    return f"{images[0][0]}x{sum([h for _, h, _ in images])};mean={int(s.sum(dtype=np.int64)) // len(s)};contrast={step // a.size};colours={distinct(px)}"


def stored(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Append the stored form (binary) of each text; null is empty.  No shuffle."""

    def make():
        return lambda column: [pa.array([encode_payload(payload_of(t)) for t in texts_of(column)], pa.binary())]

    return append_arrow(df, [text], [(out, T.BinaryType())], make, BATCH)


def pixels(df: DataFrame, media: str = "media", out: str = "images") -> DataFrame:
    """Append the images (width, height, ARGB pixels as long) of WebP files that lie in a binary column.

    Any lossless files do, one or several after each other; null has none.
    """
    kind = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.LongType()))]))
    shape = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int64()))]))

    def make():
        def fn(column: pa.Array):
            rows = decode_media([m or b"" for m in column.to_pylist()])
            return [pa.array([[{"width": w, "height": h, "pixels": p.astype(np.int64)} for w, h, p in r] for r in rows], shape)]

        return fn

    return append_arrow(df, [media], [(out, kind)], make, BATCH)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Append what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32 (of the
    last 32 bytes), media_bytes, media_sha256 and feature."""

    def make():
        def fn(column: pa.Array):
            forms = [m or b"" for m in column.to_pylist()]
            rows = []
            for m, images in zip(forms, decode_media(forms)):
                data = b"".join(to_bytes(p) for *_, p in images)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(images) if images else ""))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return fn

    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return append_arrow(df, [media], fields, make, BATCH)


def round_trip(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text and read it back: (id, n_bytes, what ``read_back`` appends)."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    d = df.select(F.col(id_).alias(id_), size.alias("n_bytes"), F.col(text).alias("text"))
    return read_back(stored(d).drop("text")).drop("media")
