"""Language identification with string kernels.

A text is the set of its character n-grams for n = 1..3 (a blended spectrum by
presence).  The kernel of two texts is the size of the intersection of their
sets, divided by the geometric mean of the set sizes.  Sets are kept as bits of
a hashed n-gram space of ``DIM``.  A bounded sample of labelled rows gives
landmark texts; ridge regression on the Nyström columns, one language against
the rest, gives the weights.  A batch is scored by two matrix products: presence
by landmarks, kernel by weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, texts_of

DIM = 1 << 15
SIZES = (1, 2, 3)
# Odd multipliers that spread n-grams over 32 bits (fixed values).
SPREAD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class FitBounds:
    """Bounds of the fit: rows and landmarks altogether, shared among the languages."""

    rows: int = 2_000
    landmarks: int = 128
    languages: int = 500
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    landmarks: np.ndarray  # DIM x m, scaled by the landmarks' set sizes
    weights: np.ndarray  # m x labels


def present(text: str, row: np.ndarray) -> None:
    """Set the bits of a text's n-grams in ``row``; long texts go piece by piece."""
    low = text.lower()
    for i in range(0, max(1, len(low)), PIECE):
        codes = np.frombuffer(low[i : i + PIECE + len(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(codes), np.uint32)
        for n, k in zip(SIZES, SPREAD):
            if n > len(codes):
                break
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(k)
            h ^= h >> np.uint32(15)
            row[h & np.uint32(DIM - 1)] = 1


def scaled(sets: np.ndarray) -> np.ndarray:
    """Presence rows as floats of unit kernel with themselves."""
    x = sets.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(sets: np.ndarray, labels: list[str], bounds: FitBounds) -> Model:
    """Kernel ridge regression, one language against the rest, on Nyström landmarks.

    Landmarks are taken in turn from each language, in the order of the rows.
    """
    names = tuple(sorted(set(labels)))
    at = np.array([names.index(x) for x in labels], int)
    x = scaled(sets)
    turn = np.empty(len(at), int)
    for k in range(len(names)):
        turn[at == k] = np.arange((at == k).sum())
    marks = np.lexsort((at, turn))[: bounds.landmarks]
    land = x[marks]
    knm, kmm = (x @ land.T).astype(np.float64), (land @ land.T).astype(np.float64)
    y = np.where(at[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Each language weighs the same, however many rows it has.
    w = (len(at) / len(names) / np.bincount(at, minlength=len(names)))[at][:, None]
    left = knm.T @ (knm * w) + bounds.ridge * len(at) * (kmm + 1e-6 * np.eye(len(marks)))
    weights = np.linalg.lstsq(left, knm.T @ (y * w), rcond=None)[0]
    return Model(names, np.ascontiguousarray(land.T), weights.astype(np.float32))


def predict(model: Model | None, texts: list[str], rows: int = 128) -> tuple[list[str], list[float]]:
    """Labels and scores in [0, 1]; a text without a letter is ``und`` with score 0.

    The score is the share of the best language in exp(3 * value) over all of them.
    """
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    known = [i for i, t in enumerate(texts) if LETTER.search(t)]
    for j in range(0, len(known), rows):
        part = known[j : j + rows]
        sets = np.zeros((len(part), DIM), np.uint8)
        for k, i in enumerate(part):
            present(texts[i], sets[k])
        value = (scaled(sets) @ model.landmarks) @ model.weights
        best = value.argmax(1)
        share = np.exp(3 * (value - value.max(1, keepdims=True)).astype(np.float64))
        for k, i in enumerate(part):
            names[i] = model.labels[best[k]]
            scores[i] = round(float(share[k, best[k]] / share[k].sum()), 6)
    return names, scores


def bits_of(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append the presence set of ``text`` as packed bits: DIM / 8 bytes however long the text."""

    def make():
        def fn(column: pa.Array):
            packed = []
            for t in texts_of(column):
                row = np.zeros(DIM, np.uint8)
                present(t, row)
                packed.append(np.packbits(row).tobytes())
            return [pa.array(packed, pa.binary())]

        return fn

    return append_arrow(df, [text], [(out, T.BinaryType())], make)


def train(df: DataFrame, *, learn: Column, order: Column, text: str = "text", lang: str = "lang", bounds: FitBounds = FitBounds()) -> Model | None:
    """Fit on at most ``bounds.rows`` rows of ``df`` where ``learn`` holds and text and label aren't null.

    Each language gives an equal share, the rows of least ``order`` (a hash of
    the row).  Counts by language decide a hash threshold per language, so only
    about three times the share is sorted.  What reaches the driver is one
    packed set a row: bounds.rows * DIM / 8 bytes.  Beyond ``bounds.languages``
    the most frequent languages are learned.  Without such rows there's no model.
    """
    good = df.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = good.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    counts = {r[lang]: r["n"] for r in counts.orderBy(F.desc("n"), lang).limit(bounds.languages).collect()}
    if not counts:
        return None
    share = max(1, bounds.rows // len(counts))
    top = 1 << 32
    upto = F.lit(0).cast("long")
    for name, n in counts.items():
        upto = F.when(F.col(lang) == name, F.lit(min(top, top * (3 * share + 50) // n))).otherwise(upto)
    key = F.xxhash64(order).bitwiseAND(F.lit(top - 1))
    near = good.select(F.col(lang).alias("label"), F.col(text).alias("text"), key.alias("key"), upto.alias("upto")).filter("key < upto")
    sets = bits_of(near.select("label", "key", "text"), "text", "bits").drop("text")
    w = Window.partitionBy("label").orderBy("key", "bits")
    rows = sets.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= share).orderBy("label", "rank").collect()
    if not rows:
        return None
    packed = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), DIM // 8)
    return fit(np.unpackbits(packed, axis=1), [r["label"] for r in rows], bounds)


def identified(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append ``lang`` and ``score`` for every whole text; only the text is an input.

    The model (bounded by its landmarks) is sent to the tasks once.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(column: pa.Array):
            names, scores = predict(shared.value, texts_of(column))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return fn

    return append_arrow(df, [text], [(lang, T.StringType()), (score, T.DoubleType())], make)
