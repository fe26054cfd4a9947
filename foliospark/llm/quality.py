"""Quality by a regularised quadratic discriminant.

A document is a vector of transformed statistics of its whole text. Each class has a Gaussian whose covariance is shrunk
towards the pooled one and then towards its own diagonal; the score is the difference of the two log densities (squared
Mahalanobis distances from cached Cholesky factors, log determinants, log priors), put through a logistic curve fitted on
the same bounded sample, because the raw difference is far too sure of itself.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import id_bucket, slices
from foliospark.llm.labelled import labelled_sample, logistic

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?'-\"()"]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A compressor's window: texts are compressed in such pieces, so that a long text's ratio is comparable with a short one's.
PIECE = 4096


def log_share(part: float, whole: float) -> float:
    """The log odds of a share, with half a case on either side."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: bytes) -> list[float]:
    """The vector of a text; the empty text has one like the rest."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    letters, upper, digits, stops, spaces = (int(counts[m].sum()) for m in (LETTER, UPPER, DIGIT, STOP, SPACE))
    symbols = n - letters - digits - stops - spaces
    words = text.split()
    w = len(words)
    often = Counter(words)
    lengths = np.fromiter(map(len, words), float, w) if w else np.zeros(1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = sum(x.isalpha() or not x.isascii() for x in often.elements()) if w < 50 else sum(c for x, c in often.items() if x.isalpha() or not x.isascii())
    packed = sum(len(zlib.compress(text[i : i + PIECE], 1)) - 8 for i in range(0, n, PIECE))
    top = often.most_common(1)[0][1] if w else 0
    return [
        math.log1p(w),
        log_share(upper, letters),
        log_share(digits, n),
        log_share(stops, n),
        log_share(symbols, n),
        log_share(spaces, n),
        math.log(float(lengths.mean()) + 0.5),
        math.log(float(lengths.std()) + 0.5),
        log_share(len(often), w),
        log_share(top, w),
        log_share(same, max(0, w - 1)),
        log_share(pairs, max(0, w - 1)),
        log_share(len(set(lines)), len(lines)),
        math.log1p(w / (len(lines) + 1)),
        log_share(plain, w),
        math.log((packed + 8) / (n + 8)),
    ]


def shrunk(x: np.ndarray, pooled: np.ndarray, to_pooled: float, to_diagonal: float) -> np.ndarray:
    own = np.cov(x, rowvar=False) if len(x) > 1 else pooled
    s = (1 - to_pooled) * own + to_pooled * pooled
    return (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))


def train(x: np.ndarray, y: np.ndarray, *, to_pooled=0.1, to_diagonal=0.05) -> dict:
    """Means, Cholesky factors and log priors of both classes, and the curve from the difference to a probability."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - center) / scale
    pooled = sum(len(z[y == k]) * np.cov(z[y == k], rowvar=False) if (y == k).sum() > 1 else 0 for k in (0, 1)) / len(z) + 1e-9 * np.eye(z.shape[1])
    model: dict = {"center": center, "scale": scale, "classes": []}
    for k in (0, 1):
        own = z[y == k]
        factor = np.linalg.cholesky(shrunk(own, pooled, to_pooled, to_diagonal))
        model["classes"].append((own.mean(0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), math.log(len(own) / len(z))))
    d = difference(x, model)
    model["curve"] = logistic(np.arcsinh(d)[:, None], y.astype(float), ridge=0.1).tolist()
    return model


def difference(x: np.ndarray, model: dict) -> np.ndarray:
    """Log density of class 1 minus that of class 0, priors included."""
    z = (x - model["center"]) / model["scale"]
    logs = []
    for mean, inverse, half_log, prior in model["classes"]:
        d = (z - mean) @ inverse.T
        logs.append(prior - half_log - 0.5 * (d * d).sum(1))
    return logs[1] - logs[0]


def fit(docs: DataFrame, labels: DataFrame, *, label="quality", modulus=3, held_out=1, most=40_000, names=None) -> dict:
    """The model, from at most ``most`` labelled documents. Without rows of both labels it is the share of label 1 (0 without any row)."""
    sample = labelled_sample(docs, labels, label, modulus=modulus, held_out=held_out, most=most, **(names or {}))
    rows = sample.mapInArrow(_vectors, "x array<double>, y int").toArrow()
    y = np.array(rows["y"].to_pylist(), int)
    if len(set(y.tolist())) < 2:
        return {"prior": float(y[0]) if len(y) else 0.0}
    return train(np.array(rows["x"].to_pylist(), float), y)


def _vectors(batches):
    for whole in batches:
        for piece in slices(whole, "text"):
            x = [statistics((t.as_py() or "").encode()) for t in piece.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), piece.column(1).cast(pa.int32())], names=["x", "y"])


def scores_of(texts: list[bytes], model: dict) -> np.ndarray:
    if "prior" in model:
        return np.full(len(texts), model["prior"])
    if not texts:
        return np.zeros(0)
    slope, level = model["curve"]
    d = difference(np.array([statistics(t) for t in texts]), model)
    return 1 / (1 + np.exp(-np.clip(slope * np.arcsinh(d) + level, -30, 30)))


def score(docs: DataFrame, model: dict, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; a null text counts as empty."""

    def run(batches):
        for whole in batches:
            for piece in slices(whole, "text"):
                found = scores_of([(t.as_py() or "").encode() for t in piece.column(1)], model)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null ids, null texts (as empty ones) and repeated rows are scored like others; equal texts have equal scores. An empty
    table gives no rows, a table without labels of both kinds one score for all. Texts are read whole, however long, and
    columns that clash with names used here are ignored."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), options.get("modulus", 3)) == options.get("held_out", 1)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
