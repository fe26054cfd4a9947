"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import id_bucket, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, modulus: int, held_out: int, most: int, doc_id="doc_id", text="text") -> DataFrame:
    """text and label (0 or 1) of labelled documents outside the held-out fold: different texts, at most ``most`` of them in seeded order.

    At most ``most`` ids are looked for, so the id side is small by proof and may be broadcast; rows that repeat an id don't
    add to the sample beyond the bound either. Null ids and null labels don't take part; an id with several labels has the
    greatest, and so has a text."""
    ids = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").where(id_bucket(F.col("id"), modulus) != held_out)
    ids = ids.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = written(rows.join(F.broadcast(ids), "id").groupBy("text").agg(F.max("y").alias("y")), "labelled")
    if found.count() > most:
        mark = F.xxhash64("text")
        found = found.where(mark <= found.select(mark.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0])
    return found


def logistic(x: np.ndarray, y: np.ndarray, *, ridge=1.0, rounds=50) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge on the standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    out = w.copy()
    out[:-1] = w[:-1] / scale
    out[-1] = w[-1] - float((w[:-1] * mean / scale).sum())
    return out
