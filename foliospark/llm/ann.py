"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index. A vector less the centre, made a unit vector and rotated at random, keeps the signs of its components as packed
bits, with two correction scalars: its distance from the centre and the inner product of the rotated unit vector with
its own code. Rotation and centre come from a seed and a bounded sample; every vector is coded.

Search. The inner product with a rotated query, estimated from the bits over the correction, has an error of about
sqrt((1 - c^2) / c^2 / (d - 1)) for correction c; ``bound`` of these make a lower bound of the distance. Queries go in
rounds of ``query_block`` rows at most - the only thing broadcast, and so of a known size - and every task of a round reads
its part of the index where it lies: neither codes nor vectors of candidates are shuffled. The candidates that may be among
the nearest - lower bound not above the k-th smallest upper estimate of the batch, nor above the k-th distance found so far
in the task - are measured exactly on the original vectors beside their codes, and each query's k nearest leave the task.
A query meets each candidate once, so the whole grows with queries times rows: 8 bytes of code a pair of 64 dimensions, a
scan of the index a round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written

HIT = "place long, row long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


def rotation(size: int, seed: int) -> np.ndarray:
    """An orthogonal matrix, uniformly random."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def coded(vectors: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the centre, and the correction (inner product of unit vector and code)."""
    rest = vectors - center
    far = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(far > 0, far, 1)[:, None] @ turn.T
    bits = unit > 0
    fit = np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), far, np.where(far > 0, fit, 1.0)


def as_matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)


class Nearest:
    """The k nearest of each query among the candidates shown so far, as the codes find them; ties to the smaller id, then the smaller row."""

    def __init__(self, q_row, q, center, turn, *, k: int, bound: float):
        self.q_row, self.q, self.center, self.k, self.bound = q_row, q, center, k, bound
        rest = q - center
        self.q_far = np.linalg.norm(rest, axis=1)
        self.unit = (rest / np.where(self.q_far > 0, self.q_far, 1)[:, None] @ turn.T).astype(np.float32)
        self.found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        self.cut = np.full(len(q), np.inf)  # squared distance of the k-th found

    def show(self, c_row, c_id, c, bits, far, fit, step: int = 64):
        size, k = self.q.shape[1], self.k
        signs = (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
        wide = self.bound * np.sqrt(np.maximum(0, 1 - fit**2) / np.maximum(fit, 1e-9) ** 2 / max(1, size - 1))
        for a in range(0, len(self.q), step):
            own = self.q_row[a : a + step, None] == c_row
            product = (self.unit[a : a + step] @ signs.T).astype(float) / fit
            scale = 2 * self.q_far[a : a + step, None] * far
            base = self.q_far[a : a + step, None] ** 2 + far**2
            low = np.where(own, np.inf, base - scale * np.minimum(1, product + wide))
            high = np.where(own, np.inf, base - scale * np.maximum(-1, product - wide))
            cut = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
            cut = np.minimum(cut, self.cut[a : a + step]) + 1e-9
            for i in range(len(low)):
                near = np.flatnonzero((low[i] <= cut[i]) & np.isfinite(low[i]))
                if len(near):
                    self.measure(a + i, near[np.argsort(low[i, near], kind="stable")], low[i], c_row, c_id, c)

    def measure(self, at, near, low, c_row, c_id, c):
        """Lowest bounds first: once k are measured, a bound beyond the k-th ends the search."""
        kept, ids, rows = self.found[at]
        for b in range(0, len(near), 256):
            part = near[b : b + 256]
            if low[part[0]] > self.cut[at] + 1e-9:
                break
            exact = np.sqrt(((c[part] - self.q[at]) ** 2).sum(1))
            kept, ids, rows = np.concatenate([kept, exact]), np.concatenate([ids, c_id[part]]), np.concatenate([rows, c_row[part]])
            order = np.lexsort((rows, ids, kept))[: self.k]
            kept, ids, rows = kept[order], ids[order], rows[order]
            if len(kept) == self.k:
                self.cut[at] = kept[-1] ** 2
        self.found[at] = kept, ids, rows

    def result(self) -> pa.RecordBatch:
        counts = [len(kept) for kept, _, _ in self.found]
        every = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        place = np.repeat(np.arange(len(self.found)), counts)
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(every[2], pa.int64()), pa.array(every[1], pa.int64()), pa.array(every[0], pa.float64())], names=["place", "row", "vec_id", "score"])


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v: vectors without null or non-finite components, not all zero, of the length that most vectors have."""
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(good)


def search(rows: DataFrame, is_query, *, vec_id="vec_id", embedding="embedding", k=10, bound=1.9, seed=29, sample=20_000, query_block=16_384) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance on the original vectors) of each query's ``k`` nearest others.

    Null ids, null vectors, zero vectors and vectors with a null or non-finite component take no part, nor do vectors of
    another length than the commonest (the shorter of two as common). All candidates are given where there are fewer than
    ``k``. Equal vectors are ties, given by id. Rows that repeat an id are candidates and queries of their own: each such
    query row has ranks of its own, and the other rows of its id are among its candidates. An empty table gives no rows;
    columns that clash with names used here are ignored."""
    rows = usable(rows, vec_id, embedding)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = rows.sparkSession
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    size = lengths["n"]
    rows = rows.where(F.size("v") == size)
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toArrow()["v"]
    center, turn = as_matrix(drawn, size).mean(0), rotation(size, seed)

    def code(batches):
        for batch in batches:
            bits, far, fit = coded(as_matrix(batch.column(2), size), center, turn)
            packed = pa.array([x.tobytes() for x in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(far), pa.array(fit)], names=["row", "id", "v", "bits", "far", "fit"])

    # a row's number is fixed once the table is written
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    index = written(numbered.mapInArrow(code, "row long, id long, v array<double>, bits binary, far double, fit double"), "ann-index")
    queries = index.where(is_query(F.col("id"))).select("row", "id", "v")
    rounds = max(1, -(-queries.count() // query_block))
    parts = [one_round(index, queries.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(rounds)) == i), size, center, turn, k, bound) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def one_round(index: DataFrame, queries: DataFrame, size: int, center, turn, k: int, bound: float) -> DataFrame:
    """The result rows of some queries, written out: the queries are sent to every task, the index is read in place."""
    spark = index.sparkSession
    asked = queries.toArrow()
    sent = spark.sparkContext.broadcast((asked["row"].to_numpy(), as_matrix(asked["v"], size) if asked.num_rows else np.zeros((0, size))))

    def run(batches):
        nearest = Nearest(*sent.value, center, turn, k=k, bound=bound)
        for batch in batches:
            for at in range(0, batch.num_rows, 8_192):
                part = batch.slice(at, 8_192)
                bits = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                nearest.show(part.column(0).to_numpy(), part.column(1).to_numpy(), as_matrix(part.column(2), size), bits, part.column(4).to_numpy(), part.column(5).to_numpy())
        yield nearest.result()

    hits = index.mapInArrow(run, HIT)
    order = Window.partitionBy("place").orderBy("score", "vec_id", "row")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table({"place": pa.array(range(asked.num_rows), pa.int64()), "query_id": asked["id"].combine_chunks() if asked.num_rows else pa.array([], pa.int64())}))
    out = written(best.join(F.broadcast(ids), "place").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann-hits")
    sent.unpersist()
    return out
