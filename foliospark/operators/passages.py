"""Passages in documents: rarest-window fingerprints. Neither side's texts are in a join by content.

1. Candidates. Of each passage ``CANDIDATES`` windows of ``WINDOW`` bytes, evenly spread (a shorter passage is one window),
   with the passage's length and digest.
2. Filter. A Bloom filter of 2 ** ``bits`` bits and two hashes over the candidates, made by at most ``FILTER_TASKS`` tasks
   and merged piece by piece; what the driver fetches and sends out has that size, whatever the number of passages.
3. Hits. Documents are read once; of each the places of windows that the filter knows are written, as ids and numbers.
4. Rarest. Hits are counted by window, and each passage keeps its rarest one: a line that begins many passages or lies in
   many documents is no key unless a passage is nothing else. Passages of which some window has no hit are nowhere.
5. Verification. A hit says where in the document the passage would have to begin; the documents asked for - no others, by
   a filter of their ids - meet their questions once, and the digest of that stretch of bytes decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import written

WINDOW, CANDIDATES, FILTER_TASKS, PIECE = 24, 8, 64, 1 << 16
CANDIDATE = "item_id long, length long, digest binary, size int, offset long, window long"


def window_hashes(data: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    eight = np.ndarray((len(data) + 1,), ">u8", data + bytes(8), strides=(1,))
    factor, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    if size < 8:
        h = (eight[:n] >> np.uint64(8 * (8 - size))).astype(np.uint64) * factor
    else:
        for at in (*range(0, size - 8, 8), size - 8):
            h = (h ^ eight[at : at + n].astype(np.uint64)) * factor
            h ^= h >> np.uint64(29)
    return (h * factor).view(np.int64)


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def candidates(passages: DataFrame) -> DataFrame:
    """The candidate windows of passages (item_id, passage); an empty passage has none."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                if data:
                    size = min(WINDOW, len(data))
                    hashes = window_hashes(data, size)
                    places = np.unique(np.linspace(0, len(hashes) - 1, CANDIDATES).astype(np.int64))
                    digest = digest_of(data)
                    rows += [(key, len(data), digest, size, int(at), int(hashes[at])) for at in places]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in CANDIDATE.split(", ")])

    return passages.select("item_id", "passage").mapInArrow(run, CANDIDATE)


def places_in(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit value."""
    h = values.view(np.uint64)
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(values: DataFrame, bits: int) -> bytes:
    """A Bloom filter, as packed bits, of the longs in a DataFrame's only column."""

    def make(batches):
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in places_in(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                table[at] = True
        packed = np.packbits(table)
        for at in range(0, len(packed), PIECE):
            piece = packed[at : at + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["at", "piece"])

    def merge(table: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x, np.uint8) for x in table.column("piece").to_pylist()]
        return pa.table({"at": table.column("at").slice(0, 1), "piece": pa.array([np.bitwise_or.reduce(pieces).tobytes()], pa.binary())})

    pieces = values.coalesce(FILTER_TASKS).mapInArrow(make, "at int, piece binary").groupBy("at").applyInArrow(merge, "at int, piece binary")
    out = bytearray((1 << bits) // 8)
    for row in pieces.toLocalIterator():  # 2 ** bits bits in all
        out[row["at"] * PIECE : row["at"] * PIECE + len(row["piece"])] = row["piece"]
    return bytes(out)


def knows(shared, bits: int):
    """A function that tells which values the filter may hold; the filter is unpacked once a task."""
    table = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)

    def test(values: np.ndarray) -> np.ndarray:
        a, b = places_in(values, bits)
        return table[a] & table[b]

    return test


def hits(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """doc_id, size, at, window: places of the documents' (doc_id, whole) windows that may be candidates'. Sizes are at most ``WINDOW`` different ones."""
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select("window").distinct(), bits))

    def run(batches):
        test = knows(shared, bits)
        for batch in batches:
            ids, kinds, places, windows = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                for size in sizes:
                    hashes = window_hashes(data, size)
                    at = np.flatnonzero(test(hashes))
                    ids.append(np.full(len(at), i))
                    kinds.append(np.full(len(at), size, np.int32))
                    places.append(at)
                    windows.append(hashes[at])
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids), pa.int64())), pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(windows), pa.int64())], names=["doc_id", "size", "at", "window"])

    return docs.select("doc_id", "whole").mapInArrow(run, "doc_id long, size int, at long, window long")


def held_passages(passages: DataFrame, docs: DataFrame, *, bits: int = 26) -> DataFrame:
    """doc_id, item_id of the documents (doc_id, whole) that hold a passage (item_id, passage), once for each row of a document.

    Empty passages aren't looked for. Null texts hold nothing; ids may be null or repeat: rows are told apart by their texts."""
    spark = docs.sparkSession
    wanted = written(candidates(passages).distinct(), "passages-wanted")
    if wanted.isEmpty():
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0)
    met = written(hits(docs, wanted, bits), "passages-hits")
    often = met.groupBy("size", "window").agg(F.count("*").alias("n"))
    each = wanted.join(often, ["size", "window"], "left")
    rarest = each.groupBy("item_id", "length", "digest").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "window", "offset")).alias("w")).where("w.n > 0")
    rarest = rarest.select("item_id", "length", "digest", "w.size", "w.window", "w.offset")
    asked = met.join(rarest, ["size", "window"]).select("doc_id", "item_id", "length", "digest", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    asked = written(asked.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "length", "digest")).alias("asked")), "passages-asked")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")))
    shared = spark.sparkContext.broadcast(filter_of(asked.select(key.alias("key")), bits))

    def among(batches):
        test = knows(shared, bits)
        for batch in batches:
            keep = test(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array(keep)).select(["doc_id", "whole"])

    def verify(batches):
        for batch in batches:
            ids, items = [], []
            for i, (text, questions) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                data = (text.as_py() or "").encode()
                right = {(q["item_id"], q["digest"]) for q in questions if digest_of(data[q["start"] : q["start"] + q["length"]]) == q["digest"]}
                ids += [i] * len(right)
                items += [item for item, _ in right]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    chosen = docs.select(key.alias("key"), "doc_id", "whole").mapInArrow(among, "doc_id long, whole string")
    joined = chosen.join(asked.withColumnRenamed("doc_id", "its_id"), F.col("doc_id").eqNullSafe(F.col("its_id"))).select("doc_id", "whole", "asked")
    return joined.mapInArrow(verify, "doc_id long, item_id long")
