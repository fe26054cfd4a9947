"""Hierarchical multi-length packing.

Documents (their ids, then a separator) are routed to tiers of context sizes, all powers of two: whole windows of the
largest size leave at once, and the rest of a document goes to the smallest tier that holds it. Each tier is packed from
the largest down; a gap in a window is filled from shorter tiers by best fit, and by cutting a short document where none
fits, so windows leave full. What can't fill a window waits for the next round; at the end of a partition it is laid end
to end and cut into powers of two. Windows of a tier make up step groups of equal tokens.

A partition packs by itself, in one pass, without a shuffle: a lost task is done again from its input alone, and memory
holds about ``round_tokens`` ids whatever the partition's size. Sequence numbers hold the partition's number.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliospark.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Tiers:
    """Packs (document, start, length) spans shorter than the largest window. Every sequence it gives has a tier's exact length."""

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes = tuple(sorted(sizes))
        if any(x & (x - 1) or x < 1 for x in self.sizes):
            raise ValueError("tier sizes are powers of two")
        self.waiting: dict[int, list] = {}  # length -> spans
        self.lengths: list[int] = []  # those in waiting, ascending
        self.tokens = 0

    def add(self, span: tuple) -> None:
        n = span[2]
        if n not in self.waiting:
            self.waiting[n] = []
            bisect.insort(self.lengths, n)
        self.waiting[n].append(span)
        self.tokens += n

    def take(self, most: int):
        """A span of the greatest length up to ``most``, or None."""
        i = bisect.bisect_right(self.lengths, most)
        if not i:
            return None
        n = self.lengths[i - 1]
        span = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.waiting[n]
            self.lengths.pop(i - 1)
        self.tokens -= n
        return span

    def shortest(self):
        return self.take(self.lengths[0]) if self.lengths else None

    def windows(self):
        """Full windows, largest tier first, as long as what waits fills them."""
        for k in range(len(self.sizes) - 1, -1, -1):
            size, below = self.sizes[k], self.sizes[k - 1] if k else 0
            while self.lengths and self.lengths[-1] > below and self.tokens >= size:
                window, gap = [], size
                while gap:
                    span = self.take(gap)
                    if span is None:
                        doc, start, length, *rest = self.shortest()
                        span = (doc, start, gap, *rest)
                        self.add((doc, start + gap, length - gap, *rest))
                    window.append(span)
                    gap -= span[2]
                yield size, window

    def remainder(self):
        """The rest, end to end, in powers of two."""
        rest = []
        while (span := self.shortest()) is not None:
            rest.append(span)
        left, i = sum(x[2] for x in rest), 0
        while left:
            size = min(1 << (left.bit_length() - 1), self.sizes[-1])
            window, gap = [], size
            while gap:
                doc, start, length, *more = rest[i]
                n = min(length, gap)
                window.append((doc, start, n, *more))
                rest[i] = (doc, start + n, length - n, *more)
                i += n == length
                gap -= n
            left -= size
            yield size, window


def packed(batches, *, path, sizes, separator, round_tokens, step_tokens, first_sequence):
    """Record batches of SCHEMA for record batches of (doc_id, text)."""
    encode, tiers, largest = encoder(path), Tiers(sizes), max(sizes)
    sequence, steps = first_sequence, {}
    out: list[tuple] = []

    def emit(size, window):
        nonlocal sequence
        offset = 0
        group, left = steps.get(size, (0, 0))
        if not left:  # a step group holds sequences of one tier, step_tokens together; its number is its first sequence's
            group, left = sequence, max(1, step_tokens // size)
        steps[size] = (group, left - 1)
        for doc, start, length, ids in window:
            crc = zlib.crc32(ids[start : start + length].tobytes())
            out.append((doc, start, length, crc, len(ids), sequence, offset, size, group))
            offset += length
        sequence += 1

    def batch():
        columns = list(zip(*out)) if out else [[]] * len(NAMES)
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

    for piece in batches:
        for doc, text in zip(piece.column(0).to_pylist(), piece.column(1)):
            ids = encode(text.as_py() or "")
            ids.append(separator)
            ids = np.array(ids, "<u4")
            whole = len(ids) // largest * largest
            for start in range(0, whole, largest):
                emit(largest, [(doc, start, largest, ids)])
            if whole < len(ids):
                tiers.add((doc, whole, len(ids) - whole, ids if not whole else _Tail(ids, whole)))
            if tiers.tokens >= round_tokens:
                for size, window in tiers.windows():
                    emit(size, window)
            if len(out) >= 10_000:
                yield batch()
    for size, window in tiers.windows():
        emit(size, window)
    for size, window in tiers.remainder():
        emit(size, window)
    yield batch()


class _Tail:
    """The last ids of a document, addressed as in the whole: the rest needn't wait in memory."""

    def __init__(self, ids: np.ndarray, start: int):
        self.ids, self.start, self.all = ids[start:].copy(), start, len(ids)

    def __len__(self):
        return self.all

    def __getitem__(self, at: slice):
        return self.ids[at.start - self.start : at.stop - self.start]


def pack(docs: DataFrame, *, doc_id="doc_id", text="text", path: str | None = None, sizes=(128, 256, 512, 1024), separator=0, round_tokens=1 << 20, step_tokens=1 << 13) -> DataFrame:
    """The pieces of every document: which ids (start, length, crc32 of the little-endian ids), and where they lie.

    A null or empty text is the separator alone. Rows with the same doc_id, or a null one, are separate documents whose
    pieces bear that id. An empty table has no pieces, texts are cut whole, however long, and columns that clash with names used here are ignored. Every sequence has a power of two as its length, so none is padded.
    """
    path = path or vocabulary()

    def run(batches):
        number = TaskContext.get().partitionId()
        yield from packed(batches, path=path, sizes=sizes, separator=separator, round_tokens=round_tokens, step_tokens=step_tokens, first_sequence=number << 33)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
