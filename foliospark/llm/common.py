"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text unless the operator says otherwise;
* input columns that an operator doesn't name are ignored, whatever they are called;
* an empty table gives an empty result of the same schema;
* rows that repeat are separate rows and get equal values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.session import SESSION, clean, shared_dir, written  # noqa: F401
from foliospark.session import read as table  # noqa: F401


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one document after the other, and the n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)
    data = large.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; nulls are empty."""
    data, offsets = raw_bytes(column)
    whole = data.tobytes()
    ends = offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000):
    """The batch cut into pieces of about ``most`` text bytes, one document at least each: working memory doesn't follow the batch."""
    _, offsets = raw_bytes(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
