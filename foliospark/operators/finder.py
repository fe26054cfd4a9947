"""Terms in texts by Aho-Corasick automata: one scan a text, whatever the number of terms; no join on words.

The terms are dealt by a hash into shards of about ``shard_bytes``. A shard is what goes to the workers at once, as a
broadcast of that size, and what one automaton holds; a text is read once for each shard. The result is a column, so that
rows keep what they have and nothing is shuffled.

A term counts where it is a whole word: what stands at its edges is looked at when it is met. Terms with ideographs count
anywhere. Occurrences of a term that overlap each other count once.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDEOGRAPH = re.compile("[㐀-䶿一-鿿぀-ヿ가-힯]")
#: Marks that join words: a term next to one is part of a longer term. Two long dashes in a row don't join.
JOINERS = frozenset("-‐‑‒–—―−")
#: Bytes of terms whose automata a worker keeps; those of more shards are made again for each batch.
KEPT_BYTES = 32 << 20

_machines: OrderedDict[str, tuple[int, ahocorasick.Automaton, pa.Table]] = OrderedDict()


def normal(text: str | None) -> str:
    return unicodedata.normalize("NFKC", (text or "").strip())


def joins(text: str, at: int, double: str) -> bool:
    """Does the character at ``at`` join a word beside it? ``double`` are the two characters next to the word."""
    c = text[at]
    return (c.isalnum() or c == "_" or c in JOINERS) and not IDEOGRAPH.match(c) and double != "——"


def occurrences(machine: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Number of each term found in a normalised text, and how often."""
    counts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for last, (number, size, free) in machine.iter(text):
        start, end = last + 1 - size, last + 1
        if start < ends.get(number, 0):
            continue
        if not free and (start > 0 and joins(text, start - 1, text[max(0, start - 2) : start]) or end < len(text) and joins(text, end, text[end : end + 2])):
            continue
        counts[number] = counts.get(number, 0) + 1
        ends[number] = end
    return counts


def machine_of(table: pa.Table) -> ahocorasick.Automaton | None:
    """The automaton of a table's distinct ``name``s; None where there is none. A name's number is its first row's."""
    machine = ahocorasick.Automaton()
    for number, name in enumerate(table.column("name").to_pylist()):
        machine.add_word(name, (number, len(name), bool(IDEOGRAPH.search(name))))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _held(key: str, shard) -> tuple[ahocorasick.Automaton | None, pa.Table]:
    """The shard's automaton and table in this worker, made when first needed."""
    if key not in _machines:
        raw = shard.value
        table = pa.ipc.open_stream(raw).read_all()
        _machines[key] = (len(raw), machine_of(table), table)
        while len(_machines) > 1 and sum(size for size, _, _ in _machines.values()) > KEPT_BYTES:
            _machines.popitem(last=False)
    _machines.move_to_end(key)
    return _machines[key][1:]


def _scanner(shard, kind: T.ArrayType) -> Callable[[Column], Column]:
    key = uuid.uuid4().hex

    @F.arrow_udf(kind)
    def scan(text: pa.Array) -> pa.Array:
        machine, table = _held(key, shard)
        offsets, rows, counts = [0], [], []
        for x in text.to_pylist():
            if machine and x:
                for number, n in occurrences(machine, normal(x)).items():
                    rows.append(number)
                    counts.append(n)
            offsets.append(len(rows))
        taken = table.take(pa.array(rows, pa.int64())).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
        found = pa.StructArray.from_arrays([*columns, pa.array(counts, pa.int64())], [*table.column_names, "n"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return scan


def finder(terms: DataFrame, *, shard_bytes: int = 4 << 20) -> Callable[[Column], Column]:
    """``terms``: name, entries (whatever belongs to the name, as one column). A function from a text column to an array of structs name, entries, n: the names that occur in it, and how often. Null and empty texts have none; names are normalised, and empty ones never occur.

    Runs a job that counts the terms' bytes, and one for each shard that fetches it; a shard is made of names with all
    their entries, so the driver holds one shard at a time."""
    spark = terms.sparkSession
    kept = terms.select(_normal(F.col("name")).alias("name"), "entries").where("name <> ''")
    size = kept.select(F.sum(F.octet_length("name") + F.octet_length(F.to_json(F.struct("entries")))).alias("n")).first()["n"] or 0
    number = max(1, math.ceil(size / shard_bytes))
    kind = T.ArrayType(T.StructType([*kept.schema.fields, T.StructField("n", T.LongType())]))
    scanners = []
    for k in range(number):
        sink = pa.BufferOutputStream()
        table = kept.where(F.pmod(F.xxhash64("name"), F.lit(number)) == k).toArrow()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        scanners.append(_scanner(spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), kind))
    return lambda text: functools.reduce(lambda a, b: F.concat(a, b), [scan(text) for scan in scanners])


@F.arrow_udf(T.StringType())
def _normal(text: pa.Array) -> pa.Array:
    return pa.array([normal(x) for x in text.to_pylist()], pa.string())
