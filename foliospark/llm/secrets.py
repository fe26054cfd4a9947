"""Secret scans by token efficiency.

A public byte-level vocabulary was learnt from ordinary text and code, so ordinary strings need few tokens. A string with
few characters for each token is random, as keys are. Candidates are long unbroken strings; known strings, UUIDs, times
and numbers are left out, and names are judged by their runs of letters alone. Spans of three plain patterns (an assignment
to a secret's name, an access key, a long hexadecimal run) are found besides, and a random string is reported unless it
lies wholly in one of those. Positions are code points of the whole text; a null text is empty and has no spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices
from foliospark.llm.tokens import encoder, vocabulary

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|\d{4}-\d\d-\d\d[0-9T+-]*"  # times
    r"|[\d+/_=-]+"  # numbers
)
NAME = re.compile(r"[A-Za-z_/=-]+\d{0,4}")  # names_in_words-12
LETTERS = re.compile(r"[A-Za-z]+")


def is_random(word: str, encode, ratio: float) -> bool:
    """Fewer characters a token than ``ratio``; in names only runs of letters count, so that short words joined by marks aren't random."""
    runs = LETTERS.findall(word) if NAME.fullmatch(word) else [word]
    return sum(map(len, runs)) < ratio * sum(len(encode(x)) for x in runs)


def spans(text: str, encode, *, ratio: float, known: frozenset[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = []
    if NAMED.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run under 24 characters is dropped and cuts nothing off its neighbours, so only the long runs need looking for
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b in found)
    # both lists ascend: a candidate lies in a base span if one that starts no later reaches as far
    at, reached = 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] <= m.start():
            reached = max(reached, taken[at][1])
            at += 1
        word = m[0]
        if m.end() <= reached or word in known or IDENTIFIER.fullmatch(word):
            continue
        if is_random(word, encode, ratio):
            found.append(("random", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def _options(path, ratio, known):
    return {"path": path or vocabulary(), "ratio": ratio, "known": frozenset(known)}


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", path: str | None = None, ratio=2.1, known=()) -> DataFrame:
    """doc_id and ``found``, the spans of every text as structs (kind, start, end). ``ratio``: characters a token below which a string is random.

    A null or empty text has no spans; null ids pass; repeated rows are rows of their own with equal spans; an empty table
    gives no rows. Texts are read whole in time linear in their length, and columns that clash with names used here are
    ignored. Of base spans of one kind and place there is one; where kinds overlap, all stay."""
    options = _options(path, ratio, known)

    def run(batches):
        encode = encoder(options["path"])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [[dict(zip(("kind", "start", "end"), x)) for x in spans(t.as_py() or "", encode, ratio=options["ratio"], known=options["known"])] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest_rows(docs: DataFrame, **options) -> DataFrame:
    """Counts of each kind and the spans as text; see ``scan`` for nulls, repeats, empty tables and long texts."""
    found = scan(docs, **options)

    def number(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    count = {k: number(k) for k in KINDS}
    line = lambda of: F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", count["assign"].alias("n_assign"), count["access"].alias("n_access"), count["hex"].alias("n_hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), count["random"].alias("n_random"))


def redacted(docs: DataFrame, *, text="text", n_chars="n_chars", mask="[SECRET]", path: str | None = None, ratio=2.1, known=()) -> DataFrame:
    """The same rows and columns, each span (overlapping ones as one) replaced by ``mask``; n_chars follows. A null text stays null; an empty table stays empty."""
    options, columns = _options(path, ratio, known), docs.columns

    def run(batches):
        encode = encoder(options["path"])
        for whole in batches:
            for batch in slices(whole, text):
                yield masked(batch, encode)

    def masked(batch, encode):
        out = []
        for value in batch.column(batch.schema.get_field_index(text)):
            value = value.as_py()
            found = spans(value, encode, ratio=options["ratio"], known=options["known"]) if value else []
            if found:
                parts, at, end = [], 0, -1
                for _, a, b in found:
                    if a >= end:
                        if end >= 0:
                            at = end
                        parts += [value[at:a], mask]
                        end = b
                    end = max(end, b)
                value = "".join(parts) + value[end:]
            out.append(value)
        arrays = [pa.array(out, pa.string()) if c == text else batch.column(i) for i, c in enumerate(batch.schema.names)]
        if n_chars in columns:
            sizes = [None if v is None else len(v) for v in out]
            i = batch.schema.get_field_index(n_chars)
            arrays[i] = pa.array(sizes, batch.schema.field(i).type)
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
