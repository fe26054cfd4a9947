"""Media columns: interleaved document sequences.

An HTML page is read as an ordered sequence of text and media-reference structs; a reference names its payload by digest
(``src="sha256:..."``), and its caption comes from the figure round it. Payloads live in a media table, one row a
distinct digest, as 8-bit mono PCM sound: each byte of the payload is a sample, so the container loses nothing.
References are resolved by a join on the digest. A payload that a third of all documents refer to is one row on the
media side and plain rows on the other, which Spark may split; payload bytes themselves are never shuffled - the join
carries the figures computed from them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, written

BLOCK = 64
#: Digests that a task remembers so as not to store a text twice.
SEEN = 500_000
RATE = 8000
ITEM = "array<struct<position:int, kind:string, text:string, digest:string, caption:string>>"
FIGURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_media(payload: bytes) -> bytes:
    """RIFF/WAVE, PCM, one channel, 8 bits: the payload's bytes are the samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + bytes(n & 1)


def from_media(media: bytes) -> bytes:
    """The samples of the data chunk; other chunks are passed over."""
    stream = io.BytesIO(media)
    riff, _, wave = struct.unpack("<4sI4s", stream.read(12))
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a RIFF/WAVE container")
    while head := stream.read(8):
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt " and struct.unpack_from("<HHIIHH", stream.getbuffer(), stream.tell())[::5] != (1, 8):
            raise ValueError("not 8-bit PCM")
        if name == b"data":
            return stream.read(size)
        stream.seek(size + (size & 1), 1)
    raise ValueError("no data chunk")


def feature_of(samples: bytes) -> str:
    """Length, mean, deviation, share of rises and a coarse spectrum of byte values, as text."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    mean = float(x.mean())
    spread = float(x.std())
    rises = int(np.count_nonzero(x[1:] > x[:-1]))
    return f"{len(x)};{mean:.6f};{spread:.6f};{rises};" + "/".join(map(str, counts.tolist()))


def store_media(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """digest, n_bytes and media, written to the shared folder: a row for each distinct text of each partition, as far as the last ``SEEN`` digests tell; a null text is empty."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                digests, sizes, media = [], [], []
                for value in batch.column(0):
                    raw = (value.as_py() or "").encode()
                    payload = payload_of(raw)
                    key = hashlib.sha256(struct.pack("<Q", len(raw)) + payload).digest()
                    if key not in seen:
                        if len(seen) == SEEN:  # what comes again is stored again, and its figures are made one later
                            seen.clear()
                        seen.add(key)
                        digests.append(key.hex())
                        sizes.append(len(raw))
                        media.append(to_media(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["digest", "n_bytes", "media"])

    return written(docs.select(docs[text].alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def media_figures(media: DataFrame) -> DataFrame:
    """One row a digest, computed from the stored bytes as read back."""

    def run(batches):
        for batch in batches:
            out = []
            for digest, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                blob = blob.as_py()
                samples = from_media(blob)
                out.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(samples)))
            columns = list(zip(*out)) if out else [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in FIGURES.split(", ")])

    return media.select("digest", "n_bytes", "media").mapInArrow(run, FIGURES).dropDuplicates(["digest"])


class Sequence(HTMLParser):
    """Ordered items of a page: text, and references with the caption of their figure (else their alt text)."""

    MEDIA = {"img", "audio", "video", "source", "embed"}
    BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "tr", "td", "th", "table", "section", "article", "blockquote", "pre", "hr", *MEDIA}
    HIDDEN = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.hidden = 0

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS and self.caption is None:
            self.flush()
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA:
            given = dict(attrs)
            source = given.get("src") or ""
            if source.startswith("sha256:"):
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": source[7:], "caption": given.get("alt")})

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] == "media" and text:
                    item["caption"] = text
        elif tag == "figure":
            self.figure = None
        if tag in self.BREAKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """Items by position; none for a null or empty page. Unclosed tags end with the page."""
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, *, page_id="doc_id", html="html") -> DataFrame:
    """page_id and items, the ordered text and media-reference structs of each page."""

    def run(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence_of(x.as_py()) for x in batch.column(1)], kind)], names=["page_id", "items"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(run, f"page_id long, items {ITEM}")


def resolved(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """A row for each media reference: page_id, position, caption and its payload's figures (null where no payload has that digest)."""
    refs = pages.select("page_id", F.explode("items").alias("item")).where("item.kind = 'media'").select("page_id", "item.position", "item.caption", "item.digest")
    return refs.join(figures, "digest", "left")


def interleaved_pages(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and html: a page for each document that shows its payload, by digest, as a captioned figure. The digest is that of ``store_media``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, BLOCK).otherwise(F.pmod(-n, F.lit(BLOCK)))
    zeros = F.unhex(F.repeat(F.lit("00"), pad))
    little = F.reverse(F.split(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 16, "0"), "(..)", "$1 "), " "))
    size = F.unhex(F.array_join(little, ""))
    digest = F.sha2(F.concat(size, raw, zeros), 256)
    html = F.concat(F.lit("<article><p>Document "), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit('</p><figure><audio src="sha256:'), digest, F.lit('"></audio><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), html.alias("html"))


def media_columns(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Each document's payload figures, by way of its page's reference. Equal texts have equal values; repeated rows and null ids stay rows of their own.

    A null text is the empty one, whose payload is 64 zero bytes; an empty table gives no rows; texts are stored whole,
    however long; columns that clash with names used here are ignored."""
    # written, so that the join has a plain shuffle on either side and a digest with very many references can be split
    figures = written(media_figures(store_media(docs, doc_id=doc_id, text=text)), "media-figures")
    pages = sequences(interleaved_pages(docs, doc_id=doc_id, text=text))
    return resolved(pages, figures).select(F.col("page_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
