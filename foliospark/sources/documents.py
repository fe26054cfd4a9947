"""Documents of several formats as one table of units, and facts about their files."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = "work string, ord long, title string, body string, kind string"


class _Markdown(HTMLParser):
    """Text of HTML as paragraphs, headings as ATX lines."""

    HIDDEN = {"script", "style", "head", "template"}
    BLOCKS = {"p", "div", "li", "blockquote", "section", "article", "tr", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.words: list[str] = []
        self.hidden = 0
        self.mark = ""

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append(self.mark + text)
        self.words.clear()
        self.mark = ""

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.flush()
        if re.fullmatch("h[1-6]", tag):
            self.mark = "#" * int(tag[1]) + " "
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def html_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n\n".join(parser.out)


def heading_units(md: str) -> list[tuple[str, str]]:
    """(title, body) at every heading outside fences; what stands before the first has no title."""
    out, fence = [("", [])], False
    for line in md.splitlines():
        fence ^= bool(re.match(r" {0,3}(?:```|~~~)", line))
        mark = None if fence else re.match(r"#{1,6}[ \t]+(.*\S)", line)
        if mark:
            out.append((mark[1], []))
        else:
            out[-1][1].append(line)
    return [(title, body) for title, body in ((t, "\n".join(b).strip()) for t, b in out) if title or body]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_documents(content: bytes) -> list[tuple[str, str]]:
    """(path, html) in the order of the spine, linear items only; none where the container isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            root = next((x.get("full-path") for x in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile"), None)
            package = ElementTree.fromstring(z.read(root))
            items = {x.get("id"): x.get("href") for x in package.iter() if _local(x.tag) == "item"}
            spine = [x.get("idref") for x in package.iter() if _local(x.tag) == "itemref" and x.get("linear") != "no"]
            paths = [member_path(root, items.get(i) or "") for i in spine]
            return [(p, z.read(p).decode("utf-8", "replace")) for p in paths if p in names]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
        return []


def member_path(document: str, href: str) -> str | None:
    """A reference as a member of the container; None for other places and for what leaves the container."""
    parts = urlsplit(href or "")
    if parts.scheme or parts.netloc or not parts.path or parts.path.startswith("/"):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(document), unquote(parts.path)))
    return None if path.startswith("..") else path


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX; headings by their style's number."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    out = []
    for p in (x for x in root.iter() if _local(x.tag) == "p"):
        text = "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip()
        style = next((v for x in p.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        level = re.fullmatch(r"(?:Heading|heading|标题)\s*([1-6])", style)
        if text:
            out.append(("#" * int(level[1]) + " " if level else "") + text)
    return "\n\n".join(out)


def units_of(path: str, content: bytes) -> list[tuple[str, str, str]]:
    """(title, body, kind) of a file by its extension; an unknown one is a row of kind unsupported."""
    kind = posixpath.splitext(path)[1].lower().lstrip(".")
    if kind in ("txt", "md", "markdown"):
        return [(t, b, "text") for t, b in heading_units(content.decode("utf-8", "replace").removeprefix("﻿"))]
    if kind in ("html", "htm", "xhtml"):
        return [(t, b, "html") for t, b in heading_units(html_markdown(content.decode("utf-8", "replace")))]
    if kind == "docx":
        return [(t, b, "docx") for t, b in heading_units(docx_text(content))]
    if kind == "epub":
        return [(t, b, "epub") for _, html in epub_documents(content) for t, b in heading_units(html_markdown(html))]
    return [("", "", "unsupported")]


def load(files: DataFrame) -> DataFrame:
    """work, ord, title, body, kind: the units of files (path, content), as ``binaryFile`` gives them."""

    def run(batches):
        for batch in batches:
            paths, contents = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "content"))
            rows = [(posixpath.splitext(posixpath.basename(p))[0], i, *u) for p, c in zip(paths, contents) for i, u in enumerate(units_of(p, c or b""), 1)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["work", "ord", "title", "body", "kind"])

    return files.select("path", "content").mapInArrow(run, UNITS)


def file_facts(files: DataFrame) -> DataFrame:
    """path, kind, size, sha256 of files."""
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


AST = T.ArrayType(T.StructType().add("kind", T.StringType()).add("level", T.LongType()).add("text", T.StringType()))


def ast_rows(source: str | None) -> list[dict]:
    """Blocks of a document tree in JSON (t: type, c: content), flattened in order: headings, paragraphs, code, items, tables."""
    out: list[dict] = []

    def text(node) -> str:
        if isinstance(node, list):
            return "".join(map(text, node))
        if not isinstance(node, dict):
            return ""
        kind, content = node.get("t"), node.get("c")
        if kind in ("Str", "Code", "Math"):
            return content if isinstance(content, str) else content[-1]
        if kind in ("Space", "SoftBreak", "LineBreak"):
            return " "
        return "" if kind == "Note" else text(content)

    def walk(blocks, kind=None):
        for b in blocks or []:
            t, c = b.get("t"), b.get("c")
            if t == "Header":
                out.append({"kind": "heading", "level": c[0], "text": text(c[2]).strip()})
            elif t in ("Para", "Plain", "LineBlock"):
                out.append({"kind": kind or "paragraph", "level": None, "text": text(c).strip()})
            elif t == "CodeBlock":
                out.append({"kind": "code", "level": None, "text": c[1]})
            elif t in ("BulletList", "OrderedList"):
                for item in c if t == "BulletList" else c[1]:
                    walk(item, "item")
            elif t == "BlockQuote":
                walk(c, "quote")
            elif t == "Div":
                walk(c[1], kind)
            elif t == "Table":
                out.append({"kind": "table", "level": None, "text": text(c).strip()})

    try:
        walk(json.loads(source or "{}").get("blocks"))
    except ValueError:
        return []
    return out


@F.arrow_udf(AST)
def ast_blocks(source: pa.Array) -> pa.Array:
    return pa.array([ast_rows(x) for x in source.to_pylist()], pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int64()), ("text", pa.string())])))


@F.arrow_udf(T.StringType())
def resolved_member(document: pa.Array, href: pa.Array) -> pa.Array:
    return pa.array([member_path(d or "", h or "") for d, h in zip(document.to_pylist(), href.to_pylist())], pa.string())


def catalog_violations(catalog: DataFrame, units: DataFrame) -> DataFrame:
    """item, code: of a source catalogue (item, kind, status, unit, note): kinds and states are fixed; what is included has a unit that exists, what isn't has a note."""
    joined = catalog.join(units.select("unit", F.lit(True).alias("known")).distinct(), "unit", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("kind").isin("cover", "text", "image", "table", "note", "toc", "index", "other"), F.lit(False)), "kind"), F.when(~F.coalesce(F.col("status").isin("included", "excluded", "absent", "unresolved"), F.lit(False)), "status"),
        F.when((F.col("status") == "included") & blank("unit"), "unit_missing"), F.when((F.col("status") == "included") & ~blank("unit") & F.col("known").isNull(), "unit_unknown"), F.when(F.col("status").isin("excluded", "absent") & blank("note"), "note_missing"),
    ))
    return joined.select("item", F.explode(codes).alias("code"))
