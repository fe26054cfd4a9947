"""The audit of packages: every rule over members and documents, as one table of findings.

Members: work, ord, path, stored, size, body (binary). A finding is (work, code, path, detail); codes start with E_ where the
package is at fault and W_ where someone should look. Documents are the .xhtml members but for the navigation.

Bodies are read once: ``events`` makes a row of each member, with what any rule needs of its body - findings that one
document decides by itself, and lists of its pictures, captions, ids, links, notes and contents. That table is written, and
the rules across members are joins and aggregates over its narrow columns. Patterns run in the JVM; the check of the markup
itself, cells and collected notes need Python.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text as t
from foliospark.functions import udfs
from foliospark.session import written

MIMETYPE, CONTAINER, STYLE = "mimetype", "META-INF/container.xml", "OEBPS/style.css"
LARGE_PACKAGE, LARGE_IMAGE, WIDE, SLIM = 50 * 1024 * 1024, 2 * 1024 * 1024, 4000, 5

# Fixed values of the rules: what is left over from Markdown, ideographs, counters after which a number counts things,
# marks that may end a paragraph, and forms of notes and remote addresses.
RESIDUE = (
    ("![", r"!\["), ("**", r"(?<!\*)\*\*(?!\*)"), (":::", ":::"), ("{.", r"\{\."), ("[^", r"\[\^"), ("\\", r"\\[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"),
    ("&lt;/", r"&lt;/?[a-zA-Z][\w:.-]*(?:\s[^<>]*)?&gt;"), ("{=html}", r"\{\s*=\s*html\s*\}"), ("段首ATX标题", r"<p[^>]*>\s*#{1,6}\s+\S"), ("空span", r"\[\]"),
)
HAN = r"[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]"
COUNTERS = "人年月日个名条吨米位页章节周天号项次辆架台艘款种岁分秒时元角枚张封把支颗只头匹双套组批届栋间处座"
PARAGRAPH_ENDS = "。！？…!?;；”’\"'」』）)】〕》>"
REMOTE = r"(?i)^(?:https?|javascript|data):"
LIST_MARK = r"^(?:(?:[-*+]|\d{1,3}[.)])\s+)?"
MARKED_NOTE = LIST_MARK + r"(?:注\s*[\[［（(]?\s*\d{1,4}\s*[\]］）).、:：]?\s+\S|\[\d{1,4}\]\s+\S)"
NUMBERED_NOTE = r"^\s*(\d{1,4})[.、]\s+\S"
MEDIA = r"(?i)\.(?:png|jpe?g|gif|bmp|webp|avif)$"


def found(df: DataFrame, code: str | Column, path="path", detail="") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select("work", code.alias("code"), F.col(path).alias("path") if isinstance(path, str) else path.alias("path"), detail.cast("string").alias("detail"))


def member_of(base: str | None, href: str | None) -> str | None:
    """The member that a reference of a member means: without query and fragment, decoded, dots folded."""
    if base is None or href is None:
        return None
    bare = unquote(re.split("[?#]", href, maxsplit=1)[0])
    folder = "" if bare.startswith("/") else base.rpartition("/")[0]
    parts: list[str] = []
    for part in [*folder.split("/"), *bare.split("/")]:
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


@F.arrow_udf(T.StringType())
def resolved(base: pa.Array, href: pa.Array) -> pa.Array:
    return pa.array(map(member_of, base.to_pylist(), href.to_pylist()), pa.string())


class Unkept:
    """What a parser makes of markup that is only checked: nothing, where a tree would be many times as large as its text."""

    def close(self) -> None:
        pass


@F.arrow_udf(T.BooleanType())
def well_formed(markup: pa.Array) -> pa.Array:
    def ok(x):
        parser = ET.XMLParser(target=Unkept())
        try:
            parser.feed(x or "")
            parser.close()
            return True
        except ET.ParseError:
            return False

    return pa.array([ok(x) for x in markup.to_pylist()], pa.bool_())


def unreadable(packages: DataFrame, members: DataFrame) -> DataFrame:
    """E_NOT_EPUB: containers that have no members."""
    return found(packages.join(members.select("work").distinct(), "work", "left_anti"), "E_NOT_EPUB", F.lit(None).cast("string"))


def one_of(df: DataFrame, *rules: tuple) -> DataFrame:
    """Findings of several rules (test, code, path, detail) that read the same rows, in one pass."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = [F.when(test, F.struct(F.lit(code).alias("code"), text(path).cast("string").alias("path"), text(detail).cast("string").alias("detail"))) for test, code, path, detail in rules]
    return df.select("work", F.explode(F.array_compact(F.array(*made))).alias("f")).select("work", "f.code", "f.path", "f.detail")


def container_findings(members: DataFrame) -> list[DataFrame]:
    whole = members.groupBy("work").agg(F.min_by(F.struct("path", "stored", F.col("text").alias("body")), "ord").alias("f"), F.bool_or(F.col("path") == CONTAINER).alias("has"), F.sum("size").alias("size"))
    opens, path = F.col("f.path") == MIMETYPE, F.col("f.path")
    none = F.lit(None)
    return [
        one_of(
            whole, (~opens, "E_MIMETYPE_FIRST", path, ""), (opens & ~F.col("f.stored"), "E_MIMETYPE_STORED", path, ""), (opens & (F.col("f.body") != "application/epub+zip"), "E_MIMETYPE_CONTENT", path, ""),
            (~F.col("has"), "E_NO_CONTAINER", CONTAINER, ""), (F.col("size") > LARGE_PACKAGE, "W_EPUB_SIZE", none, F.col("size")),
        ),
        found(members.groupBy("work", "path").count().where("count > 1"), "E_ZIP_DUPLICATE", detail=F.col("count")),
        found(members.where(F.col("path").rlike(MEDIA) & (F.col("size") > LARGE_IMAGE)), "W_IMG_UNCOMPRESSED", detail=F.col("size")),
    ]


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def package_files(members: DataFrame) -> DataFrame:
    """work, opf, xml of the package file that the container names; opf is empty or xml null where there is none."""
    named = members.where(F.col("path") == CONTAINER).select("work", F.regexp_extract("text", 'full-path="([^"]+)"', 1).alias("opf")).distinct()
    return named.join(members.where("text is not null").select("work", F.col("path").alias("opf"), F.col("text").alias("xml")), ["work", "opf"], "left")


def manifest(files: DataFrame) -> DataFrame:
    """work, opf, id, href, path."""
    tags = F.explode(F.regexp_extract_all("xml", F.lit(r"(<item\b[^>]*>)"), F.lit(1)))
    each = files.select("work", "opf", tags.alias("tag")).select("work", "opf", attribute(F.col("tag"), "id").alias("id"), attribute(F.col("tag"), "href").alias("href"))
    return each.withColumn("path", resolved(F.col("opf"), F.col("href")))


def spine(files: DataFrame, items: DataFrame) -> DataFrame:
    """work, id, linear, path (null where the manifest doesn't have the id)."""
    tags = F.explode(F.regexp_extract_all("xml", F.lit(r"(<itemref\b[^>]*>)"), F.lit(1)))
    each = files.select("work", tags.alias("tag")).select("work", attribute(F.col("tag"), "idref").alias("id"), (attribute(F.col("tag"), "linear") != "no").alias("linear"))
    return each.where("id <> ''").join(items.where("id <> ''").select("work", "id", "path").dropDuplicates(["work", "id"]), ["work", "id"], "left")


def navigation(members: DataFrame, projected: DataFrame | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Findings of the package file, the spine and the contents, and references (work, path, href, target, code) to look up."""
    named = package_files(members)
    files = named.where("xml is not null")
    items = manifest(files)
    order = spine(files, items)
    entries = members.select("work", "path", F.explode("listed").alias("href")).select("work", resolved(F.col("path"), F.col("href")).alias("path"), F.lit(True).alias("listed")).distinct()
    inside = order.groupBy("work", "path").agg(F.bool_and("linear").alias("linear"), F.first("id").alias("id"), F.lit(True).alias("placed"))
    both = inside.join(entries, ["work", "path"], "full_outer")
    own = F.col("path").endswith("nav.xhtml") | F.col("path").endswith("landmarks.xhtml")
    left_out = F.col("placed") & F.col("path").isNotNull() & F.col("linear") & ~own & F.col("listed").isNull()
    out = []
    if projected is not None:  # work, name: documents that the navigation's depth leaves out
        both = both.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).join(projected.withColumn("projected", F.lit(True)), ["work", "name"], "full_outer")
        left_out = left_out & F.col("projected").isNull()
        out.append(found(both.where("projected and placed is null"), "E_TOC_COVERAGE", "name", "projected"))
    out.append(one_of(both, (left_out, "E_TOC_COVERAGE", F.col("path"), "not listed"), (F.col("listed") & F.col("placed").isNull(), "E_TOC_COVERAGE", F.col("path"), "not in the spine"), (F.col("placed") & F.col("path").isNull(), "E_SPINE_REF", F.lit(None), F.col("id"))))
    known = items.where("id <> ''").groupBy("work").agg(F.collect_set("id").alias("ids"))
    cover = named.join(known, "work", "left").withColumn("told", F.contains("xml", F.lit('properties="cover-image"'))).withColumn("cover", F.regexp_extract("xml", '<meta name="cover" content="([^"]+)"', 1))
    missing = F.array_compact(F.array(*[F.when(~F.col("xml").rlike(rf"<{x}(?:\s[^>]*)?>\s*\S[^<]*</{x}>"), x) for x in ("dc:creator", "dc:date", "dc:publisher", "dc:rights")]))
    opf, told, meta = F.col("opf"), F.col("told"), F.col("cover") != ""
    out.append(one_of(
        cover, (opf == "", "E_CONTAINER_OPF", CONTAINER, ""), ((opf != "") & F.col("xml").isNull(), "E_OPF_MISSING", opf, ""), (told & ~meta, "E_COVER_META", opf, "meta missing"), (~told & meta, "E_COVER_META", opf, "property missing"),
        (told & meta & ~F.array_contains("ids", F.col("cover")), "E_COVER_META", opf, F.concat(F.lit("unknown "), F.col("cover"))), (F.size(missing) > 0, "W_META_INCOMPLETE", opf, F.array_join(missing, ",")), (F.col("xml").rlike(r'(?i)href="\s*(?:javascript|data):'), "E_UNSAFE_URL", opf, ""),
    ))
    links = members.select("work", "path", F.explode("links").alias("l")).select("work", "path", "l.href", "l.code")
    links = links.select("work", "path", "href", resolved(F.col("path"), F.col("href")).alias("target"), "code")
    return out, [items.where("href <> ''").select("work", F.col("opf").alias("path"), "href", F.col("path").alias("target"), F.lit("E_MANIFEST_HREF").alias("code")), links]


#: Rules of the theme: a member's style sheet leaves fonts, colours and other files to the reader.
STYLE_RULES = (("E_THEME_FONT", "family", r"font-family\s*:[^;}]*[\"']"), ("E_THEME_FONT", "size", r"\bfont-size\s*:"), ("E_THEME_COLOR", "color", r"(?<![-\w])color\s*:"), ("E_THEME_EXTERNAL", "external", r"(?i)@import\b|url\s*\("))


def told(test: Column, code: str | Column, detail: str | Column = "") -> Column:
    """A finding of one document by itself, or null."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(test, F.struct(text(code).alias("code"), text(detail).cast("string").alias("detail")))


def style_rules(css: Column) -> list[Column]:
    bare = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")
    return [told(bare.rlike(pattern), code, detail) for code, detail, pattern in STYLE_RULES]


def worded(x: Column) -> Column:
    """The fault of a caption or alternative text, as a code or null."""
    name = t.caption_is_filename(x)
    return F.when(name, "E_CAPTION_FILENAME").when((x != "") & t.caption_is_placeholder(x), "E_CAPTION_PLACEHOLDER")


def image_tags(html: Column) -> Column:
    """at, img, alt and href of each picture."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:img|image)\b[^>]*>)"), F.lit(1))

    def read(tag, at):
        img = F.lower(F.substr(tag, F.lit(1), F.lit(4))) == "<img"
        href = F.when(img, attribute(tag, "src")).otherwise(F.regexp_extract(tag, r'\b(?:xlink:)?href="([^"]*)"', 1))
        return F.struct(at.alias("at"), img.alias("img"), F.trim(attribute(tag, "alt")).alias("alt"), href.alias("href"), href.rlike(REMOTE).alias("remote"))

    return F.transform(tags, read)


def images(members: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Findings of pictures, and the references to look up."""
    used = members.select("work", "path", "nav", F.explode("tags").alias("t")).select("work", "path", "nav", "t.*")
    local = used.where("href <> '' and not remote").select("work", "path", "href", resolved(F.col("path"), F.col("href")).alias("target"), "img", F.lit("E_IMG_SRC").alias("code"))
    pairs = local.groupBy("work", "path", "href", "target").agg(F.count("*").alias("n"), F.bool_or("img").alias("img")).where("img")
    media = members.where("digest is not null").select("work", F.col("path").alias("target"), "digest", F.col("pixels").alias("size"))
    shown = pairs.join(media, ["work", "target"])
    each = shown.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    wide, high = F.col("size.width"), F.col("size.height")
    ratio = F.greatest(wide, high) / F.greatest(F.least(wide, high), F.lit(1))
    again = shown.groupBy("work", "digest").agg(F.sum("n").alias("n"), F.min("target").alias("target")).where("n > 1")
    img, fault = F.col("img"), worded(F.col("alt"))
    return [
        one_of(used, (F.col("remote") & (F.col("href") != ""), "E_IMG_REMOTE", F.col("path"), F.col("href")), (img & (F.col("alt") == ""), "W_IMG_NO_ALT", F.col("path"), F.col("at"))),
        found(used.withColumn("fault", fault).where("img and not nav and fault is not null"), F.col("fault"), detail=F.col("alt")),
        one_of(each, (F.col("target").rlike(r"(?i)\.(?:avif|webp)$"), "W_IMG_FORMAT", F.col("path"), F.col("href")), (wide > WIDE, "W_IMG_LARGE", F.col("path"), F.col("href")), (ratio > SLIM, "W_IMG_RATIO", F.col("path"), F.col("href"))),
        found(again, "W_IMAGE_DUPLICATE", "target", F.col("n")),
    ], [local.select("work", "path", "href", "target", "code")]


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(pre|code)\b[^>]*>.*?</\1\s*>", "")


def text_rules(html: Column) -> list[Column]:
    """Rules over one document's text: language, headings, residue, layout, stops."""
    prose = without_code(html)
    bare = F.regexp_replace(prose, "<[^>]+>", "")
    leftover = F.coalesce(*[F.when(prose.rlike(pattern), label) for label, pattern in RESIDUE])
    dollars = F.when(bare.rlike(r"(?<!\$)\$\$(?!\$)"), "$$").when(bare.rlike(r"(?m)^[ \t]*\$[ \t]*$"), "$")
    marked = udfs.cell_mark(F.when(html.rlike("(?i)<t[dh]"), html))
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda x: t.stripped(F.regexp_replace(x, "<[^>]+>", "")))
    spaced = F.filter(paragraphs, lambda x: F.regexp_count(x, F.lit(rf"{HAN}[ \u3000]{HAN}")) >= 2)
    cut = F.filter(paragraphs, lambda x: (F.char_length(x) >= 20) & F.right(x, F.lit(1)).rlike(rf"{HAN}|[，、；,]") & ~F.right(x, F.lit(1)).isin(*PARAGRAPH_ENDS))
    in_phrase = F.regexp_replace(html, "<[^>]+>", "").rlike(rf"{HAN}\s\d{{1,3}}\s(?![{COUNTERS}]){HAN}")
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))
    skips = F.filter(F.transform(F.arrays_zip(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, 2, F.size(levels)).alias("b")), lambda x: F.when(x["b"] > x["a"] + 1, F.concat_ws(">", x["a"].cast("string"), x["b"].cast("string")))), lambda x: x.isNotNull())
    stops = F.regexp_extract(F.regexp_replace(F.regexp_replace(prose, r"(?is)<(script|style|head|blockquote)\b.*?</\1\s*>", ""), "<[^>]+>", ""), r"(。\s*\.|\.\s*。)", 1)
    own = F.regexp_replace(html, r"<!--\s*fingerprint:\s*\{[^{}]*\}\s*-->", "")
    heads = F.regexp_count(html, F.lit(r"(?i)<h1\b"))
    labels = F.regexp_extract_all(html, F.lit(r"(?is)<figure\b(?:(?!</figure).)*?<figcaption\b[^>]*>(.*?)</figcaption>"), F.lit(1))
    labels = F.when(F.contains(html, F.lit("<figcaption")), F.transform(labels, lambda x: t.stripped(F.regexp_replace(x, "<[^>]*>", "")))).otherwise(F.array().cast("array<string>"))
    faults = F.transform(labels, lambda x: told(worded(x).isNotNull(), worded(x), x))
    rules = F.array(
        told(~F.contains(html, F.lit("lang=")), "W_NO_LANG"), told(heads != 1, "W_H1_COUNT", heads), told(html.rlike(r'(?i)href="\s*(?:javascript|data):'), "E_UNSAFE_URL"), told(F.size(skips) > 0, "E_HEADING_SKIP", F.try_element_at(skips, F.lit(1))),
        told(F.contains(own, F.lit("<!--")), "E_RESIDUE", "comment"), told(leftover.isNotNull(), "W_RESIDUE", leftover), told(dollars.isNotNull(), "W_RESIDUE", dollars), told(marked.isNotNull(), "W_CELL_ATX", marked), told(F.size(spaced) > 0, "W_CJK_SPACED"),
        told(F.size(cut) > 0, "W_PARA_UNCLOSED", F.right(F.try_element_at(cut, F.lit(1)), F.lit(1))), told(in_phrase, "W_NOTE_IN_PHRASE"), told(stops != "", "W_PUNCT_MIXED", F.regexp_replace(stops, r"\s+", "")),
    )
    return F.concat(rules, faults)


def aside_notes(html: Column) -> Column:
    """note and backs, the hrefs of its ways back, of each note that has an id."""
    asides = F.regexp_extract_all(html, F.lit(r'(?s)(<aside[^>]*epub:type="footnote"[^>]*id="[^"]+"[^>]*>.*?</aside>)'), F.lit(1))
    return F.transform(asides, lambda x: F.struct(attribute(F.regexp_extract(x, "^(<[^>]*>)", 1), "id").alias("note"), F.regexp_extract_all(x, F.lit(r'<a\b[^>]*epub:type="backlink"[^>]*href="([^"]+)"'), F.lit(1)).alias("backs")))


def noted_texts(html: Column) -> Column:
    """at, strong and n of the paragraphs and list items that look like notes: by a mark, or by a number that may count with others."""
    plain = F.regexp_replace(without_code(html), r"(?is)<aside\b[^>]*>.*?</aside>", "")
    said = [F.regexp_extract_all(plain, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)) for tag in ("p", "li")]
    texts = F.array_distinct(F.filter(F.transform(F.concat(*said), lambda x: t.stripped(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != ""))
    each = F.transform(texts, lambda x, at: F.struct(at.alias("at"), x.rlike(MARKED_NOTE).alias("strong"), F.regexp_extract(x, NUMBERED_NOTE, 1).try_cast("int").alias("n")))
    return F.filter(each, lambda x: x["strong"] | x["n"].isNotNull())


OPAQUE = r"(?i)\.(?:png|jpe?g|gif|bmp|webp|avif|ttf|otf|woff2?|mp3|m4a|mp4|ogg|webm)$"


def events(members: DataFrame, *, every_region: bool = False) -> DataFrame:
    """A row of each member with what the rules read of its body; the body itself is read here alone.

    text (of members that are neither documents nor media), nav, rules (findings by itself), tags, ids, inner, links, listed,
    asides, noted, regions (of collected notes; of all documents with ``every_region``), digest and pixels of pictures."""
    path, body = F.col("path"), F.col("body")
    doc, nav = path.endswith(".xhtml"), path.endswith("nav.xhtml") | path.endswith("landmarks.xhtml")
    text = body.cast("string")
    df = members.select("work", "ord", "path", "stored", "size", nav.alias("nav"), F.when(doc, text).alias("html"), F.when(~doc & ~path.rlike(OPAQUE), text).alias("text"), F.when(path.rlike(MEDIA), body).alias("picture"))
    html = F.col("html")
    hrefs = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    coded = lambda of, pattern, code: F.transform(hrefs(of, pattern), lambda x: F.struct(x.alias("href"), F.lit(code).alias("code")))
    toc = F.regexp_extract(html, r'(?s)<nav[^>]*epub:type="toc"[^>]*>(.*?)</nav>', 1)
    toc = F.when(toc != "", toc).otherwise(F.regexp_extract(html, r"(?s)<nav\b[^>]*>(.*?)</nav>", 1))
    links = F.when(path.endswith("nav.xhtml"), coded(html, r'href="([^"]+\.xhtml)"', "E_NAV_HREF")).when(path.endswith("landmarks.xhtml"), coded(html, r'href="([^"]+\.xhtml)"', "E_LANDMARKS_HREF")).when(path.like("%.ncx"), coded(F.col("text"), r'<content src="([^"]+)"', "E_NCX_HREF"))
    notes = html if every_region else F.when(html.rlike("(?:endnotes|footnotes|rearnotes)"), html)
    by_itself = F.array_compact(F.concat(F.when(~nav, text_rules(html)).otherwise(F.array()), F.array(told(~well_formed(html), "E_XHTML_XML"))))
    return df.select(
        "work", "ord", "path", "stored", "size", "nav", "text", F.when(html.isNotNull(), by_itself).when(path == STYLE, F.array_compact(F.array(*style_rules(F.col("text"))))).alias("rules"), image_tags(html).alias("tags"),
        F.array_distinct(hrefs(html, r'\bid="([^"]+)"')).alias("ids"), hrefs(html, r'href="#([^"]+)"').alias("inner"), links.alias("links"), F.when(path.endswith("nav.xhtml"), hrefs(toc, r'href="([^"]+\.xhtml)[^"]*"')).alias("listed"),
        aside_notes(html).alias("asides"), F.when(~nav, noted_texts(html)).alias("noted"), regions_of(notes).alias("regions"), F.sha2("picture", 256).alias("digest"), F.when(F.col("picture").isNotNull(), udfs.image_size(F.substr("picture", F.lit(1), F.lit(65536)))).alias("pixels"),
    )


def note_findings(docs: DataFrame, registered: bool) -> list[DataFrame]:
    """Anchors, notes without meaning and their ways back; with ``registered`` notes another gate answers for these."""
    ids = docs.select("work", "path", F.explode("ids").alias("id"))
    inner = docs.select("work", "path", F.explode("inner").alias("id"))
    out = [found(inner.join(ids, ["work", "path", "id"], "left_anti"), "E_ANCHOR", detail=F.col("id"))]
    asides = docs.select("work", "path", F.explode("asides").alias("a")).select("work", "path", "a.note", "a.backs")
    backs = asides.select("work", "path", "note", F.explode("backs").alias("href"))
    file, frag = F.regexp_extract("href", "^([^#]*)", 1), F.regexp_extract("href", "#(.*)$", 1)
    target = F.when(file == "", F.col("path")).when(file.startswith("OEBPS/"), file).otherwise(F.concat(F.lit("OEBPS/"), file))
    lost = backs.withColumn("to", target).withColumn("id", frag).join(ids.withColumnRenamed("path", "to"), ["work", "to", "id"], "left_anti")
    out.append(found(lost.dropDuplicates(["work", "path", "note"]), "E_FN_BACKLINK", detail=F.col("note")))
    if registered:
        return out
    out.append(found(asides.where("size(backs) = 0"), "E_FN_BACKLINK", detail=F.col("note")))
    each = docs.select("work", "path", F.explode("noted").alias("x")).select("work", "path", "x.*")
    # a run counts 1, 2, ... on following paragraphs: what stays the same is the number less the place
    runs = each.where("n is not null").groupBy("work", "path", (F.col("at") - F.col("n")).alias("run")).agg(F.min("n").alias("first"), F.count("*").alias("size")).where("first = 1 and size >= 2")
    counts = each.where("strong").groupBy("work").agg(F.count("*").alias("strong"), F.lit(None).cast("long").alias("weak")).union(runs.groupBy("work").agg(F.lit(None).cast("long"), F.sum("size")))
    counts = counts.groupBy("work").agg(F.max("strong").alias("strong"), F.max("weak").alias("weak"))
    nowhere = F.lit(None)
    out.append(one_of(counts, (F.col("strong").isNotNull(), "E_FOOTNOTES_NOT_SEMANTIC", nowhere, F.col("strong")), (F.col("strong").isNull(), "W_FOOTNOTES_AMBIGUOUS", nowhere, F.col("weak"))))
    return out


NOTE_NUMBER = re.compile(r"(?<![\w.])[0-9]{1,3}\.\s")
COLLECTIONS = {"endnotes", "footnotes", "rearnotes", "doc-endnotes", "doc-footnotes"}
SINGLE = {"footnote", "endnote", "rearnote", "doc-footnote", "doc-endnote"}
LONG_NOTES, MANY_NOTES, NOTES_A_BLOCK = 1000, 8, 4


def note_regions(markup: str, whole: bool) -> list[list[str]]:
    """Texts of the innermost paragraphs and list items of each collection of notes, outside code and single notes; ``whole``: the document is one collection."""
    regions: list[list[str]] = []

    def kinds(element) -> set[str]:
        return set((element.get("{http://www.idpf.org/2007/ops}type") or "").split()) | set((element.get("role") or "").split())

    def words(element) -> str:
        own = "" if element.tag.rpartition("}")[2] in ("code", "pre", "script", "style") else (element.text or "") + "".join(words(x) + (x.tail or "") for x in element)
        return own

    def walk(element, into):
        name = element.tag.rpartition("}")[2]
        if into is None and COLLECTIONS & kinds(element):
            into = []
            regions.append(into)
        if name in ("pre", "code") or into is not None and SINGLE & kinds(element):
            return
        holds = any(x is not element and x.tag.rpartition("}")[2] in ("p", "li") for x in element.iter())
        if into is not None and (name == "p" or name == "li" and not holds) and words(element).strip():
            into.append(words(element).strip())
        for child in element:
            walk(child, into)

    root = ET.fromstring(markup)
    if whole:
        regions.append([])
    walk(root, regions[0] if whole else None)
    return [r for r in regions if r]


REGION = T.ArrayType(T.ArrayType(T.StructType().add("numbers", T.LongType()).add("chars", T.LongType())))


@F.arrow_udf(T.StructType().add("marked", REGION).add("whole", REGION))
def regions_of(html: pa.Array) -> pa.Array:
    """Numbers and characters of each block of the collections of notes: of the marked ones, and with the document as one. Null for markup that can't be read."""

    def sizes(x: str, whole: bool):
        return [[{"numbers": len(NOTE_NUMBER.findall(block)), "chars": len(block)} for block in region] for region in note_regions(x, whole)]

    def one(x: str | None):
        try:
            return None if x is None else {"marked": sizes(x, False), "whole": sizes(x, True)}
        except ET.ParseError:
            return None

    block = pa.list_(pa.list_(pa.struct([("numbers", pa.int64()), ("chars", pa.int64())])))
    return pa.array([one(x) for x in html.to_pylist()], pa.struct([("marked", block), ("whole", block)]))


def collected_notes(docs: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """W_COLLECTED_NOTES_UNSEGMENTED: blocks of collected notes that hold several numbered notes and are long, or where the source has far more notes than there are blocks. Docs: work, path, regions (see ``regions_of``). Contexts: work, path, kind, n_source (notes of its Markdown)."""
    docs = docs.where("regions is not null").select("work", "path", "regions")
    if contexts is None:
        docs = docs.withColumn("kind", F.lit(None).cast("string")).withColumn("n_source", F.lit(None).cast("long"))
    else:
        docs = docs.join(contexts.select("work", "path", "kind", "n_source"), ["work", "path"], "left")
    notes = F.coalesce(F.col("kind") == "notes", F.lit(False))
    each = docs.select("work", "path", "n_source", notes.alias("notes"), F.explode(F.when(notes, F.col("regions.whole")).otherwise(F.col("regions.marked"))).alias("region"))
    few = F.col("notes") & F.coalesce(F.col("n_source") >= F.greatest(F.lit(MANY_NOTES), NOTES_A_BLOCK * F.size("region")), F.lit(False))
    suspect = F.filter(F.transform("region", lambda x, i: F.when((x["numbers"] >= 2) & (F.col("few") | (x["chars"] >= LONG_NOTES)), (i + 1).cast("string"))), lambda x: x.isNotNull())
    return found(each.withColumn("few", few).withColumn("suspect", suspect).where("size(suspect) > 0"), "W_COLLECTED_NOTES_UNSEGMENTED", detail=F.array_join("suspect", ","))


def audit(members: DataFrame, *, projected: DataFrame | None = None, contexts: DataFrame | None = None, notes_registered: bool = False) -> DataFrame:
    """Every finding of every package. A package without a container has only the findings of its container."""
    read = written(events(members, every_region=contexts is not None), "audit-events")
    seen_nav, refs = navigation(read, projected)
    seen, used = images(read)
    paths = read.select("work", F.col("path").alias("target")).distinct()
    lost = reduce(DataFrame.union, refs + used).join(paths, ["work", "target"], "left_anti")
    own = read.select("work", "path", F.explode("rules").alias("f")).select("work", "f.code", "path", "f.detail")
    rest = reduce(DataFrame.union, [own, *seen_nav, *seen, found(lost, F.col("code"), detail=F.col("href")), *note_findings(read, notes_registered), collected_notes(read, contexts)])
    with_container = read.where(F.col("path") == CONTAINER).select("work").distinct()
    return reduce(DataFrame.union, [*container_findings(read), rest.join(with_container, "work", "left_semi")])


def verdicts(findings: DataFrame, works: DataFrame) -> DataFrame:
    """work, ok, errors, warnings: a package passes without errors."""
    told = works.join(findings, "work", "left").groupBy("work").agg(F.count_if(F.col("code").startswith("E_")).alias("errors"), F.count_if(F.col("code").startswith("W_")).alias("warnings"))
    return told.select("work", (F.col("errors") == 0).alias("ok"), "errors", "warnings")


#: Properties a work's own style may set, and what no value may hold.
STYLE_PROPERTIES = (
    "text-indent", "margin", "margin-top", "margin-right", "margin-bottom", "margin-left", "padding", "padding-top", "padding-right", "padding-bottom", "padding-left", "line-height", "text-align", "letter-spacing", "word-spacing",
    "font-weight", "font-style", "hyphens", "text-transform", "white-space", "orphans", "widows", "page-break-before", "page-break-after", "page-break-inside", "break-before", "break-after", "break-inside",
)
STYLE_DENIED = r"url\(|expression\(|javascript:|<|>"


def style_violation(css: Column) -> Column:
    """The first thing wrong with a work's own style, or null: braces, at, selector, colon, property, value or rules."""
    bare = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")
    rules = F.regexp_extract_all(bare, F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))
    lines = F.filter(F.flatten(F.transform(rules, lambda r: F.split(F.regexp_extract(r, r"(?s)\{(.*)\}", 1), ";"))), lambda x: t.stripped(x) != "")
    prop = lambda x: F.lower(t.stripped(F.substring_index(x, ":", 1)))
    count = lambda x, mark: t.count_char(x, mark)
    return (
        F.when(count(css, "{") != count(css, "}"), "braces").when(F.contains(bare, F.lit("@")), "at").when(F.exists(rules, lambda r: t.stripped(F.substring_index(r, "{", 1)) == ""), "selector")
        .when(F.exists(lines, lambda x: ~x.contains(":")), "colon").when(F.exists(lines, lambda x: ~prop(x).isin(*STYLE_PROPERTIES)), "property").when(F.exists(lines, lambda x: F.lower(x).rlike(STYLE_DENIED)), "value")
        .when((t.stripped(bare) != "") & (F.size(rules) == 0), "rules").when(count(bare, "{") != F.size(rules), "rules")
    )
