"""Pages and their parts: joins of evidence, contents models, sizes, notes in text, audits of single pages."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.functions import text as t
from foliospark.functions.udfs import cell_mark


def source_evidence(notes: DataFrame, blocks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """work, note_id, page, block: registered places (work, note_id, page, x0, y0) and the blocks of that page that start there, within a tolerance.

    A grid join: blocks lie in cells as wide as the tolerance, and a place looks into its own cell and the eight around it,
    so that a page with very many blocks isn't paired with itself."""
    cell = lambda x: F.floor(F.col(x) / tolerance)
    b = blocks.select("work", "page", "block", F.col("x0").alias("bx"), F.col("y0").alias("by"), cell("x0").alias("cx"), cell("y0").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    looks = notes.select("work", "note_id", "page", "x0", "y0", F.explode(steps).alias("s")).withColumn("cx", cell("x0") + F.col("s.i")).withColumn("cy", cell("y0") + F.col("s.j"))
    near = (F.abs(F.col("x0") - F.col("bx")) <= tolerance) & (F.abs(F.col("y0") - F.col("by")) <= tolerance)
    return looks.join(b, ["work", "page", "cx", "cy"]).where(near).select("work", "note_id", "page", "block")


def index_page_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """work, label, page, line: index entries found again on index pages; a page is one when its head says so or most of its lines end in numbers."""
    w = Window.partitionBy("work", "page")
    l = lines.withColumn("dense", F.avg(F.col("text").rlike(r",?\s*\d{1,4}\s*$").cast("double")).over(w)).withColumn("titled", F.max(((F.col("line") == 1) & F.lower(F.trim("text")).isin("index", "索引")).cast("int")).over(w))
    l = l.where("dense > 0.5 or titled = 1").withColumn("key", t.title_key(F.regexp_replace("text", r"[,\s\d–-]+$", "")))
    return entries.withColumn("key", t.title_key(F.col("label"))).join(l.select("work", "key", "page", "line"), ["work", "key"]).select("work", "label", "page", "line")


def contents_model(units: DataFrame, printed: DataFrame) -> DataFrame:
    """work, unit, level, status, line: units and anchors matched to the lines of the printed contents by label: exact, ambiguous or none."""
    p = printed.withColumn("key", t.title_key(F.col("label"))).groupBy("work", "key").agg(F.count("*").alias("hits"), F.min("line").alias("line"))
    u = units.withColumn("key", t.title_key(F.col("title"))).join(p, ["work", "key"], "left")
    return u.select("work", "unit", "level", F.when(F.col("hits") == 1, "exact").when(F.col("hits") > 1, "ambiguous").otherwise("none").alias("status"), F.when(F.col("hits") == 1, F.col("line")).alias("line"))


def registered_numbers(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """unit, numbers: the numeric labels of the notes that each unit refers to."""
    j = refs.join(notes, "note_id").where(F.col("source_label").rlike("^[0-9]+$")).select("unit", F.col("source_label").cast("long").alias("n")).distinct()
    return j.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x.cast("string")), ",").alias("numbers"))


def stem_units(sources: DataFrame) -> DataFrame:
    """work, stem, unit: the first unit of each stem of a work's source files."""
    return sources.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).groupBy("work", "stem").agg(F.min_by("unit", "ord").alias("unit"))


def rewritten_links(texts: DataFrame, units: DataFrame) -> DataFrame:
    """work, unit, place, href, target: internal links of texts, to the file of the unit that the linked file became, anchors kept; a link within its own unit is the anchor alone. Unknown files have no target."""
    links = F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    each = texts.select("work", "unit", F.posexplode(links).alias("place", "href")).where(~F.col("href").rlike("^(?:[a-z][a-z0-9+.-]*:|//)"))
    each = each.withColumn("stem", F.regexp_extract("href", r"([^/#]+?)(?:\.[^./#]*)?(?:#.*)?$", 1)).withColumn("anchor", F.regexp_extract("href", r"(#.*)$", 1))
    own = F.col("href").startswith("#")
    j = each.join(units.select("work", "stem", F.col("unit").alias("to")), ["work", "stem"], "left")
    target = F.when(own | (F.col("to") == F.col("unit")), F.when(F.col("anchor") != "", F.col("anchor")).otherwise(F.concat("to", F.lit(".xhtml")))).when(F.col("to").isNotNull(), F.concat("to", F.lit(".xhtml"), "anchor"))
    return j.select("work", "unit", F.col("place").cast("long").alias("place"), "href", target.alias("target"))


WORD = re.compile(r"\w+")
#: Missing blocks that a report names.
NAMED = 20


def consumed(needles: list[str], haystack: str) -> list[bool]:
    """Which texts are an ordered subsequence of the haystack's words, each after the words that the ones before it used up.

    A text takes the next occurrence of each of its words, by binary search in the places of that word; one that isn't
    found uses nothing up. Texts without words are found."""
    places: dict[str, list[int]] = {}
    for at, word in enumerate(WORD.findall(haystack)):
        places.setdefault(word, []).append(at)
    cursor, found = 0, []
    for needle in needles:
        at = cursor
        for word in WORD.findall(needle):
            there = places.get(word, ())
            i = bisect.bisect_left(there, at)
            if i == len(there):
                break
            at = there[i] + 1
        else:
            cursor = at
            found.append(True)
            continue
        found.append(False)
    return found


def compared_blocks(blocks: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """For each document (``keys``): headings, paragraphs, missing_count and missing, the first places (ord) of blocks whose words its text doesn't hold in order.

    ``blocks``: keys, ord, kind, body of a tree; ``texts``: keys, ord, text of the parts, in whose order they are read. Markup
    between words doesn't matter; a block that comes twice needs its words twice. A document without texts misses all
    blocks with words; one without blocks has no row. A task holds one document at a time."""
    schema = ", ".join([*(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys), "headings long, paragraphs long, missing_count long, missing array<bigint>"])

    def compare(key, left, right):
        tree = left.select(["ord", "kind", "body"]).sort_by("ord").to_pylist()
        if not tree:
            return pa.table({f.name: pa.array([], f.type) for f in shape})
        whole = "\n".join(x or "" for x in right.sort_by("place").column("text").to_pylist())
        tree = [x for x in tree if x["kind"] in ("heading", "paragraph", "code")]
        lost = [x["ord"] for x, ok in zip(tree, consumed([x["body"] or "" for x in tree], whole)) if not ok]
        count = lambda kind: sum(x["kind"] == kind for x in tree)
        row = [*(k.as_py() for k in key), count("heading"), count("paragraph"), len(lost), lost[:NAMED]]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(shape, row)})

    shape = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)
    # by other names: of two tables made from one, a cogroup loses the columns that both name alike
    parts = texts.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("ord").alias("place"), "text").groupBy(*[f"of_{k}" for k in keys])
    return blocks.select(*keys, "ord", "kind", "body").groupBy(*keys).cogroup(parts).applyInArrow(compare, schema)


def size_profile(segments: DataFrame) -> DataFrame:
    """work, page, median_size, usual_size: the median of the sizes, and the size of most characters, the smaller of two."""
    s, key = segments.where("size > 0"), ["work", "page"]
    mode = s.groupBy(*key, "size").agg(F.sum(F.char_length("text")).alias("chars")).groupBy(*key).agg(F.max_by("size", F.struct(F.col("chars"), -F.col("size"))).alias("usual_size"))
    return s.groupBy(*key).agg(F.median("size").alias("median_size")).join(mode, key)


def chapter_headings(segments: DataFrame) -> DataFrame:
    """work, page, line: short lines that open a chapter by word, or by a size of 1.3 times the page's median."""
    s = segments.join(size_profile(segments).select("work", "page", "median_size"), ["work", "page"])
    word = F.col("text").rlike(r"(?i)^\s*(?:chapter|part|book)\s+(?:\d+|[ivxlc]+)\b|^\s*第[一二三四五六七八九十百\d]+[章回部]")
    return s.where((F.char_length("text") <= 80) & (word | (F.col("size") >= F.col("median_size") * 1.3))).select("work", "page", "line")


def is_verse(block: Column) -> Column:
    """Quoted lines, two at least, short and without terminal marks."""
    lines = F.filter(F.transform(F.split(block, "\n"), t.stripped), lambda x: x != "")
    body = F.transform(lines, lambda x: F.regexp_replace(x, r"^[>\s]+", ""))
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith(">")) & F.forall(body, lambda x: (x != "") & (F.char_length(x) <= 40) & ~x.rlike(r"[。！？!?….”’」』）)》】〕\"']$"))


def is_empty_unit(md: Column, title: Column) -> Column:
    """No line of body, and a title that says nothing."""
    lines = F.filter(F.split(t.text_of(md), "\n"), lambda x: (t.stripped(x) != "") & ~x.rlike(r"^#{1,6}[ \t]"))
    return (F.size(lines) == 0) & F.lower(t.stripped(t.text_of(title))).isin("", "unknown", "untitled", "无标题")


def footnote_parts(lines: DataFrame) -> DataFrame:
    """unit, line, label: the note that a line belongs to: a definition line, or one set in below it; null for the body."""
    order = Window.partitionBy("unit").orderBy("line")
    label = F.nullif(F.regexp_extract("text", r"^\[\^([^\]\s]+)\]:", 1), F.lit(""))
    goes_on = F.col("text").rlike(r"^(?:\s{2,}|\t)\S") | (t.stripped(F.col("text")) == "")
    l = lines.withColumn("own", label).withColumn("breaks", (F.col("own").isNotNull() | ~goes_on).cast("int"))
    l = l.withColumn("run", F.sum("breaks").over(order))
    return l.select("unit", "line", F.max("own").over(Window.partitionBy("unit", "run")).alias("label"))


def nav_entries(html: DataFrame) -> DataFrame:
    """work, place, label, href, level: the entries of a navigation list, with their depth: lists opened less lists closed before them."""
    marks = F.regexp_extract_all("html", F.lit(r"(?is)(<ol\b|</ol\s*>|<a\b[^>]*>.*?</a\s*>)"), F.lit(1))
    e = html.select("work", F.posexplode(marks).alias("at", "m"))
    order = Window.partitionBy("work").orderBy("at")
    step = F.when(F.lower("m").startswith("<ol"), 1).when(F.lower("m").startswith("</ol"), -1).otherwise(0)
    e = e.withColumn("level", F.sum(step).over(order)).where(F.lower("m").startswith("<a"))
    label = F.trim(F.regexp_replace(F.regexp_replace("m", "<[^>]*>", ""), r"\s+", " "))
    return e.select("work", F.row_number().over(order).cast("long").alias("place"), label.alias("label"), F.regexp_extract("m", r"""(?i)href\s*=\s*["']([^"']*)""", 1).alias("href"), F.col("level"))


def note_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """unit, ord: paragraphs that look like notes without being marked so: after a number and a space, in a run from 1, or after a raised mark."""
    from foliospark.operators.structure import numbered_runs

    n = paragraphs.withColumn("n", F.regexp_extract("text", r"^(\d{1,3})[.\s]\s*\S", 1).try_cast("long"))
    runs = numbered_runs(n.where("n is not null").select("unit", "ord", "n")).select("unit", "ord")
    return runs.union(paragraphs.where(F.col("text").rlike(r"^\s*(?:[¹²³⁴-⁹]|[*†‡]\s)")).select("unit", "ord")).distinct()


def package_facts(members: DataFrame) -> DataFrame:
    """work, title, language, creator, n_media, protected: facts of a package by XPath over its package file, namespaces taken off."""
    xml = F.regexp_replace(F.regexp_replace("body", r"\sxmlns(?::\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    opf = members.where("path like '%.opf'").select("work", xml.alias("x"))
    facts = opf.select("work", *[F.trim(F.xpath_string("x", F.lit(f"//metadata/{k}"))).alias(k) for k in ("title", "language", "creator")])
    rest = members.groupBy("work").agg(F.count_if(F.col("path").rlike(r"(?i)\.(?:png|jpe?g|gif|svg|webp)$")).alias("n_media"), F.bool_or(F.col("path") == "META-INF/encryption.xml").alias("protected"))
    return facts.join(rest, "work")


def cell_marks(pages: DataFrame) -> DataFrame:
    """page_id, mark: heading marks left in table cells, the first of each page."""
    return pages.select("page_id", cell_mark("html").alias("mark")).where("mark is not null")


def mixed_stops(paragraphs: DataFrame, most: int = 100) -> DataFrame:
    """work, unit, ord, mark: the first place of each paragraph where a full stop of one script follows one of the other, of each work the first ``most`` in order: the length of its report."""
    each = paragraphs.select("work", "unit", "ord", F.regexp_extract("text", r"(。\s*\.|\.\s*。)", 1).alias("mark")).where("mark <> ''")
    n = F.row_number().over(Window.partitionBy("work").orderBy("unit", "ord"))
    return each.withColumn("n", n).where(F.col("n") <= most).select("work", "unit", "ord", "mark")


def lists_of_units(units: DataFrame) -> DataFrame:
    """work, units: works with several contents units, which are given in order."""
    g = units.where("kind = 'toc'").groupBy("work").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]), ",").alias("units"))
    return g.where("n > 1").select("work", "units")
