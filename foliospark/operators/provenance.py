"""Where a package's contents come from: units against the spine, their documents, their rows and their inserted pieces.

Tables (other columns are ignored): units (work, unit, pos, kind, source_md: null where the source is gone, target_md: null
where there is none), spine (work, unit, place), docs (work, unit, html), rows (work, unit, pos, tgt), nav (work, place,
depth), depths (work, place, depth: what the units' headings ask for), covers (work: packages that declare one), inserts
(work, id, missing: is its file gone?, page, bbox, content_desc, type, latex).

A finding is (work, code, unit, detail). A unit's Markdown is its target's, else its source's; units whose Markdown is
blank aren't expected in the package. Everything about one unit is one row of a join on (work, unit); only the order of a
work's units, which are numbers, is looked at as a whole.
"""

from __future__ import annotations

import bisect
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text as t
from foliospark.functions import udfs
from foliospark.operators.evidence import media_refs
from foliospark.operators.notes_audit import printed_html, printed_markdown
from foliospark.session import written

KEY = ["work", "unit"]
# Fixed forms: definitions and marks of notes, and what of a document isn't its prose.
DEFINITION = r"(?m)^\s*\[\^[^\]]+\]:"
MARK = re.compile(r"\[\^[^\]]+\]")
UNSAID = re.compile(r"""(?is)<(head|script|style)\b.*?</\1\s*>|<aside\b[^>]*epub:type="[^"]*\bfootnote\b[^>]*>.*?</aside>|<a\b[^>]*epub:type="[^"]*\bnoteref\b[^>]*>.*?</a>""")
FOOTNOTE = r'(?i)<aside\b[^>]*epub:type="[^"]*\bfootnote\b'
SOURCES = r'(?i)<(?:img|image)\b[^>]*?\b(?:src|href)="([^"]+)"'


def probes_of(md: str | None) -> list[tuple[str, str]]:
    """(head, text without blanks) of each paragraph that a document must show; definitions of notes are shown elsewhere."""
    out = []
    for kind, block in udfs.content_blocks(md):
        if kind == "text" and not re.match(r"\[\^[^\]]+\]:", block):
            if shown := printed_markdown(MARK.sub("", block)):
                out.append((block[:40], shown))
    return out


@F.arrow_udf(T.ArrayType(T.StructType().add("head", T.StringType()).add("probe", T.StringType())))
def probes(md: pa.Array) -> pa.Array:
    return pa.array([[{"head": a, "probe": b} for a, b in probes_of(x)] for x in md.to_pylist()], pa.list_(pa.struct([("head", pa.string()), ("probe", pa.string())])))


@F.arrow_udf(T.StringType())
def prose_of(html: pa.Array) -> pa.Array:
    return pa.array([printed_html(UNSAID.sub("", x or "")) for x in html.to_pylist()], pa.string())


def longest_rise(values: list[int]) -> set[int]:
    """Places of a longest strictly rising subsequence, by the ends of the best one of each length."""
    ends, at, before = [], [], [-1] * len(values)
    for i, x in enumerate(values):
        k = bisect.bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    kept, i = set(), at[-1] if at else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return kept


def moved(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and ``name`` of the rows (keys, name, a, b) that must move so that b rises with a: those outside a longest rising subsequence. One moved row is one row here, however far it went. Only two numbers and a name of each row are in a group."""
    schema = placed.select(*keys, name).schema

    def run(key, table):
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        kept = longest_rise(table.column("b").to_pylist())
        return table.take(pa.array([i for i in range(table.num_rows) if i not in kept], pa.int64())).select([*keys, name])

    return placed.select(*keys, name, "a", "b").groupBy(*keys).applyInArrow(run, schema)


def finding(df: DataFrame, code: str, detail="", unit="unit") -> DataFrame:
    return df.select("work", F.lit(code).alias("code"), (F.col(unit) if unit else F.lit(None)).cast("string").alias("unit"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def expected_units(units: DataFrame) -> DataFrame:
    """work, unit, pos, kind, source_md, target_md, md of the units that the package must hold."""
    return units.where("source_md is not null").withColumn("md", F.coalesce("target_md", "source_md")).where(t.stripped(F.col("md")) != "")


def order_findings(expected: DataFrame, spine: DataFrame, generated: DataFrame | None) -> list[DataFrame]:
    """E_UNIT_MISSING, E_UNIT_ORDER. ``generated``: work, unit of pages that the builder adds."""
    known = expected.select(*KEY)
    strange = spine.join(known, KEY, "left_anti")
    if generated is not None:
        strange = strange.join(generated, KEY, "left_anti")
    both = expected.select(*KEY, F.col("pos").alias("a")).join(spine.select(*KEY, F.col("place").alias("b")), KEY)
    return [finding(known.join(spine, KEY, "left_anti"), "E_UNIT_MISSING"), finding(strange, "E_UNIT_ORDER", "unknown"), finding(moved(both, ["work"], "unit"), "E_UNIT_ORDER", "moved")]


def media_findings(expected: DataFrame, docs: DataFrame) -> list[DataFrame]:
    """E_MEDIA_LOST, E_MEDIA_ORDER of targets against sources, E_MEDIA_EPUB_LOST of documents against their Markdown."""
    translated = F.col("target_md").isNotNull()
    # both sides' Markdown is read once: how often each name comes in it, and where it comes first
    sides = {"s": F.col("source_md"), "t": F.col("target_md")}
    each = reduce(DataFrame.union, [expected.where(F.lit(True) if side == "s" else translated).select(F.struct(*KEY, F.lit(side).alias("side"), translated.alias("translated")).alias("unit"), md.alias("md")) for side, md in sides.items()])
    refs = media_refs(each).select("unit.*", "ref", "place").groupBy(*KEY, "translated", "ref").agg(*[f(F.when(F.col("side") == side, F.col("place"))).alias(name) for side, f, name in (("s", F.count, "n"), ("t", F.count, "m"), ("s", F.min, "a"), ("t", F.min, "b"))])
    refs = written(refs, "media")
    lost = refs.where("translated and m < n")
    # media that either side has: the one's order against the other's, by the first place of each name
    out_of_order = moved(refs.where("translated and a is not null and b is not null"), KEY, "ref")
    shown = docs.select(*KEY, F.explode(F.regexp_extract_all("html", F.lit(SOURCES), F.lit(1))).alias("ref")).groupBy(*KEY, "ref").agg(F.count("*").alias("seen"))
    due = refs.select(*KEY, "ref", F.when(F.col("translated"), F.col("m")).otherwise(F.col("n")).alias("due")).where("due > 0").join(docs.select(*KEY).distinct(), KEY, "left_semi")
    return [finding(lost, "E_MEDIA_LOST", F.col("ref")), finding(out_of_order, "E_MEDIA_ORDER", F.col("ref")), finding(due.join(shown, [*KEY, "ref"], "left").where("coalesce(seen, 0) < due"), "E_MEDIA_EPUB_LOST", F.col("ref"))]


def text_findings(expected: DataFrame, docs: DataFrame, rows: DataFrame, notes_registered: bool) -> list[DataFrame]:
    """E_EPUB_PARA_LOST, E_FN_EPUB_LOST of documents; E_ALIGN_MD_DRIFT of targets against their rows, both ways."""
    pairs = expected.select(*KEY, "md").join(docs.select(*KEY, "html"), KEY)
    told = pairs.select(*KEY, probes("md").alias("probes"), prose_of("html").alias("prose"))
    gone = told.select(*KEY, F.explode(F.filter("probes", lambda p: ~F.contains(F.col("prose"), p["probe"]))).alias("p"))
    out = [finding(gone, "E_EPUB_PARA_LOST", F.col("p.head"))]
    if not notes_registered:
        text = F.array_join(F.transform(F.filter(udfs.chunks("md"), lambda c: c["kind"] == "text"), lambda c: F.regexp_replace(c["chunk"], r"(`+)[^`]*\1", "x")), "\n")
        notes = pairs.select(*KEY, F.regexp_count(text, F.lit(DEFINITION)).alias("n"), F.regexp_count("html", F.lit(FOOTNOTE)).alias("m")).where("n <> m")
        out.append(finding(notes, "E_FN_EPUB_LOST", F.concat_ws("/", F.col("n").cast("string"), F.col("m").cast("string"))))
    said = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", t.without_blanks(t.text_of("tgt")).alias("x")))).alias("said"))
    both = expected.where("target_md is not null").select(*KEY, "target_md").join(said, KEY)
    blocks = F.transform(F.filter(udfs.blocks("target_md"), lambda b: b["kind"] == "text"), lambda b: t.without_blanks(b["block"]))
    both = both.select(*KEY, "said", blocks.alias("blocks"), F.array_join(F.transform("said", lambda x: x["x"]), "").alias("rows_body"), t.without_blanks(F.col("target_md")).alias("body"))
    unsaid = F.transform(F.filter("blocks", lambda b: ~F.contains(F.col("rows_body"), b) & ~b.rlike(r"^!\[|^\[\^[^\]]+\]:")), lambda b: F.concat(F.lit("block "), F.left(b, F.lit(24))))
    unwritten = F.transform(F.filter("said", lambda x: ~F.contains(F.col("body"), x["x"])), lambda x: F.concat(F.lit("row "), x["pos"].cast("string")))
    out.append(finding(both.select(*KEY, F.explode(F.concat(unsaid, unwritten)).alias("d")), "E_ALIGN_MD_DRIFT", F.col("d")))
    return out


def depth_findings(nav: DataFrame, depths: DataFrame) -> list[DataFrame]:
    """E_TOC_FLAT: headings have levels, the contents have one; W_TOC_DEPTH: another sequence of depths."""
    line = lambda df, name: df.groupBy("work").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "depth"))), lambda x: x["depth"]).alias(name))
    both = line(depths, "want").join(line(nav, "have"), "work", "left")
    flat = (F.array_max("want") > 1) & F.coalesce(F.array_max("have") == 1, F.lit(True))
    return [finding(both.where(flat), "E_TOC_FLAT", unit=""), finding(both.where(~flat & F.col("have").isNotNull() & (F.col("want") != F.col("have"))), "W_TOC_DEPTH", unit="")]


def insert_findings(inserts: DataFrame) -> DataFrame:
    """E_INSERT_MISSING_FILE, E_INSERT_BAD_SOURCE (a page under 1 or a box that isn't four finite numbers), W_INSERT_NO_DESC, W_INSERT_NO_LATEX (of formulas)."""
    blank = lambda c: t.stripped(F.coalesce(c, F.lit(""))) == ""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    bad = F.coalesce(F.col("page") < 1, F.lit(True)) | F.col("bbox").isNotNull() & ((F.size("bbox") != 4) | F.exists("bbox", lambda v: ~finite(v)))
    codes = F.array_compact(F.array(F.when(F.col("missing"), "E_INSERT_MISSING_FILE"), F.when(bad, "E_INSERT_BAD_SOURCE"), F.when(blank("content_desc"), "W_INSERT_NO_DESC"), F.when((F.col("type") == "formula") & blank("latex"), "W_INSERT_NO_LATEX")))
    return inserts.select("work", F.explode(codes).alias("code"), F.lit(None).cast("string").alias("unit"), F.col("id").cast("string").alias("detail"))


def audited_provenance(units: DataFrame, spine: DataFrame, docs: DataFrame, rows: DataFrame, nav: DataFrame, depths: DataFrame, covers: DataFrame, inserts: DataFrame, *, generated: DataFrame | None = None, notes_registered: bool = False) -> DataFrame:
    """Every finding of every work; see the head of this module."""
    expected = expected_units(units)
    bare = expected.where("kind = 'cover'").select("work").distinct().join(covers, "work", "left_anti")
    parts = [
        finding(units.where("source_md is null"), "W_STRUCT_MISSING"), finding(bare, "W_NO_COVER", unit=""), *order_findings(expected, spine, generated), *media_findings(expected, docs),
        *text_findings(expected, docs, rows, notes_registered), *depth_findings(nav, depths), insert_findings(inserts),
    ]
    return reduce(DataFrame.union, parts)
