"""The audit of a package's notes against what is registered: a graph of anchors, asides and ways back.

Tables (other columns are ignored): works (work, inventory), refs (work, ref_id, note_id), notes (work, note_id,
source_markdown, orphan_ok), targets (work, note_id, target_markdown), members (work, path), docs (work, path, html: the
package's text documents), media (work, ref, member: where the sources' media references lead).

A finding is (work, code, ref, detail), always an error; ref is the reference or note that it is about. Documents are read
once, into a table of anchors and one of asides; an id that comes twice is a finding, and the last one in the order of
paths and places counts. Everything else is a join on ids inside a work.
"""

from __future__ import annotations

import html as markup
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import udfs
from foliospark.operators.audit import resolved
from foliospark.operators.evidence import media_refs

# Fixed forms: where notes are in the markup, and what of a note's Markdown isn't printed and what stays of it, in this order.
ANCHOR = r"(?i)(<a\b[^>]*>)"
ASIDE = r'(?is)(<aside\b[^>]*epub:type="footnote"[^>]*>.*?</aside>)'
IMAGE = r"(?i)(<(?:img|image)\b[^>]*>)"
FOLDER, FRAGMENT = "OEBPS/", "fn-"
PICTURE = r"!\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)"
UNPRINTED = (
    (r"(?m)^(#{1,6}[^\n]*?)\s*\{#[\w:.-]+\}\s*$", r"\1"), (r"\[\][ \t]*\{#?[\w:.-]+\}", ""), (r"\{[ \t]*\[[ \t]*\][ \t]*\}", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*((?:[^*]|\\\*)+)\*\*", r"\1"), (r"(?<!\*)\*([^*]+)\*(?!\*)", r"\1"),
    (PICTURE, ""), (r"(?i)<(?:img|image)\b[^>]*>|</?svg\b[^>]*>", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^<>\s]*|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>", r"\1"), (r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])", r"\1"),
)
CODE_SPAN = re.compile(r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
LISTED = re.compile(r"(\d+)([.)、])\s+(.*)")
# End of the fixed forms.


def printed_html(fragment: str) -> str:
    """What a piece of markup prints, without blanks."""
    return "".join(markup.unescape(re.sub("<[^>]+>", "", fragment)).split())


def without_marks(lines: list[str]) -> list[str]:
    """Lines of one quotation, table or list without the marks at their beginnings; of numbers only such as count 1, 2, 3."""
    for marks in (">", "|", "-*+"):
        if lines and all(len(x) > 1 and x[0] in marks and x[1].isspace() for x in lines):
            return [x[1:].lstrip() for x in lines]
    numbered = [LISTED.fullmatch(x) for x in lines]
    if lines and all(m and int(m[1]) == i and m[2] != ")" for i, m in enumerate(numbered, 1)):
        return [m[3] for m in numbered]
    return lines


def printed_markdown(md: str | None) -> str:
    """What a note's Markdown prints, without blanks: code as it stands, marks that come in pairs gone, labels of links and captions of lone pictures kept."""
    out = []
    for block in udfs.render_blocks_of(md):
        kind, chunk = udfs.markdown_chunks(block)[0]
        if kind != "text":
            inner = "\n".join(chunk.split("\n")[1:-1])
            out.append(printed_html(inner) if kind == "raw" else inner)
            continue
        lines = [x.strip() for x in chunk.split("\n") if x.strip()]
        plain = without_marks(lines)
        prose = "\n".join(plain) if plain is not lines else chunk
        at = 0
        for span in [*CODE_SPAN.finditer(prose), None]:
            text = prose[at : span.start() if span else len(prose)]
            text = "\n".join(m[1] if (m := re.fullmatch(PICTURE, x.strip())) else x for x in text.split("\n"))
            for form, kept in UNPRINTED:
                text = re.sub(form, kept, text)
            out.append(text)
            if span:
                out.append(span[2])
                at = span.end()
    return "".join("".join(out).split())


def printed_aside(inner: str) -> str:
    """What an aside prints, without blanks, its shown number and its ways back."""
    inner = re.sub(r"^\s*<p>\[\d+\]</p>", "", inner, count=1)
    back = re.compile(r"""epub:type\s*=\s*(["'])backlink\1""")
    return printed_html(re.sub(r"(?is)<a\b[^>]*>.*?</a>", lambda m: "" if back.search(m[0][: m[0].index(">")]) else m[0], inner))


@F.arrow_udf(T.StringType())
def note_text(md: pa.Array) -> pa.Array:
    return pa.array([printed_markdown(x) for x in md.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def aside_text(inner: pa.Array) -> pa.Array:
    return pa.array([None if x is None else printed_aside(x) for x in inner.to_pylist()], pa.string())


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value, in either kind of quotation marks; empty where there is none."""
    return F.regexp_extract(tag, rf"""(?s)(?<![\w:.-]){name}\s*=\s*(["'])(.*?)\1""", 2)


def anchors(docs: DataFrame) -> DataFrame:
    """work, path, at, id, href of the references to notes."""
    tags = docs.select("work", "path", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("at", "tag"))
    tags = tags.where(attribute(F.col("tag"), "epub:type") == "noteref")
    return tags.select("work", "path", "at", attribute(F.col("tag"), "id").alias("id"), attribute(F.col("tag"), "href").alias("href")).where("id <> ''")


def asides(docs: DataFrame) -> DataFrame:
    """work, path, at, id, printed, backs (hrefs) and pictures (members) of the notes."""
    each = docs.select("work", "path", F.posexplode(F.regexp_extract_all("html", F.lit(ASIDE), F.lit(1))).alias("at", "aside"))
    own = attribute(F.regexp_extract("aside", "^(<[^>]*>)", 1), "id")
    inner = F.regexp_extract("aside", r"(?is)^<[^>]*>(.*)</aside>$", 1)
    each = each.select("work", "path", "at", F.regexp_replace(own, f"^{FRAGMENT}", "").alias("id"), inner.alias("inner")).where("id <> ''")
    tags = F.filter(F.regexp_extract_all("inner", F.lit(ANCHOR), F.lit(1)), lambda x: attribute(x, "epub:type") == "backlink")
    pictures = F.transform(F.regexp_extract_all("inner", F.lit(IMAGE), F.lit(1)), lambda x: F.coalesce(*[F.nullif(attribute(x, a), F.lit("")) for a in ("src", "href", "xlink:href")]))
    return each.select("work", "path", "at", "id", aside_text("inner").alias("printed"), F.transform(tags, lambda x: attribute(x, "href")).alias("backs"), F.array_compact(pictures).alias("pictures"))


def last_ones(df: DataFrame) -> DataFrame:
    """Of the rows of one id the last by path and place, with ``again``, how many came before it."""
    own = Window.partitionBy("work", "id")
    return df.withColumn("n", F.row_number().over(own.orderBy(F.desc("path"), F.desc("at")))).withColumn("again", F.count("*").over(own) - 1).where("n = 1").drop("n")


def found(df: DataFrame, code, ref, detail="") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("work", text(code).alias("code"), (F.col(ref) if isinstance(ref, str) else ref).cast("string").alias("ref"), text(detail).cast("string").alias("detail"))


def near_href(href: Column) -> Column:
    """A reference without the package's folder before it."""
    return F.regexp_replace(F.trim(href), f"^{FOLDER}", "")


def audited_notes(works: DataFrame, refs: DataFrame, notes: DataFrame, targets: DataFrame, members: DataFrame, docs: DataFrame, media: DataFrame) -> DataFrame:
    """Every finding of every work; see the head of this module. Of repeated registrations of a note the greatest counts."""
    a, s = last_ones(anchors(docs)), last_ones(asides(docs))
    whole = works.join(members.select("work").distinct(), "work", "left_semi")
    none = whole.where("inventory = 'none'").select("work")
    rest = whole.where("inventory is null or inventory <> 'none'").select("work")
    held = a.select("work").union(s.select("work")).groupBy("work").count()
    parts = [
        found(works.join(members.select("work").distinct(), "work", "left_anti"), "E_NOTES_EPUB", F.lit(None)),
        *[found(df.where("again > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "again"))), code, "id") for df, code in ((a, "E_NOTES_DUP_ANCHOR"), (s, "E_NOTES_DUP_ASIDE"))],
        found(held.join(none, "work", "left_semi"), "E_NOTES_NONE_UNEXPECTED", F.lit(None), F.col("count")),
    ]
    refs = refs.join(rest, "work", "left_semi").select("work", "ref_id", "note_id")
    known = notes.groupBy("work", "note_id").agg(F.max("source_markdown").alias("source_markdown"), F.bool_or(F.coalesce("orphan_ok", F.lit(False))).alias("orphan_ok"))
    cited = refs.select("work", "note_id").distinct()
    kept = known.where("orphan_ok").join(rest, "work", "left_semi").join(cited, ["work", "note_id"], "left_anti").select("work", "note_id")
    due = cited.union(kept)
    mine = lambda df: df.join(rest, "work", "left_semi")
    parts += [
        found(mine(a).join(refs.select("work", F.col("ref_id").alias("id")), ["work", "id"], "left_anti"), "E_NOTES_ORPHAN_ANCHOR", "id"),
        found(mine(s).join(due.select("work", F.col("note_id").alias("id")), ["work", "id"], "left_anti"), "E_NOTES_ORPHAN_ASIDE", "id"),
    ]

    # the first thing wrong with each reference
    one = refs.join(known.select("work", "note_id", F.lit(True).alias("known")), ["work", "note_id"], "left")
    one = one.join(a.select("work", F.col("id").alias("ref_id"), F.col("path").alias("from"), "href"), ["work", "ref_id"], "left")
    file = F.substring_index("href", "#", 1)
    one = one.withColumn("file", F.when((file == "") | file.startswith(FOLDER), file).otherwise(F.concat(F.lit(FOLDER), file))).withColumn("part", F.regexp_extract("href", "(?s)#(.*)$", 1))
    one = one.join(docs.select("work", F.col("path").alias("file"), F.lit(True).alias("there")).distinct(), ["work", "file"], "left")
    one = one.join(s.select("work", F.col("id").alias("note_id"), F.col("path").alias("into"), "backs"), ["work", "note_id"], "left")
    back = near_href(F.concat(F.regexp_extract("from", "([^/]*)$", 1), F.lit("#"), F.col("ref_id")))
    code = (
        F.when(F.col("known").isNull(), "E_NOTES_REF_NO_NOTE").when(F.col("from").isNull(), "E_NOTES_ANCHOR_MISSING").when(F.col("part") != F.concat(F.lit(FRAGMENT), F.col("note_id")), "E_NOTES_HREF_WRONG")
        .when((F.col("file") != "") & F.col("there").isNull(), "E_NOTES_HREF_FILE").when(F.col("into").isNull() | (F.col("file") != "") & (F.col("into") != F.col("file")), "E_NOTES_ASIDE_MISSING")
        .when(~F.array_contains(F.transform("backs", near_href), back), "E_NOTES_BACKLINK_MISSING")
    )
    parts.append(found(one.withColumn("code", code).where("code is not null"), F.col("code"), "ref_id", F.col("note_id")))

    # what each note prints, and its pictures
    said = targets.groupBy("work", "note_id").agg(F.max("target_markdown").alias("target_markdown"))
    told = due.join(known, ["work", "note_id"], "left").join(said, ["work", "note_id"], "left")
    md = F.when(F.trim(F.coalesce("target_markdown", F.lit(""))) != "", F.col("target_markdown")).otherwise(F.coalesce("source_markdown", F.lit("")))
    told = told.select("work", "note_id", md.alias("md")).join(s.select("work", F.col("id").alias("note_id"), "path", "printed", "pictures"), ["work", "note_id"], "left")
    parts.append(found(told.where("path is null"), "E_NOTES_ASIDE_MISSING", "note_id"))
    shown = told.where("path is not null")
    parts.append(found(shown.where(F.col("printed") != note_text("md")), "E_NOTES_CONTENT_MISMATCH", "note_id"))
    have = shown.select("work", "note_id", "path", F.explode("pictures").alias("src")).select("work", "note_id", F.coalesce(resolved(F.col("path"), F.col("src")), "src").alias("member")).distinct()
    want = media_refs(shown.select(F.struct("work", "note_id").alias("unit"), "md")).select("unit.work", "unit.note_id", "ref").distinct().join(media.select("work", "ref", "member").distinct(), ["work", "ref"], "left")
    lost = want.where("member is not null").join(have, ["work", "note_id", "member"], "left_anti")
    listed = lambda df, what: df.groupBy("work", "note_id").agg(F.array_join(F.array_sort(F.collect_set(what)), ",").alias("which"))
    parts += [
        found(listed(want.where("member is null"), "ref"), "E_NOTES_MEDIA_MISSING", "note_id", F.concat(F.lit("source:"), F.col("which"))),
        found(listed(lost, "member"), "E_NOTES_MEDIA_MISSING", "note_id", F.concat(F.lit("aside:"), F.col("which"))),
        found(have.join(members.select("work", F.col("path").alias("member")), ["work", "member"], "left_anti"), "E_NOTES_MEDIA_ABSENT", "note_id", F.col("member")),
    ]
    return reduce(DataFrame.union, parts)
