"""The whole gate over units: every check of aligned rows and their documents, as one table of findings.

Tables (other columns are ignored): rows (unit, pos, seq, src, tgt, note_id), units (unit, kind, source_md, target_md: null
where there is no such document), glossary (ord, source, aliases, target, status), exemptions (unit, source, seq, note_id,
text_sha256, reason), styles (unit, ord, pattern, reason), registered (unit, number, ref).

A finding is (unit, seq, check, blocking, detail); seq is null where the check is the unit's. Row checks read a row once and
need no shuffle but for the styles of its unit; unit checks are one aggregation by unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markup, udfs
from foliospark.functions import text as t
from foliospark.operators import align, gate, terms
from foliospark.operators.notes import prose

#: Checks whose blocking findings are a structural fault; of the others terminology blocks by itself and the rest is advice.
STRUCTURAL = ("align", "length", "length_review", "language", "marker", "footnote", "footnote_range", "heading", "fidelity", "table")
MIN_COPIED, LONG_LETTERS, FEW_LETTERS = 20, 80, 4
# Lines that are a page's furniture and not its prose, and the ideographs of the language rule.
FURNITURE = r"^\s*(?:::.*|\[\]\{[^}]*\}|\[!?\[[^\]]*\]\([^)]*\)\]|!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\))$"
HAN = "[㐀-鿿豈-﫿]"
MARK = r"\[\^([^\]]+)\]"


def language_prose(md: Column) -> Column:
    """What a text says in its language: without code, headings, anchors, note marks and lines that are only links, images or fences."""
    lines = F.split(markup.without_inline_code(prose(md)), "\n")
    lines = F.filter(lines, lambda x: ~x.rlike(r"^\s{0,3}#{1,6}\s"))
    lines = F.transform(lines, lambda x: t.stripped(F.regexp_replace(F.regexp_replace(x, r"\[\]\{[^}]*\}", ""), r"\[\^[^\]\s]+\]", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(FURNITURE)), "\n")


def letters(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\p{L}"))


def first_style(src: Column, named: bool) -> Column:
    """The reason of the first of the unit's styles whose pattern the source holds; ``named``: an empty pattern doesn't count."""
    fit = F.filter("styles", lambda x: ((x["pattern"] != "") | F.lit(not named)) & F.regexp_like(src, x["pattern"]))
    return F.try_element_at(fit, F.lit(1))["reason"]


def finding(check, blocking, detail) -> Column:
    return F.struct(check.alias("check"), blocking.alias("blocking"), detail.cast("string").alias("detail"))


def row_findings(rows: DataFrame, units: DataFrame, styles: DataFrame, *, same_language: bool, target_language: str, **bounds) -> DataFrame:
    """length, length_review and language, with their exempt forms."""
    by_unit = styles.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("pattern", F.lit("")).alias("pattern"), "reason"))).alias("styles"))
    df = rows.select("unit", "seq", t.text_of("src").alias("src"), t.text_of("tgt").alias("tgt"))
    df = df.join(units.select("unit", "kind"), "unit", "left").join(by_unit, "unit", "left")
    df = df.withColumn("prose", language_prose(F.col("src"))).withColumn("said", language_prose(F.col("tgt")))
    src, tgt = F.col("src"), F.col("tgt")
    n, m = F.char_length(t.stripped(src)), F.char_length(t.stripped(tgt))
    ratio = t.length_ratio(src, tgt)
    limits = {"too_short": align.TOO_SHORT, "too_long": align.TOO_LONG, "min_chars": align.MIN_CHARS} | bounds
    code = F.when(m == 0, "empty").when((n >= limits["min_chars"]) & (ratio < limits["too_short"]), "too_short").when((n >= limits["min_chars"]) & (ratio > limits["too_long"]), "too_long")
    spoken, kept = letters(F.col("prose")), letters(F.col("said"))
    review, excuse = (spoken >= LONG_LETTERS) & (m > 0) & (kept <= FEW_LETTERS), first_style(src, True)
    a, b = t.without_blanks(src), t.without_blanks(tgt)
    han = F.regexp_count("prose", F.lit(HAN))
    copied = (a == b) & (F.char_length(a) >= MIN_COPIED) & (spoken > 0) & (F.lit(not target_language.lower().startswith("zh")) | (han * 2 < spoken)) & F.lit(not same_language)
    style = first_style(src, False)
    kind = F.when(style.isNotNull(), "language_exempt").when(F.col("kind") == "bibliography", "bibliography_identical").otherwise("language")
    found = F.array(
        F.when(code.isNotNull(), finding(F.lit("length"), code == "empty", code)),
        F.when(review, finding(F.when(excuse.isNull(), "length_review").otherwise("length_review_exempt"), excuse.isNull(), F.concat_ws(":", kept.cast("string"), excuse))),
        F.when(copied, finding(kind, kind == "language", F.coalesce(style, F.lit("")))),
    )
    return df.select("unit", "seq", F.explode(F.array_compact(found)).alias("f")).select("unit", "seq", "f.check", "f.blocking", "f.detail")


def term_findings(rows: DataFrame, glossary: DataFrame, exemptions: DataFrame) -> DataFrame:
    """terminology, terminology_exempt and terminology_exempt_stale of every missing target.

    A row is known by its unit and pos, since a seq may repeat. None of a missing target's forms occurs, so that all
    occurrences of its source need an exemption. An exemption without a place frees its unit. Else those that name the row, or no row, and the source's own digest, or
    none, free an occurrence each; one with another digest is stale."""
    hits = terms.with_missing_targets(rows.select("unit", "pos", "seq", "note_id", t.text_of("src").alias("src"), t.text_of("tgt").alias("tgt")), glossary)
    digest = F.sha2(udfs.nfkc("src").cast("binary"), 256)
    hits = hits.where(F.size("missing") > 0).select("unit", "pos", "seq", "note_id", digest.alias("digest"), F.explode("missing").alias("m")).select("*", "m.*").drop("m")
    free = exemptions.select(F.col("unit").alias("e_unit"), F.col("source").alias("e_source"), F.col("seq").alias("e_seq"), F.col("note_id").alias("e_note"), F.col("text_sha256").alias("e_digest"), "reason")
    free = free.withColumn("whole", F.col("e_seq").isNull() & F.col("e_note").isNull() & F.col("e_digest").isNull())
    place = (F.col("unit") == F.col("e_unit")) & (F.col("source") == F.col("e_source")) & (F.col("e_seq").isNull() | (F.col("e_seq") == F.col("seq"))) & (F.col("e_note").isNull() | F.col("e_note").eqNullSafe(F.col("note_id")))
    stale = ~F.col("whole") & F.coalesce(F.col("e_digest") != F.col("digest"), F.lit(False))
    there = F.col("e_unit").isNotNull()
    keys = ["unit", "pos", "seq", "source", "expected", "n"]
    told = hits.join(free, place, "left").groupBy(*keys).agg(
        F.coalesce(F.bool_or("whole"), F.lit(False)).alias("whole"), F.count_if(there & ~F.col("whole") & ~stale).alias("matched"), F.count_if(there & stale).alias("stale"),
        F.coalesce(F.min("reason"), F.lit("")).alias("reason"),
    )
    missing = F.col("n") - F.least("matched", "n")
    freed = F.col("whole") | ((F.col("matched") > 0) & (missing == 0))
    first = finding(F.when(freed, "terminology_exempt").otherwise("terminology"), ~freed, F.concat_ws(" ", "source", "expected", F.when(F.col("matched") > 0, missing.cast("string"))))
    also = F.when((F.col("stale") > 0) & ~F.col("whole"), finding(F.lit("terminology_exempt_stale"), F.lit(False), F.concat_ws(" ", "source", "expected")))
    return told.select("unit", "seq", F.explode(F.array_compact(F.array(first, also))).alias("f")).select("unit", "seq", "f.check", "f.blocking", "f.detail")


def unit_findings(rows: DataFrame, units: DataFrame, registered: DataFrame) -> DataFrame:
    """align, marker, footnote, footnote_suspect, footnote_range and heading."""
    toc = F.coalesce(F.col("kind").isin(*gate.LISTS), F.lit(False))
    src, tgt = t.text_of("src"), t.text_of("tgt")
    r = rows.join(units.select("unit", "kind"), "unit", "left").withColumn("toc", toc)
    place = F.row_number().over(Window.partitionBy("unit").orderBy("pos"))
    notes = lambda x: udfs.count_sentence_notes(x, F.col("toc")) + t.note_marks(x)
    numbers = lambda x: udfs.find_note_numbers(x, F.col("toc"))
    r = r.select("unit", "seq", place.alias("place"), (t.stripped(src) == "").alias("no_src"), (t.stripped(tgt) == "").alias("no_tgt"), t.markers(src).alias("m_src"), t.markers(tgt).alias("m_tgt"), notes(src).alias("n_src"), notes(tgt).alias("n_tgt"), numbers(src).alias("f_src"), numbers(tgt).alias("f_tgt"))
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    sums = r.groupBy("unit").agg(
        F.lit(True).alias("has_rows"), F.bool_or(~F.col("seq").eqNullSafe(F.col("place"))).alias("bad_seq"), F.bool_or("no_src").alias("no_src"), F.bool_or("no_tgt").alias("no_tgt"),
        *[F.sum(c).alias(c) for c in ("m_src", "m_tgt", "n_src", "n_tgt")], every("f_src").alias("f_src"), every("f_tgt").alias("f_tgt"),
    )
    known = registered.groupBy("unit").agg(F.collect_list(F.struct("number", F.coalesce("ref", F.lit("")).alias("ref"))).alias("registered"))
    u = units.select("unit", "kind", "source_md", "target_md").join(sums, "unit", "full_outer").join(known, "unit", "left").withColumn("toc", toc)
    u = u.withColumn("s_heads", heading_counts(F.col("source_md"))).withColumn("t_heads", heading_counts(F.col("target_md"))).withColumn("at_ends", udfs.find_sentence_notes(t.text_of("source_md"), F.col("toc")))
    both = F.col("source_md").isNotNull() & F.col("target_md").isNotNull()
    bare = F.col("has_rows").isNull()
    furniture = markup.heading_only(F.col("source_md")) & markup.heading_only(F.col("target_md"))
    missing = F.array_sort(F.array_except(F.coalesce("f_src", F.array().cast("array<bigint>")), F.coalesce("f_tgt", F.array().cast("array<bigint>"))))
    marks = F.regexp_extract_all(t.text_of("target_md"), F.lit(MARK), F.lit(1))
    blind = F.array_except(missing, "at_ends")
    named = lambda n: F.exists("registered", lambda x: (x["number"] == n) & ~F.array_contains(marks, x["ref"]) & ~F.array_contains(marks, n.cast("string")))
    lost = F.filter(blind, lambda n: F.coalesce(named(n), F.lit(False)))
    head = lambda xs: F.array_join(F.slice(xs, 1, 12).cast("array<string>"), "/")
    found = F.array(
        F.when(bare & ~furniture, finding(F.lit("align"), F.lit(True), F.lit("empty"))),
        F.when(F.col("bad_seq"), finding(F.lit("align"), F.lit(True), F.lit("seq"))),
        F.when(F.col("no_src"), finding(F.lit("align"), F.lit(True), F.lit("src_blank"))),
        F.when(F.col("no_tgt"), finding(F.lit("align"), F.lit(True), F.lit("tgt_blank"))),
        F.when(F.col("m_src") != F.col("m_tgt"), finding(F.lit("marker"), F.lit(True), F.concat_ws("/", F.col("m_src").cast("string"), F.col("m_tgt").cast("string")))),
        F.when(F.col("n_tgt") < F.col("n_src"), finding(F.lit("footnote"), ~F.col("toc"), F.concat_ws("/", F.col("n_src").cast("string"), F.col("n_tgt").cast("string")))),
        F.when(F.size(missing) > 0, finding(F.lit("footnote_suspect"), F.lit(False), head(missing))),
        F.when(both & (F.size(lost) > 0), finding(F.lit("footnote_range"), ~F.col("toc"), head(lost))),
        F.when(both & (F.col("s_heads") != F.col("t_heads")), finding(F.lit("heading"), F.lit(True), F.concat_ws("/", "s_heads", "t_heads"))),
    )
    return u.select("unit", F.lit(None).cast("long").alias("seq"), F.explode(F.array_compact(found)).alias("f")).select("unit", "seq", "f.check", "f.blocking", "f.detail")


def table_findings(units: DataFrame) -> DataFrame:
    """table: another number of pipe tables, or a table of another shape at the same place."""
    docs = units.where("source_md is not null and target_md is not null")
    detail = F.concat_ws(" ", F.col("place").cast("string"), F.concat_ws("/", "src", "tgt"))
    return gate.table_shapes(docs).select("unit", F.lit(None).cast("long").alias("seq"), F.lit("table").alias("check"), F.lit(True).alias("blocking"), detail.alias("detail"))


def heading_counts(md: Column) -> Column:
    """How many headings of each level the text outside code has, as 1:n,2:n."""
    lines = F.split(prose(t.text_of(md) if isinstance(md, str) else F.coalesce(md, F.lit(""))), "\n")
    levels = F.transform(lines, t.heading_level)
    count = lambda k: F.size(F.filter(levels, lambda x: x == k))
    return F.concat_ws(",", *[F.when(count(k) > 0, F.concat(F.lit(f"{k}:"), count(k).cast("string"))) for k in range(1, 7)])


def fidelity_findings(rows: DataFrame, units: DataFrame) -> DataFrame:
    """fidelity: blocks of the source document that no rows' sources hold (advice), and rows whose source the document doesn't hold."""
    docs = units.where("source_md is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", t.without_blanks(t.text_of("src")).alias("x")))), lambda x: x["x"]), "")
    whole = rows.groupBy("unit").agg(joined.alias("rows_body"))
    blocks = docs.join(whole, "unit", "left").select("unit", F.coalesce("rows_body", F.lit("")).alias("rows_body"), F.posexplode(udfs.blocks(F.col("source_md"))).alias("at", "b"))
    ahead = blocks.where(~F.contains("rows_body", t.without_blanks(F.col("b.block")))).select("unit", F.lit(None).cast("long").alias("seq"), F.lit("fidelity").alias("check"), F.lit(False).alias("blocking"), F.concat(F.lit("block "), (F.col("at") + 1).cast("string")).alias("detail"))
    body = docs.select("unit", t.without_blanks(F.col("source_md")).alias("body"))
    back = rows.join(body, "unit").where(~F.contains("body", t.without_blanks(t.text_of("src"))))
    return ahead.union(back.select("unit", "seq", F.lit("fidelity"), F.lit(True), F.lit("row")))


def unit_flags(rows: DataFrame, units: DataFrame, glossary: DataFrame, exemptions: DataFrame, styles: DataFrame, registered: DataFrame, *, source_language="auto", target_language="zh-CN", **bounds) -> DataFrame:
    """Every finding of every unit; see the head of this module for the tables."""
    same = source_language.lower().split("-")[0] == target_language.lower().split("-")[0]
    parts = [
        row_findings(rows, units, styles, same_language=same, target_language=target_language, **bounds),
        term_findings(rows, glossary, exemptions),
        unit_findings(rows, units, registered),
        fidelity_findings(rows, units),
        table_findings(units),
    ]
    return reduce(DataFrame.unionByName, parts)


def release_counts(findings: DataFrame, works: DataFrame) -> DataFrame:
    """work, terminology_open, structure_open, advisory: what the release decision takes from the findings; works: work, unit."""
    told = works.join(findings, "unit", "left")
    return told.groupBy("work").agg(
        F.count_if((F.col("check") == "terminology") & F.col("blocking")).alias("terminology_open"), F.count_if(F.col("check").isin(*STRUCTURAL) & F.col("blocking")).alias("structure_open"), F.count_if(~F.col("blocking")).alias("advisory"),
    )
