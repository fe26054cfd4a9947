"""Evidence from pages: furniture, note blocks, paragraphs, content lists, anchors, media, errata, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markup, udfs
from foliospark.functions import text as t

# Fixed forms of page numbers.
PAGE_LABEL = r"^(?:第\s*\d{1,4}\s*页|\d{1,4}\s*页|[pP]\d{1,4})$"
PAGE_DECORATED = r"^[\s\-—–·]*\d{1,4}[\s\-—–·]*$"


def page_numbers(segments: DataFrame) -> DataFrame:
    """work, page, line, kind: labels and decorated numbers are page numbers; a bare number first or last on its page is a candidate."""
    w = Window.partitionBy("work", "page")
    s = segments.withColumn("edge", (F.col("line") == F.min("line").over(w)) | (F.col("line") == F.max("line").over(w))).withColumn("x", t.stripped(F.col("text")))
    kind = F.when(F.col("x").rlike(PAGE_LABEL), "label").when(F.col("x").rlike(PAGE_DECORATED) & F.col("x").rlike("[-—–·•]"), "decorated").when(F.col("x").rlike(r"^\d{1,4}$") & F.col("edge"), "candidate")
    return s.select("work", "page", "line", kind.alias("kind")).where("kind is not null")


def body_sizes(blocks: DataFrame) -> DataFrame:
    """work, page, body: the median font size by length of text, a block of n characters counting n / 20 times, once at least."""
    b = blocks.where("size is not null and coalesce(text, '') <> ''").withColumn("weight", F.greatest(F.lit(1), F.floor(F.char_length("text") / 20)).cast("long"))
    return b.groupBy("work", "page").agg(F.expr("percentile(size, 0.5, weight)").alias("body"))


def artefacts(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """work, key, pages: small texts in the lower part of several pages of a work that bear no note number: furniture."""
    b = blocks.join(body_sizes(blocks), ["work", "page"]).withColumn("bottom", F.max("y1").over(Window.partitionBy("work", "page")))
    key = F.lower(F.regexp_replace("text", r"(?U)\W+", ""))
    low = b.where((F.char_length("text") >= 12) & ~F.col("text").rlike(r"^\s*\d{1,3}[\s.]") & (F.col("size") <= F.col("body") - 1.2) & (F.col("y0") >= F.col("bottom") * 0.55)).withColumn("key", key)
    return low.groupBy("work", "key").agg(F.countDistinct("page").alias("pages")).where((F.col("pages") >= pages) & (F.col("key") != ""))


def note_blocks(blocks: DataFrame) -> DataFrame:
    """work, page, block: blocks that look like notes: of twenty characters, clearly smaller than the body, low on the page or labelled; not furniture, capitals or leaders."""
    b = blocks.join(body_sizes(blocks), ["work", "page"]).withColumn("bottom", F.max("y1").over(Window.partitionBy("work", "page"))).withColumn("key", F.lower(F.regexp_replace("text", r"(?U)\W+", "")))
    b = b.join(artefacts(blocks).select("work", "key"), ["work", "key"], "left_anti")
    labelled = F.col("text").rlike(r"(?m)^\s*(?:\d{1,3}[\s.)]|\[\d{1,3}\]|[*†‡])")
    shouting = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}") & (F.char_length("text") < 100)
    leaders = F.regexp_count("text", F.lit(r"\.\s*\.")) >= 5
    return b.where((F.char_length("text") >= 20) & ~shouting & ~leaders & (F.col("size") <= F.col("body") - 1.2) & ((F.col("y0") >= F.col("bottom") * 0.55) | labelled)).select("work", "page", "block")


def continued_notes(blocks: DataFrame) -> DataFrame:
    """work, page, block, from_page: a page's first note block without a label, after a page of the work whose last note block ends in no terminal mark."""
    notes = blocks.join(note_blocks(blocks), ["work", "page", "block"])
    edge = notes.groupBy("work", "page").agg(F.min_by(F.struct("block", "text"), "block").alias("first"), F.max_by("text", "block").alias("last"))
    before = Window.partitionBy("work").orderBy("page")
    e = edge.withColumn("prev_page", F.lag("page").over(before)).withColumn("prev_last", F.lag("last").over(before))
    open_ = ~F.right(t.right_stripped(F.col("prev_last")), F.lit(1)).isin(*(t.TERMINAL + t.CLOSERS))
    return e.where((F.col("prev_page") == F.col("page") - 1) & open_ & ~F.col("first.text").rlike(r"^\s*(?:\d{1,3}[\s.)]|\[\d{1,3}\])")).select("work", "page", F.col("first.block").alias("block"), F.col("prev_page").alias("from_page"))


def indented_paragraphs(lines: DataFrame) -> DataFrame:
    """block, line, paragraph: a block's lines in paragraphs: a new one at a line set in from the block's usual left edge, or of a smaller font, after a line that ends a sentence.

    Takes block, line, text, x0, size. The usual edge is the commonest x0, the first seen of several."""
    edges = lines.select("block", F.round("x0", 1).alias("x"), "line").groupBy("block", "x").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    left = edges.groupBy("block").agg(F.min_by("x", F.struct(-F.col("n"), F.col("first"))).alias("left"))
    order = Window.partitionBy("block").orderBy("line")
    l = lines.join(left, "block").withColumn("prev", F.lag("text").over(order)).withColumn("prev_size", F.lag("size").over(order))
    ends = t.right_stripped(F.coalesce("prev", F.lit(""))).rlike("[.!?。！？…”’」』）)]$")
    new = ends & ((F.col("x0") - F.col("left") > F.greatest(F.col("size") * 0.8, F.lit(2.0))) | (F.col("prev_size") > F.col("size") * 1.15))
    return l.withColumn("new", F.coalesce(new, F.lit(False)).cast("long")).select("block", "line", (F.sum("new").over(order) + 1).alias("paragraph"))


def content_segments(items: DataFrame) -> DataFrame:
    """page, kind, text, insert_id: items of a parsed document (ord, type, page_idx, text, level) as segments; headers and footers go, formulas are set in dollars, inserts are numbered by page and type."""
    body = F.trim(t.text_of("text"))
    kind = F.when(F.col("type").isin("image", "chart", "table"), "insert").when(F.col("type") == "equation", "formula").when((F.col("type") == "title") | (F.col("level") > 0), "heading").otherwise("text")
    s = items.where("type not in ('header', 'footer')").withColumn("kind", kind).withColumn("page", F.col("page_idx") + 1).withColumn("body", body).where("kind = 'insert' or body <> ''")
    what = F.when(F.col("kind") == "formula", "formula").when(F.col("type") == "table", "table").otherwise("fig")
    s = s.withColumn("what", what).withColumn("n", F.row_number().over(Window.partitionBy("page", "what", F.col("kind").isin("insert", "formula")).orderBy("ord")))
    insert_id = F.when(F.col("kind").isin("insert", "formula"), F.format_string("%s-p%03d-%02d", F.col("what"), F.col("page"), F.col("n")))
    shown = F.when((F.col("kind") == "formula") & ~F.col("body").startswith("$$"), F.concat(F.lit("$$"), F.col("body"), F.lit("$$"))).otherwise(F.col("body"))
    return s.select("ord", "page", "kind", shown.alias("text"), insert_id.alias("insert_id"))


def heading_units(segments: DataFrame) -> DataFrame:
    """work, unit, title, n_segments: each heading opens a unit; what stands before the first is front matter (unit 0)."""
    order = Window.partitionBy("work").orderBy("ord")
    u = segments.withColumn("unit", F.sum((F.col("kind") == "heading").cast("long")).over(order))
    return u.groupBy("work", "unit").agg(F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("title"), F.count("*").alias("n_segments"))


def anchored(lines: DataFrame) -> DataFrame:
    """work, anchor, line, text: lines of one long text with the last anchor line before them; those before the first belong to it."""
    order = Window.partitionBy("work").orderBy("line")
    a = F.nullif(F.regexp_extract("text", r"^\s*\[\]\{#([^}]+)\}\s*$", 1), F.lit(""))
    l = lines.withColumn("mark", a).withColumn("anchor", F.last("mark", ignorenulls=True).over(order))
    first = F.first("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return l.select("work", F.coalesce("anchor", first).alias("anchor"), "line", "text")


def punctuation(x: Column) -> Column:
    """For Chinese and Japanese targets: double angle marks, ellipses, and straight quotation marks as corner brackets by turns; an open one is closed at the end."""
    x = F.replace(F.replace(F.replace(x, F.lit("«"), F.lit("《")), F.lit("»"), F.lit("》")), F.lit("..."), F.lit("…"))
    parts = F.split(x, '"')
    start = F.struct(F.lit("").alias("s"), F.lit(-1).alias("n"))
    joined = F.aggregate(parts, start, lambda a, p: F.struct(F.concat(a["s"], F.when(a["n"] < 0, "").when(a["n"] % 2 == 0, "「").otherwise("」"), p).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"])
    return F.concat(joined, F.when(F.size(parts) % 2 == 0, "」").otherwise(""))


def target_signals(pairs: DataFrame, language: str) -> DataFrame:
    """id, signals: of note translations: missing, identical, without or with little of the target's script (for Chinese)."""
    src, tgt = t.text_of("source_md"), t.text_of("target_md")
    latin, han = F.regexp_count(tgt, F.lit("[A-Za-z]")), F.regexp_count(tgt, F.lit("[㐀-䶿一-鿿]"))
    zh = F.lit(language.lower().startswith("zh")) & (F.trim(tgt) != "")
    none = zh & (latin > 0) & (han == 0)
    low = zh & ~none & (latin >= 3) & (han / F.greatest(F.lit(1), latin + han) < 0.5)
    codes = F.array_compact(F.array(F.when((F.trim(src) != "") & (F.trim(tgt) == ""), "missing_target"), F.when((F.trim(src) != "") & (t.without_blanks(src) == t.without_blanks(tgt)), "identical_to_source"), F.when(none, "no_target_script"), F.when(low, "low_target_script")))
    return pairs.select("id", F.array_join(codes, ",").alias("signals"))


def resolved_media(refs: DataFrame, files: DataFrame, mapped: DataFrame, *, basename: bool) -> DataFrame:
    """work, ref, path, strategy: the best of an explicit mapping, the exact path, the path under its last media folder, and - where allowed - its file name."""
    clean = F.regexp_replace(F.regexp_replace(F.trim("ref"), r"^(?:\./)+|^/+", ""), r"[?#].*$", "")
    ways = [("exact", clean), ("root", F.regexp_replace(clean, r"^.*media/", "media/"))]
    if basename:
        ways.append(("basename", F.regexp_extract(clean, r"([^/]*)$", 1)))
    tries = [F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("strategy"), path.alias("path")) for rank, (name, path) in enumerate(ways, 1)]
    each = refs.select("work", "ref", F.explode(F.array(*tries)).alias("c")).select("work", "ref", "c.*").where("path not like '%../%'")
    direct = each.union(mapped.select("work", "ref", F.lit(0), F.lit("mapped"), "path")) if mapped is not None else each
    found = direct.join(files.select("work", "path").distinct(), ["work", "path"])
    best = found.groupBy("work", "ref").agg(F.min(F.struct("rank", "strategy", "path")).alias("b"))
    return refs.select("work", "ref").distinct().join(best, ["work", "ref"], "left").select("work", "ref", "b.path", F.coalesce("b.strategy", F.lit("missing")).alias("strategy"))


def errata(standing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, errors) of errata (unit, locator, reading, evidence, status): a batch with any error changes nothing; a confirmed row isn't lowered to a proposal."""
    b = batch.withColumn("n", F.count("*").over(Window.partitionBy("unit", "locator")))
    wrong = F.array_compact(F.array(*[F.when(F.trim(t.text_of(c)) == "", f"{c}_missing") for c in ("unit", "locator", "reading", "evidence")], F.when(~F.coalesce(F.col("status").isin("proposed", "confirmed"), F.lit(False)), "status"), F.when(F.col("n") > 1, "repeated")))
    errors = b.select("unit", "locator", F.explode(wrong).alias("code")).distinct()
    new = b.drop("n").withColumn("batch", F.lit(1)).join(errors.select(F.lit(1).alias("batch")).distinct(), "batch", "left_anti").drop("batch")
    s, n = standing.alias("s"), new.alias("n")
    keep = F.col("n.unit").isNull() | ((F.col("s.status") == "confirmed") & (F.col("n.status") == "proposed"))
    both = s.join(n, (F.col("s.unit") == F.col("n.unit")) & (F.col("s.locator") == F.col("n.locator")), "full_outer")
    columns = ["unit", "locator", "reading", "evidence", "status"]
    return both.select(*[F.when(F.coalesce(keep, F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns]), errors


def bound_candidates(candidates: DataFrame, refs: DataFrame, notes: DataFrame, places: DataFrame) -> DataFrame:
    """candidate_id, code: the first thing wrong with a candidate disposed of as a note.

    A reference candidate needs a reference of its own unit and label that no earlier candidate uses; a note candidate
    needs a note with that candidate among its places (note_id, candidate_id, unit, line)."""
    c = candidates.where("disposition = 'note'")
    is_ref = F.col("kind").isin("marker", "pandoc_ref")
    c = c.join(refs.select("ref_id", F.col("unit").alias("r_unit"), F.col("label").alias("r_label")), "ref_id", "left")
    c = c.join(notes.select("note_id", F.lit(True).alias("known")).distinct(), "note_id", "left").join(places.select("note_id", "candidate_id", F.col("unit").alias("p_unit"), F.col("line").alias("p_line")), ["note_id", "candidate_id"], "left")
    fine = F.col("r_unit").isNotNull() & (F.col("r_unit") == F.col("unit")) & (F.col("label") == F.col("r_label"))
    c = c.withColumn("fine", F.coalesce(fine, F.lit(False)))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("ref_id", "fine").orderBy("candidate_id")))
    ref_code = F.when(F.col("ref_id").isNull(), "ref_missing").when(F.col("r_unit").isNull(), "ref_unknown").when(F.col("r_unit") != F.col("unit"), "other_unit").when(F.col("r_label") != F.col("label"), "other_label").when(F.col("nth") > 1, "used_twice")
    note_code = F.when(F.col("note_id").isNull(), "note_missing").when(F.col("known").isNull(), "note_unknown").when(F.col("p_unit").isNull(), "place_missing").when((F.col("p_unit") != F.col("unit")) | (F.col("p_line") != F.col("line")), "place_differs")
    return c.select("candidate_id", F.when(is_ref, ref_code).otherwise(note_code).alias("code")).where("code is not null")


def anchors_of(lines: DataFrame) -> DataFrame:
    """unit, level, title, anchor: subheadings (level two on) with their own id or one from the running number, which counts headings without a title too."""
    level = t.heading_level(F.col("text"))
    h = lines.withColumn("level", level).where("level >= 2")
    h = h.withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy("line")))
    own = F.regexp_extract("text", r"\{#([^}\s]+)\}\s*$", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("text", r"^#{1,6}[ \t]+", ""), r"\{#[^}]*\}\s*$", ""))
    bare = F.regexp_replace(title, r"[*_`]+", "")
    return h.select("unit", "level", bare.alias("title"), F.when(own != "", own).otherwise(F.concat("unit", F.lit("-h"), F.col("n").cast("string"))).alias("anchor")).where("title <> ''")


#: What an import blocks on; the same findings otherwise only warn until release.
IMPORT_BLOCKS = ("language", "length", "length_review")


def admission(units: DataFrame, findings: DataFrame) -> DataFrame:
    """unit, outcome, errors, warnings: pending without rows, failed with an error that blocks an import, skipped where nothing changed, else imported. Units: unit, n_rows, changed; findings: unit, check, blocking, reverse."""
    hard = F.col("blocking") & (F.col("check").isin(*IMPORT_BLOCKS) | ((F.col("check") == "fidelity") & F.coalesce("reverse", F.lit(False))))
    f = findings.groupBy("unit").agg(F.count_if(hard).alias("errors"), F.count_if(~hard).alias("warnings"))
    u = units.join(f, "unit", "left").na.fill(0, ["errors", "warnings"])
    outcome = F.when(F.col("n_rows") == 0, "pending").when(~F.col("changed"), "skipped").when(F.col("errors") > 0, "failed").otherwise("imported")
    return u.select("unit", outcome.alias("outcome"), "errors", "warnings")


def dispositions(findings: DataFrame, decided: DataFrame) -> DataFrame:
    """unit, block, code, status: findings with their disposition while the block's digest is the same, else stale; a disposition without a finding is gone. Blocks may be null."""
    key = ["unit", "block", "code"]
    d = decided.select(*[F.col(c).alias(f"d_{c}") for c in key], F.col("digest").alias("d_digest"), "disposition")
    same = lambda: (F.col("unit") == F.col("d_unit")) & F.col("block").eqNullSafe(F.col("d_block")) & (F.col("code") == F.col("d_code"))
    held = findings.join(d, same(), "left")
    status = F.when(F.col("disposition").isNull(), "open").when(F.col("digest") == F.col("d_digest"), F.col("disposition")).otherwise("stale")
    gone = d.join(findings, same(), "left_anti").select(F.col("d_unit").alias("unit"), F.col("d_block").alias("block"), F.col("d_code").alias("code"), F.lit("gone").alias("status"))
    return held.select(*key, status.alias("status")).union(gone)


def inputs_digest(units: DataFrame) -> DataFrame:
    """work, unit, digest: of each unit's text, and of the whole work (unit *) in order."""
    u = units.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "unit", "digest").alias("line")))), lambda x: x["line"]), "\n")
    whole = u.groupBy("work").agg(F.sha2(lines.cast("binary"), 256).alias("digest")).select("work", F.lit("*").alias("unit"), "digest")
    return u.select("work", "unit", "digest").union(whole)


def covers(pages: DataFrame, most: int = 3) -> DataFrame:
    """work, page, area: up to ``most`` candidate covers among the first pages, the largest images first."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    p = pages.where("page <= 3 and type = 'image'").withColumn("area", area)
    n = F.row_number().over(Window.partitionBy("work").orderBy(F.desc("area"), "page"))
    return p.withColumn("n", n).where(F.col("n") <= most).select("work", "page", "area")


def sampled_pages(pages: DataFrame) -> DataFrame:
    """work, n_pages, empty_ratio, garbled_ratio, scanned: every fifth page of works over 500 pages, every page else."""
    p = pages.withColumn("n_pages", F.count("*").over(Window.partitionBy("work"))).where("n_pages <= 500 or page % 5 = 0")
    chars = F.sum(F.char_length("text"))
    empty = F.round(F.avg((F.trim("text") == "").cast("double")), 4)
    garbled = F.round(F.coalesce(F.try_divide(F.sum(F.regexp_count("text", F.lit("�"))), chars), F.lit(0.0)), 4)
    s = p.groupBy("work").agg(F.max("n_pages").alias("n_pages"), empty.alias("empty_ratio"), garbled.alias("garbled_ratio"))
    return s.withColumn("scanned", F.col("empty_ratio") >= 0.6)


def provenance(units: DataFrame, spine: DataFrame, nav: DataFrame) -> DataFrame:
    """work, unit, code: a three-way reconciliation of units, spine and navigation, with the order of the spine."""
    u, s, n = (x.select("work", "unit", F.col("place").alias(p)) for x, p in ((units, "u"), (spine, "s"), (nav, "n")))
    all_ = u.join(s, ["work", "unit"], "full_outer").join(n, ["work", "unit"], "full_outer")
    before = F.max(F.when(F.col("u").isNotNull(), F.col("s"))).over(Window.partitionBy("work").orderBy("u").rowsBetween(Window.unboundedPreceding, -1))
    all_ = all_.withColumn("high", F.when(F.col("u").isNotNull() & F.col("s").isNotNull(), before))
    codes = F.array_compact(F.array(F.when(F.col("u").isNotNull() & F.col("s").isNull(), "unit_missing"), F.when(F.col("u").isNull() & F.col("s").isNotNull(), "spine_unknown"), F.when(F.col("high") > F.col("s"), "unit_order"), F.when(F.col("u").isNotNull() & F.col("n").isNull(), "nav_missing"), F.when(F.col("n").isNotNull() & F.col("s").isNull(), "nav_dangling")))
    return all_.select("work", "unit", F.explode(codes).alias("code"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of which the left has more than the right, with how many more."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("a")), right.groupBy(*keys).agg(F.count("*").alias("b"))
    return a.join(b, keys, "left").select(*keys, (F.col("a") - F.coalesce("b", F.lit(0))).alias("lost")).where("lost > 0")


def registered_notes(refs: DataFrame, anchors: DataFrame, asides: DataFrame, notes: DataFrame) -> DataFrame:
    """ref_id, code: the first that fails for each registered reference: its note, its anchor, the anchor's fragment, the aside in that file, the way back."""
    r = refs.join(notes.select("note_id", F.lit(True).alias("known")).distinct(), "note_id", "left").join(anchors.select("ref_id", "file", "href_file", "fragment"), "ref_id", "left")
    a = asides.select(F.col("note_id").alias("a_note"), F.col("file").alias("a_file"), "back_file", "back_ref")
    r = r.join(a, (F.col("a_note") == F.col("note_id")) & (F.col("a_file") == F.col("href_file")), "left")
    code = (
        F.when(F.col("known").isNull(), "note_unknown").when(F.col("file").isNull(), "anchor_missing").when(F.col("fragment") != F.concat(F.lit("fn-"), F.col("note_id")), "href_wrong")
        .when(F.col("a_file").isNull(), "aside_missing").when((F.col("back_file") != F.col("file")) | (F.col("back_ref") != F.col("ref_id")), "backlink_missing")
    )
    return r.select("ref_id", code.alias("code")).where("code is not null")


# Fixed forms of references to media: placeholders, markup and Markdown, in this order.
MEDIA_FORMS = (r'original-image-src="([^"]+)"', r"(?i)<(?:img|image)\b[^>]*?\b(?:src|href)=[\"']([^\"']+)[\"']", r"!\[[^\]]*\]\(([^()]+)\)")


def media_refs(units: DataFrame) -> DataFrame:
    """unit, place, ref: references to media in the text of units (unit, md) outside code, form by form in order."""
    text = markup.without_inline_code(F.array_join(F.transform(F.filter(udfs.chunks(F.col("md")), lambda c: c["kind"] != "code"), lambda c: c["chunk"]), "\n"))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(form), F.lit(1)) for form in MEDIA_FORMS])
    return units.select("unit", F.posexplode(found).alias("at", "ref")).select("unit", F.col("at").cast("long").alias("place"), "ref")


def media_kept(source: DataFrame, target: DataFrame) -> DataFrame:
    """unit, code, ref: media that the target has fewer times than the source (lost), and units whose common media stand in another order (order, ref null). Both: unit, place, ref."""
    counted = lambda x, name: x.groupBy("unit", "ref").agg(F.count("*").alias(name))
    lost = counted(source, "a").join(counted(target, "b"), ["unit", "ref"], "left").where("a > coalesce(b, 0)").select("unit", F.lit("lost").alias("code"), "ref")
    both = source.select("unit", "ref").distinct().join(target.select("unit", "ref").distinct(), ["unit", "ref"])
    lined = lambda x, name: x.join(both, ["unit", "ref"], "left_semi").groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda s: s["ref"]).alias(name))
    moved = lined(source, "a").join(lined(target, "b"), "unit").where("a <> b").select("unit", F.lit("order"), F.lit(None).cast("string"))
    return lost.union(moved)


def applied_edits(files: DataFrame, plan: DataFrame) -> DataFrame:
    """work, path, content, status of a plan's edits (work, path, old_sha256, after) on files (work, path, content): a work's edits are made together or not at all.

    applied: every edited file still has the content that the plan was made for; already_applied: every one has the new
    content; refused: any other state, and the files stay as they are. Running a plan twice changes nothing."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    edits = plan.join(files, ["work", "path"], "left")
    states = edits.groupBy("work").agg(
        F.bool_and(F.col("content").isNotNull() & (digest("content") == F.col("old_sha256"))).alias("fresh"), F.bool_and(F.col("content").eqNullSafe(F.col("after"))).alias("done"),
        (F.count("*") != F.countDistinct("path")).alias("twice"),
    )
    status = F.when(F.col("twice"), "refused").when(F.col("done"), "already_applied").when(F.col("fresh"), "applied").otherwise("refused")
    told = states.select("work", status.alias("status"))
    new = plan.select("work", "path", "after").dropDuplicates(["work", "path"])
    out = files.join(told, "work", "left").join(new, ["work", "path"], "left")
    return out.select("work", "path", F.when((F.col("status") == "applied") & F.col("after").isNotNull(), F.col("after")).otherwise(F.col("content")).alias("content"), F.coalesce("status", F.lit("untouched")).alias("status"))
