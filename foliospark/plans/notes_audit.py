"""The audit of notes over packages made from the parts, with faults put in by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import notes_audit as n
from foliospark.plans.registry import Literal, query, with_tables

W, K = "concat('w', p_partkey % 12)", "p_partkey"
FILE = "concat('c', p_partkey % 5, '.xhtml')"
WORKS = Literal("n_works", "work string, inventory string", ("w11", "none"), ("clean", "none"), ("gone", "full")).also(f"SELECT DISTINCT {W}, CASE WHEN p_partkey % 12 = 3 THEN NULL ELSE 'full' END FROM {{part}} WHERE p_partkey % 12 <> 11")
REFS = Literal("n_refs", "work string, ref_id string, note_id string").also(f"SELECT {W}, concat('r', {K}), concat(CASE WHEN {K} % 37 = 5 THEN 'x' ELSE 'n' END, {K}) FROM {{part}} WHERE {K} % 12 <> 11")
NOTES = Literal("n_notes", "work string, note_id string, source_markdown string, orphan_ok boolean").also(
    f"""SELECT {W}, concat('n', {K}), concat('Note **', {K}, '** of `x_y*` and [link](http://a/', {K}, ') _end_ &amp;.', CASE WHEN {K} % 7 = 1 THEN concat(' ![i](media/a', {K} % 4, '.png)') ELSE '' END, CASE WHEN {K} % 14 = 1 THEN ' ![j](lost/b.png)' ELSE '' END), false FROM {{part}} WHERE {K} % 12 <> 11
    UNION ALL SELECT {W}, concat('o', {K}), '1. kept', {K} % 2 = 0 FROM {{part}} WHERE {K} % 29 = 0 AND {K} % 12 <> 11"""
)
TARGETS = Literal("n_targets", "work string, note_id string, target_markdown string").also(f"SELECT {W}, concat('n', {K}), CASE WHEN {K} % 6 = 3 THEN ' ' ELSE concat('> Ziel <http://b/', {K}, '>') END FROM {{part}} WHERE {K} % 3 = 0")
ANCHORS = Literal("n_anchors", "work string, file string, spot long, id string, href string").also(
    f"""SELECT {W}, {FILE}, {K} * 10, concat('r', {K}), CASE WHEN {K} % 19 = 4 THEN concat({FILE}, '#fn-zz') WHEN {K} % 17 = 6 THEN concat('gone.xhtml#fn-n', {K}) WHEN {K} % 6 = 0 THEN concat('#fn-n', {K}) WHEN {K} % 2 = 0 THEN concat('OEBPS/', {FILE}, '#fn-n', {K}) ELSE concat({FILE}, '#fn-n', {K}) END FROM {{part}} WHERE {K} % 23 <> 3
    UNION ALL SELECT {W}, {FILE}, {K} * 10 + 1, concat('r', {K}), '#fn-twice' FROM {{part}} WHERE {K} % 47 = 8 UNION ALL SELECT {W}, {FILE}, {K} * 10 + 2, concat('q', {K}), '#fn-q' FROM {{part}} WHERE {K} % 43 = 9"""
)
ASIDES = Literal("n_asides", "work string, file string, spot long, id string, text string, back string, image string").also(
    f"""SELECT {W}, CASE WHEN {K} % 53 = 11 THEN concat('c', ({K} + 1) % 5, '.xhtml') ELSE {FILE} END, {K} * 10 + 5, concat('n', {K}),
      concat(CASE WHEN {K} % 3 = 0 AND {K} % 6 <> 3 THEN concat('Ziel http://b/', {K}) ELSE concat('Note ', {K}, ' of x_y* and link _end_ &amp;.') END, CASE WHEN {K} % 31 = 14 THEN ' extra' ELSE '' END), CASE WHEN {K} % 11 = 2 THEN concat('c9.xhtml#r', {K}) ELSE concat({FILE}, '#r', {K}) END,
      CASE WHEN {K} % 7 = 1 AND {K} % 35 <> 8 THEN concat('media/a', {K} % 4, '.png') ELSE '' END FROM {{part}} WHERE {K} % 13 <> 10
    UNION ALL SELECT {W}, {FILE}, {K} * 10 + 6, concat('n', {K}), 'second', '', '' FROM {{part}} WHERE {K} % 59 = 12 UNION ALL SELECT {W}, {FILE}, {K} * 10 + 7, concat('z', {K}), 'nobody', '', '' FROM {{part}} WHERE {K} % 61 = 13
    UNION ALL SELECT {W}, {FILE}, {K} * 10 + 8, concat('o', {K}), 'kept', '', '' FROM {{part}} WHERE {K} % 29 = 0 AND {K} % 3 <> 1"""
)
MEDIA = Literal("n_media", "work string, ref string, member string").also(f"SELECT DISTINCT {W}, concat('media/a', p_size % 4, '.png'), concat('OEBPS/media/a', p_size % 4, '.png') FROM {{part}}")
FILES = Literal("n_files", "work string, path string", ("clean", "OEBPS/c0.xhtml")).also(f"SELECT DISTINCT {W}, concat('OEBPS/', {FILE}) FROM {{part}} UNION ALL SELECT DISTINCT {W}, concat('OEBPS/media/a', p_size % 3, '.png') FROM {{part}}")

#: The rules over the parts that the pages are made of; of one id the last place counts, which here is the later file's.
RULES = """, a_ AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY work, id) AS c FROM n_anchors WINDOW w AS (PARTITION BY work, id ORDER BY file DESC, spot DESC)),
s_ AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY work, id) AS c FROM n_asides WINDOW w AS (PARTITION BY work, id ORDER BY file DESC, spot DESC)),
a AS (SELECT * FROM a_ WHERE n = 1), s AS (SELECT * FROM s_ WHERE n = 1), rest AS (SELECT work FROM n_works WHERE coalesce(inventory, '') <> 'none' AND work <> 'gone'),
cited AS (SELECT DISTINCT work, note_id FROM n_refs), due AS (SELECT * FROM cited UNION ALL SELECT k.work, k.note_id FROM n_notes k LEFT JOIN cited c ON c.work = k.work AND c.note_id = k.note_id WHERE k.orphan_ok AND c.work IS NULL),
one AS (SELECT r.*, k.note_id AS known, a.file AS anchored, split_part(a.href, '#', 1) AS target, split_part(a.href, '#', 2) AS part, s.file AS into_, s.back FROM n_refs r LEFT JOIN n_notes k ON k.work = r.work AND k.note_id = r.note_id LEFT JOIN a ON a.work = r.work AND a.id = r.ref_id LEFT JOIN s ON s.work = r.work AND s.id = r.note_id),
aimed AS (SELECT *, CASE WHEN target = '' OR starts_with(target, 'OEBPS/') THEN target ELSE 'OEBPS/' || target END AS path FROM one),
chain AS (SELECT o.work, o.ref_id, o.note_id, CASE WHEN known IS NULL THEN 'REF_NO_NOTE' WHEN anchored IS NULL THEN 'ANCHOR_MISSING' WHEN part <> 'fn-' || note_id THEN 'HREF_WRONG' WHEN o.path <> '' AND f.path IS NULL THEN 'HREF_FILE' WHEN into_ IS NULL OR (o.path <> '' AND 'OEBPS/' || into_ <> o.path) THEN 'ASIDE_MISSING' WHEN back <> anchored || '#' || ref_id THEN 'BACKLINK_MISSING' END AS code FROM aimed o LEFT JOIN n_files f ON f.work = o.work AND f.path = o.path),
told AS (SELECT d.work, d.note_id, s.file, s.text, s.image, CASE WHEN trim(coalesce(t.target_markdown, '')) <> '' THEN regexp_replace(t.target_markdown, '[<> ]', '', 'g') ELSE regexp_replace(regexp_replace(regexp_replace(coalesce(k.source_markdown, ''), '!\\[[^\\]]*\\]\\([^)]*\\)|^1\\. ', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[* `]', '', 'g') END AS plain,
  CASE WHEN trim(coalesce(t.target_markdown, '')) <> '' THEN t.target_markdown ELSE coalesce(k.source_markdown, '') END AS md FROM due d LEFT JOIN n_notes k ON k.work = d.work AND k.note_id = d.note_id LEFT JOIN n_targets t ON t.work = d.work AND t.note_id = d.note_id LEFT JOIN s ON s.work = d.work AND s.id = d.note_id),
want AS (SELECT DISTINCT work, note_id, image, unnest(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(([^()]+)\\)', 1)) AS ref FROM told WHERE file IS NOT NULL), placed AS (SELECT w.*, m.member FROM want w LEFT JOIN n_media m ON m.work = w.work AND m.ref = w.ref),
findings AS (
  SELECT work, 'EPUB' AS code, NULL AS ref, '' AS detail FROM n_works WHERE work = 'gone'
  UNION ALL SELECT work, 'DUP_ANCHOR', id, '' FROM a_ WHERE n > 1 UNION ALL SELECT work, 'DUP_ASIDE', id, '' FROM s_ WHERE n > 1
  UNION ALL SELECT work, 'NONE_UNEXPECTED', NULL, CAST(count(*) AS VARCHAR) FROM (SELECT work FROM a UNION ALL SELECT work FROM s) WHERE work = 'w11' GROUP BY work
  UNION ALL SELECT a.work, 'ORPHAN_ANCHOR', id, '' FROM a JOIN rest USING (work) LEFT JOIN n_refs r ON r.work = a.work AND r.ref_id = a.id WHERE r.work IS NULL
  UNION ALL SELECT s.work, 'ORPHAN_ASIDE', id, '' FROM s JOIN rest USING (work) LEFT JOIN due d ON d.work = s.work AND d.note_id = s.id WHERE d.work IS NULL
  UNION ALL SELECT work, code, ref_id, note_id FROM chain WHERE code IS NOT NULL
  UNION ALL SELECT work, 'ASIDE_MISSING', note_id, '' FROM told WHERE file IS NULL
  UNION ALL SELECT work, 'CONTENT_MISMATCH', note_id, '' FROM told WHERE replace(replace(text, ' ', ''), '*', '') <> replace(plain, '*', '')
  UNION ALL SELECT work, 'MEDIA_MISSING', note_id, 'source:' || string_agg(ref, ',' ORDER BY ref) FROM placed WHERE member IS NULL GROUP BY work, note_id
  UNION ALL SELECT work, 'MEDIA_MISSING', note_id, 'aside:' || string_agg(member, ',' ORDER BY member) FROM placed WHERE member IS NOT NULL AND member <> 'OEBPS/' || image GROUP BY work, note_id
  UNION ALL SELECT t.work, 'MEDIA_ABSENT', note_id, 'OEBPS/' || image FROM told t LEFT JOIN n_files f ON f.work = t.work AND f.path = 'OEBPS/' || image WHERE image <> '' AND f.path IS NULL)"""


def packages(spark, d):
    """work, path, html: the anchors and asides of each file, in their order."""
    a = ANCHORS.frame(spark, d).select("work", "file", "spot", F.concat(F.lit("<p>x<a epub:type='noteref' id=\""), "id", F.lit('" href="'), "href", F.lit('">1</a></p>')).alias("html"))
    image = F.when(F.col("image") != "", F.concat(F.lit('<img alt="" src="'), "image", F.lit('"/>'))).otherwise("")
    back = F.when(F.col("back") != "", F.concat(F.lit('<a epub:type="backlink" href="'), "back", F.lit('">↩</a>'))).otherwise("")
    s = ASIDES.frame(spark, d).select("work", "file", "spot", F.concat(F.lit('<aside class="n" epub:type="footnote" id="fn-'), "id", F.lit('"><p>[1]</p><p>'), F.replace(F.col("text"), F.lit("&"), F.lit("&#38;")), image, F.lit("</p>"), back, F.lit("</aside>")).alias("html"))
    pieces = F.array_sort(F.collect_list(F.struct("spot", "html")))
    docs = a.union(s).groupBy("work", F.concat(F.lit("OEBPS/"), "file").alias("path")).agg(F.array_join(F.transform(pieces, lambda x: x["html"]), "").alias("html"))
    return docs.union(spark.createDataFrame([("clean", "OEBPS/c0.xhtml", "<p>text <a href='#x'>x</a></p>")], "work string, path string, html string"))


@query(with_tables(WORKS, REFS, NOTES, TARGETS, ANCHORS, ASIDES, MEDIA, FILES) + RULES + " SELECT work, 'E_NOTES_' || code AS code, ref, detail FROM findings")
def notes_audit(spark, d):
    """All codes of the audit of notes; the pages are written out and read again by the operator."""
    tables = [x.frame(spark, d) for x in (WORKS, REFS, NOTES, TARGETS)]
    members = FILES.frame(spark, d)
    return n.audited_notes(*tables, members, packages(spark, d), MEDIA.frame(spark, d))
