"""Queries over evidence from pages and admission. Cases are worked by hand where the SQL only lists the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import evidence as e
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.plans.text import NOSPACE
from foliospark.session import read
from foliospark.sources.adapters import LINES, UNITS, lines, units


def listed(name: str, schema: str, *rows: tuple) -> str:
    table = Literal(name, schema, *rows)
    columns = ", ".join(f'"{c}"' for c, _ in table.fields)
    return with_tables(table).replace('check', '"check"') + f" SELECT {columns} FROM {name}"


SEGMENTS = Literal("segments", "work string, page long, line long, text string", ("a", 1, 1, "12"), ("a", 1, 2, "text 12"), ("a", 1, 3, "- 13 -"), ("a", 2, 1, "body"), ("a", 2, 2, "1968"), ("a", 2, 3, "more"), ("a", 3, 1, "第 3 页"), ("a", 3, 2, "p12"), ("a", 4, 1, "x"), ("a", 4, 2, "4")).also(
    "SELECT concat('s', source), doc_id, n, CASE WHEN n = 2 THEN substr(text, 1, 40) WHEN n = 1 THEN CASE doc_id % 5 WHEN 0 THEN concat('', doc_id % 3000) WHEN 1 THEN concat('- ', doc_id % 500, ' -') WHEN 2 THEN concat('p', doc_id % 900) ELSE substr(text, 1, 4) END ELSE CASE doc_id % 3 WHEN 0 THEN concat('第 ', doc_id % 90, ' 页') WHEN 1 THEN concat('', doc_id) ELSE 'end' END END FROM {documents} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) m"
)


KINDS = """edged AS (SELECT work, page, line, trim(text) AS text, line IN (min(line) OVER p, max(line) OVER p) AS edge FROM segments WINDOW p AS (PARTITION BY work, page)),
kinds AS (SELECT work, page, line, CASE WHEN regexp_full_match(text, '第\\s*\\d{1,4}\\s*页|\\d{1,4}\\s*页|[pP]\\d{1,4}') THEN 'label' WHEN regexp_full_match(text, '[\\s\\-—–·]*\\d{1,4}[\\s\\-—–·]*') AND regexp_matches(text, '[-—–·•]') THEN 'decorated' WHEN edge AND regexp_full_match(text, '\\d{1,4}') THEN 'candidate' END AS kind FROM edged)"""


@query(with_tables(SEGMENTS) + ", " + KINDS + " SELECT * FROM kinds WHERE kind IS NOT NULL")
def page_number_evidence(spark, d):
    return e.page_numbers(SEGMENTS.frame(spark, d))


BODY = "The body text of this page goes on for well over sixty characters, as bodies do."
BLOCKS = Literal(
    "page_blocks", "work string, page long, block long, text string, size double, y0 double, y1 double",
    *[("w", p, 1, BODY, 11.0, 50.0, 400.0) for p in (1, 2, 3, 4)], *[("w", p, 9, "The Journal of Examples", 8.0, 780.0, 790.0) for p in (1, 2, 3)],
    ("w", 1, 2, "1 See the first volume for the rest of", 8.0, 700.0, 740.0), ("w", 2, 2, "this long argument, which ends here.", 8.0, 690.0, 700.0), ("w", 2, 3, "2 Another note of decent length.", 8.0, 710.0, 740.0), ("w", 3, 2, "ALL CAPITALS SHOUTING HERE TOO", 8.0, 700.0, 740.0), ("w", 3, 3, "small but high up on the page", 8.0, 60.0, 70.0),
    ("w", 4, 2, "too short", 8.0, 700.0, 740.0), ("w", 4, 3, "a . . . . . . . . . . . . leader line 9", 8.0, 700.0, 740.0),
).also(
    "SELECT concat('s', source), CAST(floor(doc_id / 20) AS BIGINT), n, CASE n WHEN 9 THEN CASE WHEN doc_id % 3 = 0 THEN concat('The journal of ', source) ELSE concat(doc_id % 90, ' ', substr(replace(text, chr(10), ' '), 1, 60)) END WHEN 8 THEN substr(replace(text, chr(10), ' '), 61, 50) ELSE substr(replace(text, chr(10), ' '), 1, 300) END, CASE WHEN n > 7 THEN 8.0 ELSE 11.0 END, CASE n WHEN 1 THEN 50.0 ELSE 600.0 + 10 * n END, CASE n WHEN 1 THEN 500.0 ELSE 608.0 + 10 * n END FROM {documents} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 8 UNION ALL SELECT 9) m WHERE length(text) > 120"
)


BODIES = r"""weighed AS (SELECT work, page, size, unnest(range(0, greatest(1, length(text) // 20))) FROM page_blocks WHERE text <> ''), bodies AS (SELECT work, page, median(size) AS body FROM weighed GROUP BY ALL),
placed AS (SELECT p.*, body, max(y1) OVER (PARTITION BY p.work, p.page) AS bottom, lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g')) AS key FROM page_blocks p JOIN bodies USING (work, page)),
furniture AS (SELECT work, key, count(DISTINCT page) AS pages FROM placed WHERE length(text) >= 12 AND NOT regexp_matches(text, '^\s*\d{1,3}[\s.]') AND size <= body - 1.2 AND y0 >= bottom * 0.55 AND key <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3),
noted AS (SELECT p.* FROM placed p LEFT JOIN furniture f USING (work, key) WHERE f.key IS NULL AND length(text) >= 20 AND NOT (upper(text) = text AND regexp_matches(text, '\p{L}') AND length(text) < 100) AND len(regexp_extract_all(text, '\.\s*\.')) < 5
  AND size <= body - 1.2 AND (y0 >= bottom * 0.55 OR regexp_matches(text, '(?m)^\s*(?:\d{1,3}[\s.)]|\[\d{1,3}\]|[*†‡])')))"""


@query(with_tables(BLOCKS) + ", " + BODIES + " SELECT work, page, body FROM bodies")
def body_font_sizes(spark, d):
    return e.body_sizes(BLOCKS.frame(spark, d))


@query(with_tables(BLOCKS) + ", " + BODIES + " SELECT work, key, pages FROM furniture")
def footer_artefacts(spark, d):
    return e.artefacts(BLOCKS.frame(spark, d))


@query(with_tables(BLOCKS) + ", " + BODIES + " SELECT work, page, block FROM noted")
def note_blocks(spark, d):
    return e.note_blocks(BLOCKS.frame(spark, d))


@query(with_tables(BLOCKS) + ", " + BODIES + rf""", edges AS (SELECT work, page, min(block) AS block, arg_min(text, block) AS head, arg_max(text, block) AS tail FROM noted GROUP BY ALL),
after AS (SELECT *, lag(page) OVER (PARTITION BY work ORDER BY page) AS from_page, lag(tail) OVER (PARTITION BY work ORDER BY page) AS before FROM edges)
SELECT work, page, block, from_page FROM after WHERE from_page = page - 1 AND NOT contains('{(t.TERMINAL + t.CLOSERS).replace("'", "''")}', right(regexp_replace(before, '[\s\p{{Z}}]+$', ''), 1)) AND NOT regexp_matches(head, '^\s*(?:\d{{1,3}}[\s.)]|\[\d{{1,3}}\])')""")
def continued_notes(spark, d):
    return e.continued_notes(BLOCKS.frame(spark, d))


BLOCK_LINES = Literal(
    "block_lines", "block long, line long, text string, x0 double, size double",
    (1, 1, "First line of it", 60.0, 10.0), (1, 2, "goes on to its end.", 50.0, 10.0), (1, 3, "Set in after an end", 62.0, 10.0), (1, 4, "not ended", 50.0, 10.0), (1, 5, "set in but not after an end", 62.0, 10.0), (1, 6, "over.", 50.0, 10.0), (1, 7, "no indent", 50.0, 10.0),
    (2, 1, "Large print.", 50.0, 14.0), (2, 2, "Small print", 50.0, 10.0),
)


@query(listed("expected", "block long, line long, paragraph long", (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 2), (1, 6, 2), (1, 7, 2), (2, 1, 1), (2, 2, 2)))
def indented_paragraphs(spark, d):
    return e.indented_paragraphs(BLOCK_LINES.frame(spark))


ITEMS = Literal(
    "items", "ord long, type string, page_idx long, text string, level long",
    (1, "header", 0, "Head", None), (2, "text", 0, " Intro ", None), (3, "title", 0, "One", 1), (4, "image", 0, None, None), (5, "table", 0, "t", None), (6, "equation", 0, "a=b", None), (7, "equation", 1, "$$c$$", None), (8, "text", 1, "  ", None), (9, "image", 1, "", None), (10, "image", 0, "", None), (11, "text", 1, "Two", 2), (12, "footer", 1, "f", None), (13, "equation", 1, "", None),
)
SEGMENTED = [
    (2, 1, "text", "Intro", None), (3, 1, "heading", "One", None), (4, 1, "insert", "", "fig-p001-01"), (5, 1, "insert", "t", "table-p001-01"), (6, 1, "formula", "$$a=b$$", "formula-p001-01"), (7, 2, "formula", "$$c$$", "formula-p002-01"), (9, 2, "insert", "", "fig-p002-01"), (10, 1, "insert", "", "fig-p001-02"), (11, 2, "heading", "Two", None),
]


@query(listed("expected", "ord long, page long, kind string, text string, insert_id string", *SEGMENTED))
def content_segments(spark, d):
    return e.content_segments(ITEMS.frame(spark))


@query(listed("expected", "work string, unit long, title string, n_segments long", ("w", 0, None, 1), ("w", 1, "One", 7), ("w", 2, "Two", 1)))
def heading_units(spark, d):
    return e.heading_units(e.content_segments(ITEMS.frame(spark)).withColumn("work", F.lit("w")))


MARKED = Literal("marked", "work string, line long, text string", ("w", 1, "front"), ("w", 2, "[]{#one.xhtml}"), ("w", 3, "a"), ("w", 4, " []{#two.xhtml} "), ("w", 5, "b"), ("v", 1, "none")).also(
    "SELECT concat('s', source), doc_id, CASE WHEN doc_id % 6 = 0 THEN concat('[]', chr(123), '#a', doc_id, '.xhtml', chr(125)) ELSE substr(text, 1, 30) END FROM {documents}"
)


@query(with_tables(MARKED) + r""", m AS (SELECT *, nullif(regexp_extract(text, '^\s*\[\]\{#([^}]+)\}\s*$', 1), '') AS mark FROM marked)
SELECT work, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY work ORDER BY line), first_value(mark IGNORE NULLS) OVER (PARTITION BY work ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS anchor, line, text FROM m""")
def spine_anchors(spark, d):
    return e.anchored(MARKED.frame(spark, d))


PUNCT = Literal("punct", "id long, s string", (1, 'He «said» "yes" and "no'), (2, "wait... \""), (3, ""), (4, "plain"), (5, '""')).also(
    "SELECT 100 + doc_id, concat('«', substr(text, 1, 20), '»', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' \"a\"' WHEN 2 THEN ' \"b\" ... \"c' ELSE '\"\"\"' END, substr(text, 21, 30)) FROM {documents}"
)


@query(with_tables(PUNCT) + """, p AS (SELECT id, string_split(replace(replace(replace(s, '«', '《'), '»', '》'), '...', '…'), '"') AS p FROM punct)
SELECT id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) THEN CASE WHEN len(p) % 2 = 0 THEN '」' ELSE '' END WHEN i % 2 = 1 THEN '「' ELSE '」' END), '') AS normal FROM p""")
def target_punctuation(spark, d):
    return PUNCT.frame(spark, d).select("id", e.punctuation(F.col("s")).alias("normal"))


NOTE_PAIRS = Literal("note_pairs", "id long, source_md string, target_md string", (1, "A note", ""), (2, "A note", "A  note"), (3, "A note", "一条注"), (4, "A note", "A note 注"), (5, "", ""), (6, "x", "7"), (7, "Abc", "ab注")).also(
    "SELECT 100 + doc_id, substr(text, 1, 12), CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat(' ', substr(text, 1, 6), '  ', substr(text, 7, 6)) WHEN 2 THEN concat('注释', doc_id) WHEN 3 THEN concat('abc注', doc_id) WHEN 4 THEN concat('注注注注 ab', doc_id) ELSE concat('note ', doc_id) END FROM {documents}"
)


@query(with_tables(NOTE_PAIRS) + f""", m AS (SELECT *, length(regexp_replace(target_md, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(target_md, '[^㐀-䶿一-鿿]', '', 'g')) AS han, {NOSPACE.format('source_md')} AS a, {NOSPACE.format('target_md')} AS b FROM note_pairs),
k AS (SELECT id, [CASE WHEN trim(source_md) <> '' AND trim(target_md) = '' THEN 'missing_target' END, CASE WHEN trim(source_md) <> '' AND a = b THEN 'identical_to_source' END, CASE WHEN latin > 0 AND han = 0 THEN 'no_target_script' END, CASE WHEN han > 0 AND latin >= 3 AND 2 * han < latin + han THEN 'low_target_script' END] AS codes FROM m)
SELECT id, array_to_string(list_filter(codes, lambda x: x IS NOT NULL), ',') AS signals FROM k""")
def note_signals(spark, d):
    return e.target_signals(NOTE_PAIRS.frame(spark, d), "zh-CN")


MEDIA_REFS = Literal("media_refs", "work string, ref string", ("a", "media/x.png"), ("a", "./media/y.png"), ("a", "old/media/x.png"), ("a", "deep/z.png"), ("a", "gone.png"), ("a", "mapped.png"), ("a", "../up/z.png")).also(
    "SELECT concat('w', p_partkey % 6), concat(CASE p_partkey % 5 WHEN 0 THEN 'media/' WHEN 1 THEN './media/' WHEN 2 THEN 'old/media/' WHEN 3 THEN 'deep/' ELSE '' END, 'f', p_size, '.png', CASE WHEN p_partkey % 7 = 0 THEN '?v=1' ELSE '' END) FROM {part}"
)
FILES = Literal("files", "work string, path string", ("a", "media/x.png"), ("a", "media/y.png"), ("a", "z.png"), ("a", "new/m.png"), ("b", "gone.png")).also(
    "SELECT DISTINCT concat('w', p_partkey % 6), concat(CASE WHEN p_size % 2 = 0 THEN 'media/' ELSE '' END, 'f', p_size, '.png') FROM {part} WHERE p_partkey % 3 < 2"
)
MAPPED = Literal("mapped", "work string, ref string, path string", ("a", "mapped.png", "new/m.png"), ("a", "gone.png", "nowhere.png")).also("SELECT DISTINCT concat('w', p_partkey % 6), concat('deep/f', p_size, '.png'), concat('media/f', p_size + 1, '.png') FROM {part} WHERE p_size % 5 = 0")


@query(with_tables(MEDIA_REFS, FILES, MAPPED) + r""", r AS (SELECT DISTINCT work, ref, regexp_replace(regexp_replace(trim(ref), '^(?:\./)+|^/+', ''), '[?#].*$', '') AS clean FROM media_refs),
tries AS (SELECT work, ref, 1 AS rank, 'exact' AS strategy, clean AS path FROM r UNION ALL SELECT work, ref, 2, 'root', regexp_replace(clean, '^.*media/', 'media/') FROM r UNION ALL SELECT work, ref, 3, 'basename', regexp_extract(clean, '([^/]*)$', 1) FROM r),
every_ AS (SELECT * FROM tries WHERE NOT contains(path, '../') UNION ALL SELECT work, ref, 0, 'mapped', path FROM mapped), hit AS (SELECT e.*, row_number() OVER (PARTITION BY e.work, ref ORDER BY rank, strategy, e.path) AS n FROM every_ e JOIN (SELECT DISTINCT work, path FROM files) f ON f.work = e.work AND f.path = e.path)
SELECT r.work, r.ref, h.path, coalesce(h.strategy, 'missing') AS strategy FROM r LEFT JOIN hit h ON h.work = r.work AND h.ref = r.ref AND n = 1""")
def media_resolution(spark, d):
    return e.resolved_media(MEDIA_REFS.frame(spark, d), FILES.frame(spark, d), MAPPED.frame(spark, d), basename=True)


STANDING = Literal("standing_errata", "unit string, locator string, reading string, evidence string, status string", ("a", "p1", "old", "e", "confirmed"), ("a", "p2", "old", "e", "proposed")).also(
    "SELECT concat('u', doc_id % 50), concat('p', doc_id), concat('old ', doc_id), 'e', CASE WHEN doc_id % 3 = 0 THEN 'confirmed' ELSE 'proposed' END FROM {documents} WHERE doc_id % 4 <> 1"
)
BATCH = Literal("batch_errata", "unit string, locator string, reading string, evidence string, status string", ("a", "p1", "new", "e", "proposed"), ("a", "p2", "new", "e", "confirmed"), ("b", "p1", "new", "e", "proposed")).also(
    "SELECT concat('u', doc_id % 50), concat('p', doc_id), concat('new ', doc_id), 'e', CASE WHEN doc_id % 5 = 0 THEN 'confirmed' ELSE 'proposed' END FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 7 = 1"
)
BAD = Literal("bad_errata", "unit string, locator string, reading string, evidence string, status string", ("a", "p3", "", "e", "odd"), ("a", "p4", "r", "e", "proposed"), ("a", "p4", "r", "e", "proposed")).also(
    "SELECT CASE WHEN doc_id % 23 = 5 THEN ' ' ELSE concat('u', CAST(floor(doc_id / 20) AS BIGINT)) END, concat('p', doc_id - CASE WHEN doc_id % 9 = 4 THEN 1 ELSE 0 END), CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE 'r' END, CASE WHEN doc_id % 8 = 3 THEN NULL ELSE 'e' END, CASE doc_id % 10 WHEN 7 THEN 'odd' WHEN 8 THEN NULL ELSE 'proposed' END FROM {documents}"
)


@query(with_tables(STANDING, BATCH) + """ SELECT coalesce(n.unit, s.unit) AS unit, coalesce(n.locator, s.locator) AS locator, CASE WHEN n.unit IS NULL OR (s.status = 'confirmed' AND n.status = 'proposed') THEN s.reading ELSE n.reading END AS reading,
CASE WHEN n.unit IS NULL OR (s.status = 'confirmed' AND n.status = 'proposed') THEN s.status ELSE n.status END AS status FROM standing_errata s FULL JOIN batch_errata n ON n.unit = s.unit AND n.locator = s.locator""")
def errata_merge(spark, d):
    return e.errata(STANDING.frame(spark, d), BATCH.frame(spark, d))[0].select("unit", "locator", "reading", "status")


@query(with_tables(BAD) + """, b AS (SELECT *, count(*) OVER (PARTITION BY unit, locator) AS n FROM bad_errata) SELECT DISTINCT unit, locator, code FROM (SELECT unit, locator, 'unit_missing' AS code FROM b WHERE trim(unit) = '' UNION ALL SELECT unit, locator, 'reading_missing' FROM b WHERE trim(reading) = '' UNION ALL SELECT unit, locator, 'evidence_missing' FROM b WHERE trim(coalesce(evidence, '')) = ''
UNION ALL SELECT unit, locator, 'status' FROM b WHERE status IS NULL OR status NOT IN ('proposed', 'confirmed') UNION ALL SELECT unit, locator, 'repeated' FROM b WHERE n > 1)""")
def errata_violations(spark, d):
    return e.errata(STANDING.frame(spark, d), BAD.frame(spark, d))[1]


CANDS = Literal(
    "cands", "candidate_id string, unit string, line long, kind string, label string, disposition string, ref_id string, note_id string",
    ("c1", "u1", 1, "marker", "1", "note", "r1", None), ("c2", "u1", 2, "marker", "1", "note", "r1", None), ("c3", "u2", 3, "pandoc_ref", "1", "note", "r1", None), ("c4", "u1", 4, "marker", "2", "note", "r1", None), ("c5", "u1", 5, "marker", "2", "note", None, "n1"), ("c6", "u1", 6, "marker", "2", "not_note", None, None),
    ("c7", "u1", 7, "definition", "1", "note", None, "n1"), ("c8", "u1", 8, "definition", "1", "note", None, "n1"), ("c9", "u1", 9, "numbered_paragraph", "1", "note", None, "n9"), ("d1", "u1", 11, "definition", "1", "note", None, "n1"), ("d2", "u1", 12, "marker", "3", "note", "r9", None),
)
CAND_REFS = Literal("cand_refs", "ref_id string, unit string, label string", ("r1", "u1", "1"))
CAND_PLACES = Literal("cand_places", "note_id string, candidate_id string, unit string, line long", ("n1", "c7", "u1", 7), ("n1", "d1", "u1", 99))


@query(listed("expected", "candidate_id string, code string", ("c2", "used_twice"), ("c3", "other_unit"), ("c4", "other_label"), ("c5", "ref_missing"), ("c8", "place_missing"), ("c9", "note_unknown"), ("d1", "place_differs"), ("d2", "ref_unknown")))
def candidate_bindings(spark, d):
    return e.bound_candidates(CANDS.frame(spark), CAND_REFS.frame(spark), spark.createDataFrame([("n1",)], "note_id string"), CAND_PLACES.frame(spark))


HEAD_LINES = Literal("head_lines", "unit string, line long, text string", ("u", 1, "# One"), ("u", 2, "## **Two**"), ("u", 3, "text"), ("u", 4, "## {#x}"), ("u", 5, "### Three {#own}"), ("u", 6, "## Four")).also(
    "SELECT concat('p', p_partkey % 50), p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '### ' WHEN 3 THEN '##  ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN '**' ELSE '' END, p_name, CASE WHEN p_partkey % 3 = 0 THEN '**' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN concat(' ', chr(123), '#x', p_partkey, chr(125)) ELSE '' END) FROM {part}"
)


@query(with_tables(HEAD_LINES) + r""", h AS (SELECT unit, line, length(regexp_extract(text, '^(#{2,6})[ \t]+\S', 1)) AS level, text FROM head_lines WHERE regexp_matches(text, '^#{2,6}[ \t]+\S')), n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY line) AS n, regexp_extract(text, '\{#([^}\s]+)\}\s*$', 1) AS own FROM h),
k AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(text, '^#+[ \t]+', ''), '\{#[^}]*\}\s*$', '')), '[*_`]+', '', 'g') AS title FROM n) SELECT unit, level, title, CASE WHEN own <> '' THEN own ELSE unit || '-h' || n END AS anchor FROM k WHERE title <> ''""")
def subheading_anchors(spark, d):
    return e.anchors_of(HEAD_LINES.frame(spark, d))


IMPORTED = Literal("import_units", "unit string, n_rows long, changed boolean", ("a", 3, True), ("b", 0, True), ("c", 2, True), ("d", 2, False), ("e", 1, True)).also(
    "SELECT concat('d', doc_id), doc_id % 5, doc_id % 4 <> 0 FROM {documents}"
)
IMPORT_FINDINGS = Literal("import_findings", 'unit string, check string, blocking boolean, reverse boolean', ("a", "marker", True, None), ("a", "length", False, None), ("c", "fidelity", True, True), ("c", "terminology", True, None), ("e", "fidelity", True, False), ("d", "length", True, None)).also(
    "SELECT concat('d', doc_id - doc_id % 2), CASE doc_id % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'fidelity' WHEN 2 THEN 'terminology' WHEN 3 THEN 'length' ELSE 'length_review' END, doc_id % 3 <> 0, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 = 0 END FROM {documents}"
)


@query(with_tables(IMPORTED, IMPORT_FINDINGS).replace("check", '"check"').replace('""check""', '"check"') + """, f AS (SELECT unit, count_if(hard) AS errors, count_if(NOT hard) AS warnings FROM (SELECT unit, blocking AND ("check" IN ('language', 'length', 'length_review') OR ("check" = 'fidelity' AND coalesce(reverse, false))) AS hard FROM import_findings) GROUP BY unit)
SELECT u.unit, CASE WHEN n_rows = 0 THEN 'pending' WHEN NOT changed THEN 'skipped' WHEN coalesce(errors, 0) > 0 THEN 'failed' ELSE 'imported' END AS outcome, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM import_units u LEFT JOIN f USING (unit)""")
def import_admission(spark, d):
    return e.admission(IMPORTED.frame(spark, d), IMPORT_FINDINGS.frame(spark, d))


FOUND = Literal("found_findings", "unit string, block long, code string, digest string", ("a", 1, "x", "d1"), ("a", None, "y", "d2"), ("a", 2, "x", "d3"), ("b", 1, "z", "d4")).also(
    "SELECT concat('s', source), doc_id, concat('c', doc_id % 3), concat('d', doc_id % 7) FROM {documents}"
)
DECIDED = Literal("decided", "unit string, block long, code string, digest string, disposition string", ("a", 1, "x", "d1", "accepted"), ("a", None, "y", "old", "accepted"), ("c", None, "x", "d", "fixed")).also(
    "SELECT concat('s', source), doc_id + doc_id % 2, concat('c', doc_id % 3), concat('d', doc_id % 7 + doc_id % 2), CASE WHEN doc_id % 4 < 2 THEN 'accepted' ELSE 'fixed' END FROM {documents} WHERE doc_id % 3 <> 2"
)


@query(with_tables(FOUND, DECIDED) + """ SELECT f.unit, f.block, f.code, CASE WHEN disposition IS NULL THEN 'open' WHEN f.digest = d.digest THEN disposition ELSE 'stale' END AS status FROM found_findings f LEFT JOIN decided d ON f.unit = d.unit AND f.block IS NOT DISTINCT FROM d.block AND f.code = d.code
UNION ALL SELECT unit, block, code, 'gone' FROM decided d WHERE NOT EXISTS (SELECT 1 FROM found_findings f WHERE f.unit = d.unit AND f.block IS NOT DISTINCT FROM d.block AND f.code = d.code)""")
def hygiene_dispositions(spark, d):
    return e.dispositions(FOUND.frame(spark, d), DECIDED.frame(spark, d))


@query(f"WITH {UNITS}, x AS (SELECT work, unit, sha256(text) AS digest FROM units) SELECT work, unit::VARCHAR AS unit, digest FROM x UNION ALL SELECT work, '*', sha256(string_agg(concat_ws(':', unit, digest), chr(10) ORDER BY unit)) FROM x GROUP BY work")
def inputs_digest(spark, d):
    return e.inputs_digest(units(spark, d).select("work", F.col("unit").alias("ord"), F.col("unit").cast("string").alias("unit"), "text"))


IMAGES = Literal("images", "work string, page long, type string, x0 double, y0 double, x1 double, y1 double", ("a", 1, "image", 0.0, 0.0, 10.0, 10.0), ("a", 1, "text", 0.0, 0.0, 99.0, 99.0), ("a", 2, "image", 0.0, 0.0, 20.0, 10.0), ("a", 3, "image", 0.0, 0.0, 5.0, 5.0), ("a", 3, "image", 0.0, 0.0, 1.0, 1.0), ("a", 9, "image", 0.0, 0.0, 50.0, 50.0)).also(
    "SELECT concat('c', o_custkey % 60), o_orderkey % 6, CASE WHEN o_orderkey % 4 = 0 THEN 'text' ELSE 'image' END, CAST(o_orderkey % 7 AS DOUBLE), 0.0, CAST(10 + o_orderkey % 97 AS DOUBLE), CAST(5 + o_custkey % 31 AS DOUBLE) FROM {orders} WHERE o_orderkey < 4000"
)


@query(with_tables(IMAGES) + ", r AS (SELECT work, page, (x1 - x0) * (y1 - y0) AS area FROM images WHERE page <= 3 AND type = 'image') SELECT work, page, area FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY area DESC, page) AS n FROM r) WHERE n <= 3")
def cover_candidates(spark, d):
    return e.covers(IMAGES.frame(spark, d))


@query("""WITH p AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT source, n, coalesce(text, '') AS text FROM p WHERE n <= 500 OR doc_id % 5 = 0)
SELECT source AS work, max(n) AS n_pages, round(avg(CASE WHEN trim(text) = '' THEN 1.0 ELSE 0.0 END), 4) AS empty_ratio, round(coalesce(sum(length(text) - length(replace(text, chr(65533), ''))) / nullif(sum(length(text)), 0), 0.0), 4) AS garbled_ratio, round(avg(CASE WHEN trim(text) = '' THEN 1.0 ELSE 0.0 END), 4) >= 0.6 AS scanned FROM s GROUP BY source""")
def sampled_pages(spark, d):
    return e.sampled_pages(read(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text")))


P_UNITS = Literal("p_units", "work string, unit string, place long", ("w", "a", 1), ("w", "b", 2), ("w", "c", 3), ("w", "d", 4)).also(
    "SELECT concat('s', source), concat('u', doc_id), doc_id FROM {documents} WHERE doc_id % 9 <> 0"
)
P_SPINE = Literal("p_spine", "work string, unit string, place long", ("w", "a", 1), ("w", "c", 2), ("w", "b", 3), ("w", "x", 4)).also(
    "SELECT concat('s', source), concat('u', doc_id), CASE WHEN doc_id % 13 = 0 THEN doc_id - 90 ELSE doc_id END FROM {documents} WHERE doc_id % 7 <> 0"
)
P_NAV = Literal("p_nav", "work string, unit string, place long", ("w", "a", 1), ("w", "b", 2), ("w", "y", 3)).also(
    "SELECT concat('s', source), concat('u', doc_id), doc_id FROM {documents} WHERE doc_id % 5 <> 0"
)


@query(with_tables(P_UNITS, P_SPINE, P_NAV) + """, j AS (SELECT u.work, u.unit, u.place AS u, s.place AS s, max(s.place) OVER (PARTITION BY u.work ORDER BY u.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM p_units u LEFT JOIN p_spine s USING (work, unit))
SELECT work, unit, 'unit_missing' AS code FROM j WHERE s IS NULL UNION ALL SELECT work, unit, 'unit_order' FROM j WHERE high > s UNION ALL SELECT work, unit, 'spine_unknown' FROM p_spine s WHERE NOT EXISTS (SELECT 1 FROM p_units u WHERE u.work = s.work AND u.unit = s.unit)
UNION ALL SELECT work, unit, 'nav_missing' FROM p_units u WHERE NOT EXISTS (SELECT 1 FROM p_nav n WHERE n.work = u.work AND n.unit = u.unit) UNION ALL SELECT work, unit, 'nav_dangling' FROM p_nav n WHERE NOT EXISTS (SELECT 1 FROM p_spine s WHERE s.work = n.work AND s.unit = n.unit)""")
def provenance(spark, d):
    return e.provenance(P_UNITS.frame(spark, d), P_SPINE.frame(spark, d), P_NAV.frame(spark, d))


@query(f"""WITH {LINES}, k AS (SELECT work, unit % 2 AS side, {NOSPACE.format('text')} AS norm FROM lines), a AS (SELECT work, norm, count(*) AS a FROM k WHERE side = 0 GROUP BY ALL), b AS (SELECT work, norm, count(*) AS b FROM k WHERE side = 1 GROUP BY ALL)
SELECT work, norm, a - coalesce(b, 0) AS lost FROM a LEFT JOIN b USING (work, norm) WHERE a - coalesce(b, 0) > 0""")
def lines_lost(spark, d):
    x = lines(spark, d).select("work", "unit", t.without_blanks(F.col("text")).alias("norm"))
    return e.multiset_difference(x.where("unit % 2 = 0"), x.where("unit % 2 = 1"), ["work", "norm"])


R_NOTES = Literal("r_notes", "note_id string", ("n1",), ("n2",), ("n3",), ("n4",)).also(
    "SELECT concat('m', doc_id) FROM {documents} WHERE doc_id % 10 <> 0"
)
R_REFS = Literal("r_refs", "ref_id string, note_id string", ("r1", "n1"), ("r2", "n2"), ("r3", "n9"), ("r4", "n1"), ("r5", "n3"), ("r6", "n4")).also(
    "SELECT concat('q', doc_id), concat('m', doc_id) FROM {documents}"
)
R_ANCHORS = Literal("r_anchors", "ref_id string, file string, href_file string, fragment string", ("r1", "c1", "c1", "fn-n1"), ("r2", "c1", "c1", "fn-n1"), ("r3", "c1", "c1", "fn-n9"), ("r5", "c1", "c2", "fn-n3"), ("r6", "c2", "c2", "fn-n4")).also(
    "SELECT concat('q', doc_id), concat('c', doc_id % 4), concat('c', (doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 4), CASE WHEN doc_id % 8 = 0 THEN 'other' ELSE concat('fn-m', doc_id) END FROM {documents} WHERE doc_id % 9 <> 0"
)
R_ASIDES = Literal("r_asides", "note_id string, file string, back_file string, back_ref string", ("n1", "c1", "c1", "r1"), ("n3", "c1", "c1", "r5"), ("n4", "c2", "c2", "r5")).also(
    "SELECT concat('m', doc_id), concat('c', doc_id % 4), concat('c', doc_id % 4), CASE WHEN doc_id % 11 = 0 THEN 'q0' ELSE concat('q', doc_id) END FROM {documents} WHERE doc_id % 7 <> 0"
)


@query(with_tables(R_REFS, R_ANCHORS, R_ASIDES, R_NOTES) + """, j AS (SELECT r.ref_id, r.note_id, k.note_id IS NULL AS unknown, a.file, a.href_file, a.fragment, s.note_id IS NULL AS no_aside, s.back_file, s.back_ref FROM r_refs r LEFT JOIN r_notes k ON k.note_id = r.note_id LEFT JOIN r_anchors a ON a.ref_id = r.ref_id LEFT JOIN r_asides s ON s.note_id = r.note_id AND s.file = a.href_file)
SELECT * FROM (SELECT ref_id, CASE WHEN unknown THEN 'note_unknown' WHEN file IS NULL THEN 'anchor_missing' WHEN fragment <> 'fn-' || note_id THEN 'href_wrong' WHEN no_aside THEN 'aside_missing' WHEN back_file <> file OR back_ref <> ref_id THEN 'backlink_missing' END AS code FROM j) WHERE code IS NOT NULL""")
def registered_notes(spark, d):
    return e.registered_notes(R_REFS.frame(spark, d), R_ANCHORS.frame(spark, d), R_ASIDES.frame(spark, d), R_NOTES.frame(spark, d))


MD = Literal("media_md", "unit string, side string, md string", ("h", "s", "[x]{original-image-src=\"a.png\"} ![x](b.png) `![n](no.png)`\n```\n![n](no.png)\n```\n<img src=\"c.png\">"), ("h", "t", "![x](b.png) [x]{original-image-src=\"a.png\"}"), ("g", "s", "![x](b.png) ![x](d.png)"), ("g", "t", "![x](d.png) ![x](b.png)"))
MD.also("SELECT concat('u', doc_id), side, concat(substr(text, 1, 40), ' ![x](m', doc_id % 7, '.png)', CASE WHEN doc_id % 3 = 0 AND side = 't' THEN '' ELSE concat(' ![](n', doc_id % 5, '.png) ') END, CASE WHEN doc_id % 4 = 0 THEN '<img alt=\"\" src=\"h.png\">' ELSE '' END) FROM {documents} CROSS JOIN (SELECT 's' AS side UNION ALL SELECT 't') m")
#: Code is in the literal rows alone; it is cut out by its marks.
MEDIA_SQL = r"""bare AS (SELECT unit, side, regexp_replace(regexp_replace(md, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g') AS md FROM media_md),
refs AS (SELECT unit, side, list_concat(list_concat(regexp_extract_all(md, 'original-image-src="([^"]+)"', 1), regexp_extract_all(md, '<img[^>]*src="([^"]+)"', 1)), regexp_extract_all(md, '!\[[^\]]*\]\(([^()]+)\)', 1)) AS l FROM bare),
media AS (SELECT unit, side, unnest(range(0, len(l))) AS place, unnest(l) AS ref FROM refs)"""


@query(with_tables(MD) + ", " + MEDIA_SQL + " SELECT unit || '/' || side AS unit, place, ref FROM media")
def media_references(spark, d):
    return e.media_refs(MD.frame(spark, d).select(F.concat_ws("/", "unit", "side").alias("unit"), "md"))


@query(with_tables(MD) + ", " + MEDIA_SQL + """, c AS (SELECT unit, ref, count_if(side = 's') AS a, count_if(side = 't') AS b FROM media GROUP BY ALL),
k AS (SELECT m.unit, side, list(m.ref ORDER BY place) AS l FROM media m JOIN c ON c.unit = m.unit AND c.ref = m.ref AND a > 0 AND b > 0 GROUP BY ALL)
SELECT unit, 'lost' AS code, ref FROM c WHERE a > b UNION ALL SELECT x.unit, 'order', NULL FROM k x JOIN k y ON x.unit = y.unit AND x.side = 's' AND y.side = 't' WHERE x.l <> y.l""")
def media_kept(spark, d):
    both = MD.frame(spark, d)
    return e.media_kept(*[e.media_refs(both.where(F.col("side") == side).select("unit", "md")) for side in "st"])


EDITS = Literal("edit_files", "work string, path string, content string", ("h", "a", "one"), ("h", "b", "two"))
EDITS.also("SELECT concat('w', CAST(floor(doc_id / 4) AS BIGINT)), concat('f', doc_id), CASE WHEN doc_id % 11 = 0 THEN concat('new ', doc_id) ELSE concat('old ', doc_id % 50) END FROM {documents}")
PLAN = Literal("edit_plan", "work string, path string, old_content string, after string", ("h", "a", "one", "1"), ("h", "c", "x", "y"))
PLAN.also("SELECT concat('w', CAST(floor(doc_id / 4) AS BIGINT)), concat('f', doc_id), concat('old ', doc_id % 50), concat('new ', doc_id) FROM {documents} WHERE doc_id % 4 < 2 AND doc_id % 16 < 12")


@query(with_tables(EDITS, PLAN) + """, j AS (SELECT p.work, count_if(content IS NULL OR sha256(content) <> sha256(old_content)) AS stale, count_if(content IS DISTINCT FROM after) AS undone FROM edit_plan p LEFT JOIN edit_files f ON f.work = p.work AND f.path = p.path GROUP BY 1),
s AS (SELECT work, CASE WHEN undone = 0 THEN 'already_applied' WHEN stale = 0 THEN 'applied' ELSE 'refused' END AS status FROM j)
SELECT f.work, f.path, CASE WHEN status = 'applied' AND after IS NOT NULL THEN after ELSE content END AS content, coalesce(status, 'untouched') AS status FROM edit_files f LEFT JOIN s ON s.work = f.work LEFT JOIN edit_plan p ON p.work = f.work AND p.path = f.path""")
def edit_plans(spark, d):
    plan = PLAN.frame(spark, d).select("work", "path", F.sha2(F.col("old_content").cast("binary"), 256).alias("old_sha256"), "after")
    return e.applied_edits(EDITS.frame(spark, d), plan)
