"""Queries over pages, packages, contents and indexes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from foliospark.functions.udfs import image_size, nfkc
from foliospark.operators import audit as a, package as p, toc
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.session import read
from foliospark.sources.adapters import PACKAGES, package_members
from foliospark.sources.archive import members


@query("""SELECT page_id, trim(regexp_extract(substr(html, 1, 200000), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(substr(html, 1, 200000), '(?i)<html[^>]*\\blang=["'']([^"'']+)["'']', 1)) AS language, '' AS og_title FROM pages""")
def html_sniff(spark, d):
    return p.page_facts(read(spark, d, "pages"))


LINKS = """found AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1) AS l FROM pages), each AS (SELECT page_id, unnest(range(0, len(l))) AS place, unnest(l) AS href FROM found),
links AS (SELECT *, CASE WHEN starts_with(lower(trim(href)), '#') THEN 'fragment' WHEN regexp_matches(lower(trim(href)), '^(?:javascript|data|vbscript):') THEN 'unsafe' WHEN regexp_matches(lower(trim(href)), '^(?:[a-z][a-z0-9+.-]*:)?//|^mailto:') THEN 'remote' ELSE 'local' END AS scope FROM each)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def html_links(spark, d):
    return p.links(read(spark, d, "pages"))


@query(f"WITH {LINKS} SELECT href, scope, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM links GROUP BY ALL")
def html_link_targets(spark, d):
    return p.links(read(spark, d, "pages")).groupBy("href", "scope").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?is)(<h[1-6]\\b[^>]*>.*?</h[1-6]\\s*>)', 1) AS l FROM pages), e AS (SELECT page_id, unnest(range(0, len(l))) AS place, unnest(l) AS mark FROM m)
SELECT page_id, place, CAST(substr(mark, 3, 1) AS BIGINT) AS level, trim(regexp_replace(mark, '<[^>]*>', '', 'g')) AS text FROM e""")
def html_headings(spark, d):
    return p.heading_entries(read(spark, d, "pages"))


HEADINGS = Literal("headings", "page_id long, place long, level long", (1, 0, 1), (1, 1, 3), (1, 2, 2), (1, 3, 4), (2, 0, 1), (2, 1, 2), (2, 2, 2), (2, 3, 1), (3, 0, 4), (4, 0, 2), (4, 1, 6)).also(
    "SELECT CAST(floor(doc_id / 10) AS BIGINT) + 100, doc_id % 10, 1 + (doc_id * 7) % 5 FROM {documents}"
)


@query(with_tables(HEADINGS) + """, b AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY place) AS before FROM headings), j AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM b WHERE level > before + 1) SELECT page_id, place, level, before FROM j WHERE n = 1""")
def html_heading_skip(spark, d):
    return p.heading_skips(HEADINGS.frame(spark, d))


@query("""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>', ' ', 'g') AS bare FROM pages)
SELECT page_id, 'no_lang' AS code FROM b WHERE NOT regexp_matches(html, '(?i)<html[^>]*\\blang=') UNION ALL SELECT page_id, 'h1_count' FROM b WHERE len(regexp_extract_all(html, '(?i)<h1\\b')) <> 1
UNION ALL SELECT page_id, 'atx_residue' FROM b WHERE regexp_matches(bare, '(?m)^\\s*#{1,6}\\s\\S') UNION ALL SELECT page_id, 'marker_residue' FROM b WHERE regexp_matches(bare, '\\[\\^[^\\]\\s]+\\]|\\{\\w+:\\d+\\}')
UNION ALL SELECT page_id, 'bold_residue' FROM b WHERE regexp_matches(bare, '\\*\\*[^*\\s][^*]*\\*\\*') UNION ALL SELECT page_id, 'math_residue' FROM b WHERE regexp_matches(bare, '\\$[^$\\s][^$]*\\$') UNION ALL SELECT page_id, 'img_no_alt' FROM b WHERE len(list_filter(regexp_extract_all(html, '(?is)<img\\b[^>]*'), lambda x: NOT contains(x, 'alt='))) > 0
UNION ALL SELECT page_id, 'img_remote' FROM b WHERE regexp_matches(html, '(?i)<img\\b[^>]*\\bsrc=.https?:') UNION ALL SELECT page_id, 'unclosed' FROM b WHERE NOT regexp_matches(html, '(?i)</html\\s*>')""")
def html_residue(spark, d):
    return p.residue(read(spark, d, "pages"))


MEMBERS = Literal(
    "members", "work string, path string, ord long, stored boolean, body string",
    ("a", "mimetype", 1, True, "application/epub+zip"), ("a", "META-INF/container.xml", 2, False, ""), ("a", "OEBPS/c1.xhtml", 3, False, ""), ("b", "c1.xhtml", 1, False, ""), ("b", "c1.xhtml", 2, False, ""), ("b", "mimetype", 3, True, "application/epub+zip"),
    ("c", "mimetype", 1, False, "text/plain"), ("c", "META-INF/container.xml", 2, False, ""),
)
MEMBER_REFS = Literal("member_refs", "work string, path string, target string", ("a", "OEBPS/c1.xhtml", "OEBPS/c1.xhtml"), ("a", "OEBPS/c1.xhtml", "OEBPS/x.png"), ("c", "q", "META-INF/container.xml"))


@query(with_tables(MEMBERS, MEMBER_REFS) + """, f AS (SELECT work, arg_min(path, ord) AS path, arg_min(stored, ord) AS stored, arg_min(body, ord) AS body FROM members GROUP BY work)
SELECT work, 'mimetype_first' AS code, path FROM f WHERE path <> 'mimetype' UNION ALL SELECT work, 'mimetype_stored', path FROM f WHERE path = 'mimetype' AND NOT stored UNION ALL SELECT work, 'mimetype_content', path FROM f WHERE path = 'mimetype' AND trim(body) <> 'application/epub+zip'
UNION ALL SELECT work, 'path_twice', path FROM members GROUP BY work, path HAVING count(*) > 1 UNION ALL SELECT DISTINCT work, 'no_container', 'META-INF/container.xml' FROM members WHERE work NOT IN (SELECT work FROM members WHERE path = 'META-INF/container.xml')
UNION ALL SELECT work, 'reference_dangling', target FROM member_refs r WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.work = r.work AND m.path = r.target)""")
def package_rules(spark, d):
    return p.member_findings(MEMBERS.frame(spark), MEMBER_REFS.frame(spark))


AUDIT = PACKAGES + r""", first AS (SELECT work, arg_min(path, ord) AS path, arg_min(stored, ord) AS stored, arg_min(body, ord) AS body FROM package_members GROUP BY work),
held AS (SELECT DISTINCT work, path FROM package_members WHERE work IN (SELECT work FROM package_members WHERE path = 'META-INF/container.xml')),
docs AS (SELECT m.work, path, body AS html, path LIKE '%nav.xhtml' AS nav FROM package_members m WHERE path LIKE '%.xhtml' AND work IN (SELECT work FROM held)),
named AS (SELECT work, regexp_extract(body, 'full-path="([^"]+)"', 1) AS opf FROM package_members WHERE path = 'META-INF/container.xml'),
files AS (SELECT n.work, opf, body AS xml FROM named n JOIN package_members m ON m.work = n.work AND m.path = n.opf),
items AS (SELECT work, opf, regexp_extract(tag, ' id="([^"]*)"', 1) AS id, regexp_extract(tag, ' href="([^"]*)"', 1) AS href FROM (SELECT work, opf, unnest(regexp_extract_all(xml, '<item [^>]*>')) AS tag FROM files)),
spine AS (SELECT s.work, s.id, 'OEBPS/' || href AS path FROM (SELECT work, unnest(regexp_extract_all(xml, '<itemref idref="([^"]*)"', 1)) AS id FROM files) s LEFT JOIN items i ON i.work = s.work AND i.id = s.id),
entries AS (SELECT DISTINCT work, 'OEBPS/' || unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS path FROM docs WHERE nav),
links AS (SELECT work, path, unnest(regexp_extract_all(html, 'href="#([^"]+)"', 1)) AS id FROM docs), ids AS (SELECT DISTINCT work, path, unnest(regexp_extract_all(html, '\bid="([^"]+)"', 1)) AS id FROM docs),
tags AS (SELECT work, path, unnest(range(0, len(l))) AS pos, unnest(l) AS tag FROM (SELECT work, path, regexp_extract_all(html, '(?i)<img\b[^>]*>') AS l FROM docs)),
images AS (SELECT *, trim(regexp_extract(tag, '\balt="([^"]*)"', 1)) AS alt, regexp_extract(tag, '\bsrc="([^"]*)"', 1) AS src FROM tags),
plain AS (SELECT *, regexp_replace(regexp_replace(html, '(?is)<pre\b[^>]*>.*?</pre\s*>', '', 'g'), '(?is)<code\b[^>]*>.*?</code\s*>', '', 'g') AS prose FROM docs WHERE NOT nav),
texts AS (SELECT *, regexp_replace(prose, '<[^>]+>', '', 'g') AS bare, regexp_extract_all(html, '(?i)<h([1-6])\b', 1) AS levels, list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS ps FROM plain),
jumps AS (SELECT work, path, min_by(levels[i] || '>' || levels[i + 1], i) AS detail FROM (SELECT work, path, levels, unnest(range(1, len(levels))) AS i FROM texts) WHERE CAST(levels[i + 1] AS INT) > CAST(levels[i] AS INT) + 1 GROUP BY ALL),
marked AS (SELECT work, path, unnest(list_concat(ps, list_transform(regexp_extract_all(regexp_replace(prose, '(?is)<aside\b[^>]*>.*?</aside>', '', 'g'), '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))))) AS text FROM texts),
strong AS (SELECT work, count(*) AS n FROM (SELECT DISTINCT * FROM marked) WHERE regexp_matches(text, '^((?:[-*+]|\d{1,3}[.)])\s+)?\[\d{1,4}\]\s+\S') GROUP BY work),
counted AS (SELECT work, path, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS text FROM texts), numbered AS (SELECT *, CAST(regexp_extract(text, '^\s*(\d{1,4})[.、]\s+\S', 1) AS INT) AS n FROM counted WHERE regexp_matches(text, '^\s*\d{1,4}[.、]\s+\S')),
weak AS (SELECT work, sum(c) AS n FROM (SELECT work, path, pos - n AS run, min(n) AS f, count(*) AS c FROM numbered GROUP BY ALL) WHERE f = 1 AND c >= 2 AND work NOT IN (SELECT work FROM strong) GROUP BY work),
css AS (SELECT work, path, regexp_replace(body, '(?s)/\*.*?\*/', '', 'g') AS css FROM package_members WHERE path = 'OEBPS/style.css' AND work IN (SELECT work FROM held)),
asides AS (SELECT work, path, regexp_extract(a, 'id="([^"]+)"', 1) AS note, regexp_extract(a, 'epub:type="backlink"[^>]*href="#([^"]+)"', 1) AS back FROM (SELECT work, path, unnest(regexp_extract_all(html, '(?s)<aside[^>]*epub:type="footnote".*?</aside>')) AS a FROM docs))
SELECT work, 'E_MIMETYPE_FIRST' AS code, path, '' AS detail FROM first WHERE path <> 'mimetype' UNION ALL SELECT work, 'E_MIMETYPE_STORED', path, '' FROM first WHERE path = 'mimetype' AND NOT stored UNION ALL SELECT work, 'E_MIMETYPE_CONTENT', path, '' FROM first WHERE path = 'mimetype' AND body <> 'application/epub+zip'
UNION ALL SELECT work, 'E_ZIP_DUPLICATE', path, count(*)::VARCHAR FROM package_members GROUP BY work, path HAVING count(*) > 1 UNION ALL SELECT work, 'E_NO_CONTAINER', 'META-INF/container.xml', '' FROM first WHERE work NOT IN (SELECT work FROM held)
UNION ALL SELECT work, 'E_CONTAINER_OPF', 'META-INF/container.xml', '' FROM named WHERE opf = '' UNION ALL SELECT work, 'E_OPF_MISSING', opf, '' FROM named n WHERE opf <> '' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.work = n.work AND h.path = n.opf)
UNION ALL SELECT work, 'E_SPINE_REF', NULL, id FROM spine WHERE path IS NULL UNION ALL SELECT work, 'E_MANIFEST_HREF', opf, href FROM items i WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.work = i.work AND h.path = 'OEBPS/' || i.href)
UNION ALL SELECT work, 'E_NAV_HREF', 'OEBPS/nav.xhtml', substr(path, 7) FROM entries e WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.work = e.work AND h.path = e.path) UNION ALL SELECT work, 'E_NCX_HREF', path, 'lost.xhtml' FROM package_members WHERE path = 'OEBPS/toc.ncx' AND contains(body, 'lost.xhtml') AND work IN (SELECT work FROM held)
UNION ALL SELECT DISTINCT work, 'E_TOC_COVERAGE', path, 'not listed' FROM spine s WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.work = s.work AND e.path = s.path) UNION ALL SELECT work, 'E_TOC_COVERAGE', path, 'not in the spine' FROM entries e WHERE NOT EXISTS (SELECT 1 FROM spine s WHERE s.work = e.work AND s.path = e.path)
UNION ALL SELECT work, 'E_COVER_META', opf, CASE WHEN contains(xml, 'properties="cover-image"') THEN 'meta missing' ELSE 'property missing' END FROM files WHERE contains(xml, 'properties="cover-image"') <> contains(xml, '<meta name="cover"') UNION ALL SELECT work, 'E_COVER_META', opf, 'unknown who' FROM files WHERE contains(xml, 'properties="cover-image"') AND contains(xml, 'content="who"')
UNION ALL SELECT work, 'W_META_INCOMPLETE', opf, 'dc:date,dc:publisher,dc:rights' FROM files WHERE NOT contains(xml, '<dc:rights>')
UNION ALL SELECT work, 'E_THEME_FONT', path, 'family' FROM css WHERE regexp_matches(css, 'font-family\s*:[^;}]*["'']') UNION ALL SELECT work, 'E_THEME_FONT', path, 'size' FROM css WHERE contains(css, 'font-size:') UNION ALL SELECT work, 'E_THEME_COLOR', path, 'color' FROM css WHERE regexp_matches(css, '(^|[^-\w])color\s*:') UNION ALL SELECT work, 'E_THEME_EXTERNAL', path, 'external' FROM css WHERE contains(css, '@import')
UNION ALL SELECT work, 'E_IMG_REMOTE', path, src FROM images WHERE starts_with(src, 'http') UNION ALL SELECT work, 'E_IMG_SRC', path, src FROM images WHERE src = 'gone.png' UNION ALL SELECT work, 'W_IMG_NO_ALT', path, pos::VARCHAR FROM images WHERE alt = '' UNION ALL SELECT work, 'W_IMG_FORMAT', path, src FROM images WHERE src LIKE '%.webp'
UNION ALL SELECT work, 'W_IMAGE_DUPLICATE', min('OEBPS/' || src), count(*)::VARCHAR FROM images WHERE src LIKE 'img/%' GROUP BY work HAVING count(*) > 1 UNION ALL SELECT work, 'E_CAPTION_PLACEHOLDER', path, alt FROM images WHERE alt = 'image' UNION ALL SELECT work, 'E_CAPTION_FILENAME', path, alt FROM images WHERE alt LIKE '%.jpg'
UNION ALL SELECT work, 'W_NO_LANG', path, '' FROM texts WHERE NOT contains(html, 'lang=') UNION ALL SELECT work, 'W_H1_COUNT', path, len(regexp_extract_all(html, '(?i)<h1\b'))::VARCHAR FROM texts WHERE len(regexp_extract_all(html, '(?i)<h1\b')) <> 1 UNION ALL SELECT work, 'E_UNSAFE_URL', path, '' FROM texts WHERE regexp_matches(html, '(?i)href="\s*(javascript|data):')
UNION ALL SELECT work, 'E_HEADING_SKIP', path, detail FROM jumps UNION ALL SELECT work, 'E_RESIDUE', path, 'comment' FROM texts WHERE contains(html, '<!--')
UNION ALL SELECT work, 'W_RESIDUE', path, detail FROM (SELECT work, path, CASE WHEN contains(prose, '![') THEN '![' WHEN regexp_matches(prose, '(^|[^*])\*\*([^*]|$)') THEN '**' WHEN contains(prose, ':::') THEN ':::' WHEN contains(prose, '{.') THEN '{.' WHEN contains(prose, '[^') THEN '[^' WHEN regexp_matches(prose, '\\[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]') THEN '\'
  WHEN regexp_matches(prose, '&lt;/?[a-zA-Z][\w:.-]*(\s[^<>]*)?&gt;') THEN '&lt;/' WHEN regexp_matches(prose, '\{\s*=\s*html\s*\}') THEN '{=html}' WHEN regexp_matches(prose, '<p[^>]*>\s*#{1,6}\s+\S') THEN 'heading' WHEN contains(prose, '[]') THEN 'span' END AS detail FROM texts) WHERE detail IS NOT NULL
UNION ALL SELECT work, 'W_RESIDUE', path, CASE WHEN regexp_matches(bare, '(^|[^$])\$\$([^$]|$)') THEN '$$' ELSE '$' END FROM texts WHERE regexp_matches(bare, '(^|[^$])\$\$([^$]|$)') OR regexp_matches(bare, '(?m)^[ \t]*\$[ \t]*$')
UNION ALL SELECT work, 'W_CELL_ATX', path, '## Cell' FROM texts WHERE contains(html, '<td>## Cell</td>') UNION ALL SELECT work, 'W_CJK_SPACED', path, '' FROM texts WHERE contains(html, '<p>中 文 字 字 中</p>')
UNION ALL SELECT work, 'W_PARA_UNCLOSED', path, right(list_filter(ps, lambda x: length(x) >= 20 AND regexp_matches(right(x, 1), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}，、,]'))[1], 1) FROM texts WHERE len(list_filter(ps, lambda x: length(x) >= 20 AND regexp_matches(right(x, 1), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}，、,]'))) > 0
UNION ALL SELECT work, 'W_NOTE_IN_PHRASE', path, '' FROM texts WHERE contains(html, '和 12 字') UNION ALL SELECT work, 'W_PUNCT_MIXED', path, regexp_replace(regexp_extract(bare, '。\s*\.|\.\s*。'), '\s+', '', 'g') FROM texts WHERE regexp_matches(bare, '。\s*\.|\.\s*。')
UNION ALL SELECT work, 'E_ANCHOR', path, id FROM links l WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.work = l.work AND i.path = l.path AND i.id = l.id) UNION ALL SELECT work, 'E_FN_BACKLINK', path, note FROM asides a WHERE back = '' OR NOT EXISTS (SELECT 1 FROM ids i WHERE i.work = a.work AND i.path = a.path AND i.id = a.back)
UNION ALL SELECT work, 'E_FOOTNOTES_NOT_SEMANTIC', NULL, n::VARCHAR FROM strong UNION ALL SELECT work, 'W_FOOTNOTES_AMBIGUOUS', NULL, n::VARCHAR FROM weak"""


@query(f"WITH {AUDIT}")
def package_audit(spark, d):
    """All rules over packages made of pages, but for the markup's own form, which SQL can't tell."""
    return a.audit(package_members(spark, d)).where("code <> 'E_XHTML_XML'")


def sample_package() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr(zipfile.ZipInfo("META-INF/container.xml"), "<container/>", compress_type=zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("OEBPS/c1.xhtml"), "<html/>", compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 'mimetype', true, 20::BIGINT), ('a', 2, 'META-INF/container.xml', false, 12), ('a', 3, 'OEBPS/c1.xhtml', false, 7)) v(work, ord, path, stored, size)")
def archive_members(spark, d):
    """Members of ZIP containers, a row each, by a table function."""
    packed = spark.createDataFrame([("a", bytearray(sample_package())), ("broken", bytearray(b"no zip")), ("none", None)], "work string, content binary")
    return members(packed).select("work", "ord", "path", "stored", F.octet_length("body").cast("long").alias("size"))


EXPECTED_TOC = Literal("expected_toc", "label string, place long", ("One", 1), ("Two", 2), ("Three", 3), ("Four", 4)).also(
    "SELECT concat(p_name, p_partkey), p_partkey FROM {part} WHERE p_partkey % 5 <> 0"
)
ACTUAL_TOC = Literal("actual_toc", "label string, place long", ("One", 1), ("Three", 2), ("Five", 3), ("Four", 4)).also(
    "SELECT concat(p_name, p_partkey), p_partkey + p_partkey % 11 % 2 FROM {part} WHERE p_partkey % 7 <> 0"
)


@query(with_tables(EXPECTED_TOC, ACTUAL_TOC) + """ SELECT label, e.place AS expected_place, a.place AS actual_place, CASE WHEN a.place IS NULL THEN 'missing' WHEN e.place IS NULL THEN 'extra' WHEN e.place <> a.place THEN 'moved' ELSE 'matched' END AS code FROM expected_toc e FULL JOIN actual_toc a USING (label)""")
def generated_toc_check(spark, d):
    return p.reconciled(EXPECTED_TOC.frame(spark, d), ACTUAL_TOC.frame(spark, d), ["label"])


PRINTED = Literal(
    "printed", "work string, line long, text string",
    ("w", 1, "# Contents"), ("w", 2, "1. First chapter ........ 12"), ("w", 3, "Second chapter"), ("w", 4, "  34 "), ("w", 5, "“Third” chapter\t56"), ("w", 6, "Fourth"), ("w", 7, ""), ("w", 8, "Preface ..... xii"), ("w", 9, "Doubled   7"), ("w", 10, "Lost one .... 9"),
).also(
    "SELECT concat('c', o_custkey % 20), o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderpriority, ' ', o_custkey, ' ....... ', o_orderkey % 400) WHEN 1 THEN concat('', o_orderkey % 300) WHEN 2 THEN concat('Chapter ', o_custkey, '   ', o_orderkey % 90) ELSE concat(o_orderstatus, 'art ', o_custkey) END FROM {orders} WHERE o_orderkey < 6000"
)
NAV = Literal("nav", "work string, place long, label string", *[(w, i, x) for w, names in (("w", ("First Chapter", "second  chapter", "Third chapter", "Doubled", "DOUBLED", "Only in nav", "Preface")), ("v", ("Second chapter", "First chapter"))) for i, x in enumerate(names, 1)]).also(
    "SELECT concat('c', o_custkey % 20), o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('CHAPTER ', o_custkey) ELSE concat(o_orderstatus, 'art ', o_custkey) END FROM {orders} WHERE o_orderkey % 5 < 3 AND o_orderkey < 6000"
)
#: Lines as printed: a page after leaders, a tab or two blanks, else alone on the next line; and the key of a label.
ENTRIES = r"""raw AS (SELECT work, line, trim(text) AS text FROM printed WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')),
told AS (SELECT *, regexp_full_match(lower(text), '[0-9]{1,4}|[ivxlcdm]{1,8}') AS alone, regexp_extract(text, '^(.*?\S)(?:[ \t]*[.．·…]{2,}[ \t]*|[ \t]{2,}|\t)([0-9]{1,4}|[ivxlcdm]{1,8})$', ['label', 'page']) AS m FROM raw),
chained AS (SELECT *, lead(alone) OVER w AS next_alone, lead(text) OVER w AS next_text FROM told WINDOW w AS (PARTITION BY work ORDER BY line)),
entries AS (SELECT work, line, CASE WHEN m.label <> '' THEN m.label ELSE text END AS label, coalesce(nullif(m.page, ''), CASE WHEN next_alone THEN next_text END) AS page FROM chained WHERE NOT alone),
keyed AS (SELECT work, line AS place, label, 'printed' AS side FROM entries UNION ALL SELECT work, place, label, 'nav' FROM nav),
keys AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(translate(label, '「」『』“”‘’"' || chr(39), ''), '^\s*\d{1,3}[.．、)]\s*', ''), '[ .…·•—–-]+$', '')), '\s+', '', 'g') AS key FROM keyed),
hits AS (SELECT work, key, count(*) AS n FROM keys WHERE side = 'nav' AND key <> '' GROUP BY ALL), singles AS (SELECT DISTINCT work, key FROM hits JOIN keys USING (work, key) WHERE n = 1 AND side = 'printed')"""


@query(with_tables(PRINTED) + ", nav AS (SELECT 'w' AS work, 1 AS place, '' AS label), " + ENTRIES + " SELECT work, line, label, page FROM entries")
def toc_printed(spark, d):
    return toc.printed_entries(PRINTED.frame(spark, d))


@query(with_tables(PRINTED, NAV) + ", " + ENTRIES + """ SELECT k.work, side, place, label, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'printed_only' END AS "match" FROM keys k LEFT JOIN hits h ON h.work = k.work AND h.key = k.key WHERE side = 'printed'
UNION ALL SELECT k.work, side, place, label, 'nav_only' FROM keys k LEFT JOIN singles s ON s.work = k.work AND s.key = k.key WHERE side = 'nav' AND s.key IS NULL""")
def toc_diff(spark, d):
    """Entries under an ambiguous label stay nav_only; two works with the same labels don't meet."""
    return toc.diff(toc.printed_entries(PRINTED.frame(spark, d)), NAV.frame(spark, d))


SRC_TITLES = Literal("src_titles", "work string, title string", ("a", "The First Chapter"), ("a", "Coda"), ("a", "Epilogue: after all"), ("a", "Lost"), ("b", "Coda")).also(
    "SELECT concat('s', source), substr(replace(text, chr(10), ' '), 1, 24) FROM {documents}"
)
LABELS = Literal("labels_of_units", "work string, label string", ("a", "the first chapter!"), ("a", "Epilogue"), ("a", "Cod"), ("b", "Intro")).also(
    "SELECT concat('s', source), substr(replace(text, chr(10), ' '), 1 + doc_id % 7, 14) FROM {documents} WHERE doc_id % 3 = 0"
)


@query(with_tables(SRC_TITLES, LABELS) + r""", a AS (SELECT work, title, lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM src_titles), b AS (SELECT DISTINCT work, lower(regexp_replace(label, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM labels_of_units)
SELECT work, title FROM a WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.work = a.work AND b.k <> '' AND (a.k = b.k OR (least(length(a.k), length(b.k)) >= 4 AND (contains(a.k, b.k) OR contains(b.k, a.k)))))""".replace("\\\\", "\\"))
def toc_missing(spark, d):
    """Three characters are too few to match inside a longer title."""
    return toc.missing_titles(SRC_TITLES.frame(spark, d), LABELS.frame(spark, d))


INDEX = Literal("index_lines", "work string, unit string, line long, text string", ("i", "i", 5, "# Index"), ("i", "i", 8, "")).also(
    "SELECT concat('w', p_partkey % 3), concat('p', p_size), p_partkey, concat(CASE WHEN p_partkey % 5 = 0 THEN '- ' ELSE '' END, p_name, CASE WHEN p_partkey % 11 = 4 THEN '' ELSE concat(', ', 1 + p_partkey % 130) END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 11 <> 4 THEN concat(', ', 140 + p_size, '-', 1 + p_size % 9) ELSE '' END) FROM {part}"
)
#: An entry is a label, then references at its end: numbers or ranges after a comma. Hand cases with other marks are in the tests.
ENTRY_SQL = r"""told AS (SELECT work, unit, line, regexp_replace(text, '^- ', '') AS text FROM index_lines WHERE text <> '' AND NOT starts_with(text, '#')),
entries AS (SELECT work, unit, line, regexp_replace(text, '(?:, [0-9]+(?:-[0-9]+)?)+$', '') AS label, array_to_string(regexp_extract_all(regexp_extract(text, '((?:, [0-9]+(?:-[0-9]+)?)+)$', 1), '[0-9]+(?:-[0-9]+)?'), ';') AS refs FROM told)"""


#: All lines: the hand cases, those above, and every part's with references and both ends of a range in full.
INDEX_WHOLE = Literal(
    "index_lines", "work string, unit string, line long, text string",
    ("i", "i", 1, "guilds, 12, 98-9, 104"), ("i", "i", 2, "- moot 7"), ("i", "i", 3, "see also halls"), ("i", "i", 4, "Treaty of 1648, 3"), ("i", "i", 5, "# Index"), ("i", "i", 6, "war, 1914, 1918"), ("i", "i", 7, "late, 400"), ("i", "i", 8, ""), ("i", "i", 9, "towns 5 6"),
).also(
    INDEX.derived + " UNION ALL SELECT 'v', concat('p', p_size), p_partkey, concat(CASE WHEN p_partkey % 5 = 0 THEN '- ' ELSE '' END, p_name, ', ', 1 + p_partkey % 130, CASE WHEN p_partkey % 3 = 0 THEN concat(', ', 140 + p_size, '-', 141 + p_size) ELSE '' END) FROM {part}"
)
#: References at a line's end, parted by commas or blanks; a number of four digits is a year.
WHOLE_SQL = r"""told AS (SELECT work, unit, line, regexp_replace(text, '^[-*+]\s*', '') AS text FROM index_lines WHERE text <> '' AND NOT starts_with(text, '#')),
entries AS (SELECT work, unit, line, regexp_replace(text, '(?:[\s,]+[0-9]{1,3}(?:-[0-9]{1,4})?)+$', '') AS label, array_to_string(regexp_extract_all(regexp_extract(text, '((?:[\s,]+[0-9]{1,3}(?:-[0-9]{1,4})?)+)$', 1), '[0-9]+(?:-[0-9]+)?'), ';') AS refs FROM told)"""


@query(with_tables(INDEX_WHOLE) + ", " + WHOLE_SQL + " SELECT *, refs = '' AS unresolved FROM entries")
def index_entries(spark, d):
    return toc.index_entries(INDEX_WHOLE.frame(spark, d))


#: The pages of three works, of other lengths.
PAGES_OF = Literal("pages_of", "work string, page long", ("i", 1)).also("SELECT concat('w', p_partkey % 3), p_partkey FROM {part} WHERE p_partkey <= 100 + 30 * (p_partkey % 3)")


@query(with_tables(INDEX, PAGES_OF) + ", " + ENTRY_SQL + r""", r AS (SELECT work, unit, line, label, unnest(string_split(refs, ';')) AS ref FROM entries WHERE refs <> ''), b AS (SELECT *, split_part(ref, '-', 1) AS a, split_part(ref, '-', 2) AS z FROM r),
w AS (SELECT *, CAST(a AS BIGINT) AS lo, CAST(CASE WHEN z = '' THEN a WHEN length(z) < length(a) THEN left(a, length(a) - length(z)) || z ELSE z END AS BIGINT) AS hi FROM b), p AS (SELECT work, unit, line, label, unnest(range(lo, greatest(lo, hi) + 1)) AS page FROM w)
SELECT work, unit, line, label, page FROM p WHERE (work, page) NOT IN (SELECT (work, page) FROM pages_of)""")
def index_orphans(spark, d):
    return toc.index_orphans(toc.index_entries(INDEX.frame(spark, d)), PAGES_OF.frame(spark, d))


IMAGES = [(1, b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")), (2, b"GIF89a" + (32).to_bytes(2, "little") + (16).to_bytes(2, "little")), (3, b"BM" + bytes(16) + (10).to_bytes(4, "little", signed=True) + (-20).to_bytes(4, "little", signed=True)), (4, b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x50\x00\x64" + bytes(9)), (5, b"text"), (6, None)]


@query("SELECT * FROM (VALUES (1::BIGINT, 640::BIGINT, 480::BIGINT), (2, 32, 16), (3, 10, 20), (4, 100, 80), (5, NULL, NULL), (6, NULL, NULL)) v(id, width, height)")
def image_sizes(spark, d):
    x = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in IMAGES], "id long, data binary").withColumn("s", image_size(F.col("data")))
    return x.select("id", "s.width", "s.height")


@query("SELECT * FROM (VALUES (1::BIGINT, 'ABC 12'), (2, 'fi1/2'), (3, 'カ'), (4, NULL), (5, 'e')) v(id, normal)")
def normal_forms(spark, d):
    x = spark.createDataFrame([(1, "ＡＢＣ　１２"), (2, "ﬁ½"), (3, "ｶ"), (4, None), (5, "ｅ")], "id long, s string")
    return x.select("id", F.replace(nfkc(F.col("s")), F.lit("⁄"), F.lit("/")).alias("normal"))
