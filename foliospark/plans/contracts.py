"""Queries over contracts and pages. Cases are worked by hand where the SQL only lists the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import contracts as c, pages as p
from foliospark.plans.evidence import listed
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.session import read
from foliospark.sources.adapters import LINES, lines


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


REPAIRS = Literal("repairs", "id long, unit string, kind string, before string, after string, evidence string", (1, "u1", "ocr", "a", "b", "e"), (2, "", "ocr", "a", "a", " ")).also(
    "SELECT 10 + p_partkey, CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE concat('u', p_size) END, CASE p_partkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'wrap' WHEN 2 THEN p_brand ELSE 'order' END, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type END, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'e' END FROM {part}"
)
REPAIR_UNITS = Literal("repair_units", "unit string", ("u1",)).also("SELECT DISTINCT concat('u', p_size) FROM {part} WHERE p_size <= 40 AND p_size > 1")


@query(with_tables(REPAIRS, REPAIR_UNITS) + """, j AS (SELECT r.*, u.unit IS NOT NULL AS known, CAST(id AS VARCHAR) AS entity, trim(coalesce(r.unit, '')) = '' AS bare FROM repairs r LEFT JOIN repair_units u ON u.unit = r.unit)
SELECT entity, 'unit_missing' AS code FROM j WHERE bare UNION ALL SELECT entity, 'unit_unknown' FROM j WHERE NOT bare AND NOT known UNION ALL SELECT entity, 'kind' FROM j WHERE kind IS NULL OR kind NOT IN ('hyphen', 'wrap', 'ocr', 'order', 'duplicate', 'other') UNION ALL SELECT entity, 'evidence_missing' FROM j WHERE trim(coalesce(evidence, '')) = '' UNION ALL SELECT entity, 'unchanged' FROM j WHERE before = after""")
def repair_violations(spark, d):
    return c.repair_violations(REPAIRS.frame(spark, d), REPAIR_UNITS.frame(spark, d))


STYLED = Literal("style_rows", "id long, unit string, pattern string, style string", (1, "u1", "x+", "s1"), (2, "gone", None, "s9")).also("SELECT 10 + p_partkey, concat('u', p_size), CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END, concat('s', p_partkey % 9) FROM {part}")
STYLE_UNITS = Literal("style_units", "unit string").also("SELECT DISTINCT concat('u', p_size) FROM {part} WHERE p_size <= 40")


@query(with_tables(STYLED, STYLE_UNITS) + """, j AS (SELECT s.*, u.unit IS NOT NULL AS known FROM style_rows s LEFT JOIN style_units u USING (unit))
SELECT CAST(id AS VARCHAR) AS entity, 'unit_unknown' AS code FROM j WHERE NOT known UNION ALL SELECT CAST(id AS VARCHAR), 'style_unknown' FROM j WHERE style NOT IN ('s0', 's1', 's2', 's3', 's4', 's5', 's6') UNION ALL SELECT CAST(id AS VARCHAR), 'pattern_missing' FROM j WHERE trim(coalesce(pattern, '')) = ''""")
def style_violations(spark, d):
    return c.style_violations(STYLED.frame(spark, d), STYLE_UNITS.frame(spark, d), table(spark, "style string", *[(f"s{i}",) for i in range(7)]))


POLICIES = Literal("policies", "unit string, policy string, evidence string", ("a", "source", None), ("b", "odd", "e"), ("c", "product", ""), ("d", "none", ""), ("d", "none", "")).also(
    "SELECT concat('u', CASE WHEN p_partkey % 11 = 1 THEN p_partkey - 1 ELSE p_partkey END), CASE p_size % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'product' WHEN 2 THEN 'none' ELSE p_brand END, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_type END FROM {part}"
)


@query(with_tables(POLICIES) + """ SELECT DISTINCT unit AS entity, 'policy' AS code FROM policies WHERE policy NOT IN ('source', 'product', 'none') UNION ALL SELECT DISTINCT unit, 'evidence_missing' FROM policies WHERE policy = 'product' AND trim(coalesce(evidence, '')) = '' UNION ALL SELECT unit, 'repeated' FROM policies GROUP BY unit HAVING count(*) > 1""")
def policy_violations(spark, d):
    return c.policy_violations(POLICIES.frame(spark, d))


INSERT_FILES = Literal("insert_files", "path string, value string", ("b", "broken"), ("d", None)).also(
    """SELECT concat('f', p_partkey), CASE WHEN p_partkey % 5 = 0 THEN concat('broken ', p_name) ELSE concat(chr(123), '"id":"i-', p_partkey, '","type":"', CASE WHEN p_size % 2 = 0 THEN 'fig' ELSE 'table' END, '"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(',"source":', chr(123), '"page":', p_size, chr(125)) END, chr(125)) END FROM {part}"""
)


@query("SELECT 'i-' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'fig' ELSE 'table' END AS type, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS page FROM part WHERE p_partkey % 5 <> 0")
def insert_rows(spark, d):
    return c.insert_rows(INSERT_FILES.frame(spark, d))


WORKS = Literal("works", "work string, schema_version long", ("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 2)).also("SELECT concat('c', c_custkey), 1 + c_custkey % 10 % 9 % 2 FROM {customer}")
STATES = Literal("unit_states", "work string, unit string, status string", ("a", "1", "reviewed"), ("a", "2", "built"), ("c", "1", "built"), ("d", "1", "aligned"), ("e", "1", "pending"))
STATES.also("SELECT concat('c', o_custkey), concat('u', o_orderkey), CASE WHEN o_custkey % 4 = 0 THEN 'built' WHEN o_custkey % 4 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'audited' END WHEN o_orderkey % 3 = 0 THEN 'translated' ELSE 'aligned' END FROM {orders} WHERE o_custkey % 5 <> 0")


@query(with_tables(WORKS, STATES) + """, s AS (SELECT work, count(*) AS n, count_if(status IN ('reviewed', 'audited', 'built')) AS done, count_if(status = 'built') AS built FROM unit_states GROUP BY work)
SELECT w.work, coalesce(n, 0) AS n_units, coalesce(done, 0) AS done, CASE WHEN schema_version <> 1 THEN 'unsupported' WHEN n IS NULL THEN 'empty' WHEN built = n THEN 'built' WHEN done = n THEN 'reviewed' ELSE 'open' END AS state FROM works w LEFT JOIN s ON s.work = w.work""")
def work_states(spark, d):
    return c.work_states(WORKS.frame(spark, d), STATES.frame(spark, d))


UNIT_DIGESTS = Literal("unit_digests", "work string, unit string, digest string", ("a", "1", "x"), ("a", "2", "y"), ("a", "3", "z")).also(
    "SELECT concat('s', source), concat('u', doc_id), concat('d', doc_id % 9) FROM {documents} WHERE doc_id % 7 <> 0"
)
PRODUCTS = Literal("products", "work string, unit string, digest string", ("a", "1", "x"), ("a", "2", "old"), ("a", "9", "q")).also(
    "SELECT concat('s', source), concat('u', doc_id), concat('d', doc_id % 9 % 8) FROM {documents} WHERE doc_id % 5 <> 0"
)


@query(with_tables(UNIT_DIGESTS, PRODUCTS) + " SELECT * FROM (SELECT coalesce(u.work, p.work) AS work, coalesce(u.unit, p.unit) AS unit, CASE WHEN u.unit IS NULL THEN 'orphan' WHEN p.unit IS NULL THEN 'missing' WHEN u.digest <> p.digest THEN 'stale' END AS code FROM unit_digests u FULL JOIN products p ON u.work = p.work AND u.unit = p.unit) WHERE code IS NOT NULL")
def stale_units(spark, d):
    return c.stale_units(UNIT_DIGESTS.frame(spark, d), PRODUCTS.frame(spark, d))


REG_NOTES = Literal("reg_notes", "work string, note_id string, scope_id string, source_label string", ("a", "n1", "s1", "1"), ("a", "n2", "s1", "12"), ("a", "n3", "s2", "*"), ("b", "n1", "s1", "7")).also(
    "SELECT concat('s', source), concat('n', doc_id), concat('p', doc_id % 4), concat('', doc_id % 30) FROM {documents}"
)
REG_REFS = Literal("reg_refs", "work string, note_id string, unit string", ("a", "n1", "u1"), ("a", "n2", "u1"), ("a", "n1", "u2"), ("c", "n1", "u1")).also(
    "SELECT concat('s', source), concat('n', doc_id), concat('u', doc_id % 6) FROM {documents} WHERE doc_id % 3 = 0"
)


@query(with_tables(REG_NOTES, REG_REFS) + ", a AS (SELECT work, count(*) AS n_notes, count(DISTINCT scope_id) AS n_scopes FROM reg_notes GROUP BY 1), b AS (SELECT work, count(*) AS n_refs, count(DISTINCT unit) AS n_units FROM reg_refs GROUP BY 1) SELECT work, coalesce(n_notes, 0) AS n_notes, coalesce(n_scopes, 0) AS n_scopes, coalesce(n_refs, 0) AS n_refs, coalesce(n_units, 0) AS n_units FROM a FULL JOIN b USING (work)")
def note_registration(spark, d):
    return c.note_registration(REG_NOTES.frame(spark, d), REG_REFS.frame(spark, d))


@query(with_tables(REG_REFS) + " SELECT unit, string_agg(DISTINCT note_id, ',' ORDER BY note_id) AS notes FROM reg_refs GROUP BY unit")
def required_notes(spark, d):
    return c.required_notes(REG_REFS.frame(spark, d))


@query(with_tables(REG_NOTES, REG_REFS) + ", j AS (SELECT DISTINCT r.unit, CAST(source_label AS BIGINT) AS n FROM reg_refs r JOIN reg_notes n ON n.note_id = r.note_id AND n.work = r.work WHERE regexp_full_match(source_label, '[0-9]+')) SELECT unit, string_agg(n, ',' ORDER BY n) AS numbers FROM j GROUP BY unit")
def registered_numbers(spark, d):
    keyed = lambda x: x.withColumn("note_id", F.concat_ws("/", "work", "note_id")).drop("work")
    return p.registered_numbers(keyed(REG_REFS.frame(spark, d)), keyed(REG_NOTES.frame(spark, d)))


ENTRIES = Literal("entries", "note_id string, disposition string, reason string, signals string", ("n1", "kept", "name", "identical"), ("n2", "odd", "", ""), ("n3", "translated", "done", "missing_target")).also(
    "SELECT concat('m', doc_id), CASE doc_id % 5 WHEN 0 THEN 'translated' WHEN 1 THEN 'kept' WHEN 2 THEN 'retranslate' WHEN 3 THEN NULL ELSE source END, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'r' END, CASE WHEN doc_id % 3 = 0 THEN 'identical' ELSE '' END FROM {documents}"
)


@query(with_tables(ENTRIES) + """ SELECT note_id AS entity, 'disposition' AS code FROM entries WHERE coalesce(disposition, '') NOT IN ('translated', 'kept', 'retranslate') UNION ALL SELECT note_id, 'reason_missing' FROM entries WHERE trim(reason) = '' UNION ALL SELECT note_id, 'contradiction' FROM entries WHERE disposition = 'translated' AND trim(signals) <> ''""")
def disposition_violations(spark, d):
    return c.disposition_violations(ENTRIES.frame(spark, d))


RESULTS = Literal("check_results", "item string, result string", ("a", "pass"), ("a", "fail"), ("a", "manual"), ("b", "pass"), ("b", "manual"), ("c", "pass"), ("d", "none"))
RESULTS.also("SELECT concat('k', CAST(floor(doc_id / 6) AS BIGINT)), CASE WHEN doc_id % 31 = 0 THEN 'fail' WHEN doc_id % 17 = 0 THEN 'manual' WHEN doc_id % 5 < 2 THEN 'pass' ELSE 'none' END FROM {documents}")


@query(with_tables(RESULTS) + """ SELECT item AS "check", CASE min(CASE result WHEN 'fail' THEN 1 WHEN 'manual' THEN 2 WHEN 'pass' THEN 3 ELSE 4 END) WHEN 1 THEN 'fail' WHEN 2 THEN 'manual' WHEN 3 THEN 'pass' ELSE 'unknown' END AS status FROM check_results GROUP BY item""")
def quality_ledger(spark, d):
    return c.quality_ledger(RESULTS.frame(spark, d).withColumnRenamed("item", "check"))


@query("SELECT source AS folder, sha256(string_agg('f' || doc_id || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY 'f' || doc_id)) AS digest FROM documents GROUP BY source")
def folder_digests(spark, d):
    """Documents as the files of their source's folder."""
    files = read(spark, d, "documents").select(F.col("source").alias("folder"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return c.folder_digests(files)


PLACES = Literal("note_places", "work string, note_id string, page long, x0 double, y0 double", ("w", "n1", 1, 10.0, 20.0), ("w", "n2", 2, 5.5, 5.0), ("w", "n3", 2, 50.0, 5.0), ("v", "n4", 1, 10.0, 20.0)).also("SELECT concat('k', o_custkey % 2), concat('o', o_orderkey), o_custkey % 90 + 100, CAST(o_orderkey % 23 AS DOUBLE), CAST(o_custkey % 7 AS DOUBLE) FROM {orders} WHERE o_orderkey % 9 = 0 AND o_orderkey < 9000")
STARTS = Literal("block_starts", "work string, page long, block long, x0 double, y0 double", ("w", 1, 1, 10.0, 60.0), ("w", 1, 2, 11.0, 19.0), ("w", 2, 1, 5.0, 5.0)).also("SELECT concat('k', o_orderkey % 2), o_custkey % 90 + 100, o_orderkey, CAST(o_orderkey % 29 AS DOUBLE), CAST(o_custkey % 11 AS DOUBLE) FROM {orders} WHERE o_orderkey % 4 = 0 AND o_orderkey < 9000")


@query(with_tables(PLACES, STARTS) + " SELECT n.work, note_id, n.page, block FROM note_places n JOIN block_starts b ON b.work = n.work AND b.page = n.page AND abs(n.x0 - b.x0) <= 2 AND abs(n.y0 - b.y0) <= 2")
def source_evidence(spark, d):
    return p.source_evidence(PLACES.frame(spark, d), STARTS.frame(spark, d))


INDEXED = Literal("index_labels", "work string, label string", ("w", "Guilds"), ("w", "moot halls"), ("v", "Guilds")).also("SELECT DISTINCT concat('z', p_size % 5), p_name FROM {part} WHERE p_size % 3 = 0")
PAGE_LINES = Literal("page_lines_of", "work string, page long, line long, text string", *[("w", *x) for x in ((9, 1, "Index"), (9, 2, "guilds, 12, 14"), (9, 3, "moot halls 7"), (9, 4, "see also"), (10, 1, "Guilds 3"), (10, 2, "towns 4"), (5, 1, "Guilds are many"), (5, 2, "and so on 5"))])
PAGE_LINES.also("SELECT concat('z', p_size % 5), CAST(floor(p_partkey / 40) AS BIGINT), p_partkey, concat(p_name, CASE WHEN p_partkey % 7 < 4 THEN concat(', ', p_partkey % 300) ELSE '' END) FROM {part}")


@query(with_tables(INDEXED, PAGE_LINES) + r""", d AS (SELECT *, avg(CASE WHEN regexp_matches(text, ',?\s*\d{1,4}\s*$') THEN 1.0 ELSE 0.0 END) OVER p AS dense, bool_or(line = 1 AND lower(trim(text)) IN ('index', '索引')) OVER p AS titled FROM page_lines_of WINDOW p AS (PARTITION BY work, page)),
k AS (SELECT *, lower(regexp_replace(regexp_replace(text, '[,\s\d–-]+$', ''), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM d WHERE dense > 0.5 OR titled) SELECT i.work, label, page, line FROM index_labels i JOIN k ON k.work = i.work AND k.key = lower(regexp_replace(label, '[^\p{L}\p{N}]+', '', 'g'))""")
def index_page_lines(spark, d):
    return p.index_page_lines(INDEXED.frame(spark, d), PAGE_LINES.frame(spark, d))


MODEL_UNITS = Literal("model_units", "work string, unit string, level long, title string", ("w", "u1", 1, "One!"), ("w", "u2", 1, "Two"), ("w", "u3", 2, "Three")).also("SELECT concat('z', p_size % 9), concat('p', p_partkey), 1 + p_partkey % 3, concat(p_name, ' ', p_partkey % 40) FROM {part}")
MODEL_LINES = Literal("model_lines", "work string, line long, label string", ("w", 1, "one"), ("w", 2, "two"), ("w", 3, "TWO"), ("v", 1, "three")).also("SELECT concat('z', p_size % 9), 100 + p_partkey, concat(upper(p_name), ' - ', p_partkey % 40, '.') FROM {part} WHERE p_partkey % 3 = 0")


@query(with_tables(MODEL_UNITS, MODEL_LINES) + r""", k AS (SELECT work, lower(regexp_replace(label, '[^\p{L}\p{N}]+', '', 'g')) AS k, count(*) AS n, min(line) AS line FROM model_lines GROUP BY ALL)
SELECT u.work, u.unit, u.level, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n = 1 THEN k.line END AS line FROM model_units u LEFT JOIN k ON k.work = u.work AND k.k = lower(regexp_replace(u.title, '[^\p{L}\p{N}]+', '', 'g'))""")
def contents_model(spark, d):
    return p.contents_model(MODEL_UNITS.frame(spark, d), MODEL_LINES.frame(spark, d))


SOURCES = Literal("source_files", "work string, path string, unit string, ord long", ("w", "OEBPS/one.xhtml", "u1", 1), ("w", "x/one.html", "u3", 3), ("w", "two", "u2", 2), ("v", "two.md", "u9", 1))
SOURCES.also("SELECT concat('b', p_size % 4), concat(p_brand, '/t/', replace(p_name, ' ', '-'), CASE WHEN p_size % 2 = 0 THEN '.xhtml' ELSE '.v2.md' END), concat('p', p_partkey), 100 + p_partkey FROM {part}")
STEMS = r"""stems AS (SELECT work, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS stem, arg_min(unit, ord) AS unit FROM source_files GROUP BY ALL)"""


@query(with_tables(SOURCES) + ", " + STEMS + " SELECT * FROM stems")
def stem_units(spark, d):
    return p.stem_units(SOURCES.frame(spark, d))


LINKED = Literal("linked", "work string, unit string, name string, anchor string").also("SELECT concat('b', p_partkey % 4), concat('p', p_partkey), replace(p_name, ' ', '-'), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('#s', p_size) END FROM {part}")


@query(with_tables(SOURCES, LINKED) + ", " + STEMS + """, links AS (SELECT work, unit, 0::BIGINT AS place, 'x/' || name || '.html' || anchor AS href, name AS stem, anchor, false AS own FROM linked UNION ALL SELECT work, unit, 1, '#c', '', '#c', true FROM linked UNION ALL SELECT work, unit, 3, name || '.v2.html', name || '.v2', '', false FROM linked)
SELECT l.work, l.unit, place, href, CASE WHEN own OR s.unit = l.unit THEN CASE WHEN anchor <> '' THEN anchor ELSE s.unit || '.xhtml' END WHEN s.unit IS NOT NULL THEN s.unit || '.xhtml' || anchor END AS target FROM links l LEFT JOIN stems s ON s.work = l.work AND s.stem = l.stem""")
def rewritten_links(spark, d):
    """Links into the same work alone are known; those elsewhere have no target."""
    text = F.concat(F.lit("[a](x/"), "name", F.lit(".html"), "anchor", F.lit(") [b](#c) [c](http://x/y) [d]("), "name", F.lit(".v2.html)"))
    return p.rewritten_links(LINKED.frame(spark, d).select("work", "unit", text.alias("text")), p.stem_units(SOURCES.frame(spark, d)))


@query(name="ordered_containment")
def ordered_containment(spark, d):
    """The lines of every document as the blocks of its tree, looked for in its text with every seventh line gone and marks put between words; against brute force in the tests."""
    each = lines(spark, d).select("unit", F.col("line").alias("ord"), F.when(F.col("line") % 5 == 1, "heading").otherwise("paragraph").alias("kind"), F.col("text").alias("body"))
    kept = each.where("ord % 7 <> 3").select("unit", "ord", F.concat(F.lit("**"), F.replace(F.col("body"), F.lit(" "), F.lit("** *")), F.lit("*")).alias("text"))
    return p.compared_blocks(each, kept).select("unit", "headings", "paragraphs", "missing_count", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


SIZED = Literal("sized", "work string, page long, line long, text string, size double", ("w", 1, 1, "A Great Heading", 20.0), ("w", 1, 2, "body text of the page that is long", 10.0), ("w", 1, 3, "more of it, longer than the heading", 10.0), ("w", 1, 4, "Chapter 7", 10.0), ("w", 2, 1, "ab", 8.0), ("w", 2, 2, "cd", 9.0), ("w", 2, 3, "none", 0.0)).also(
    "SELECT concat('c', o_custkey % 3), o_orderkey % 100, o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN concat('Chapter ', o_orderkey) ELSE substr(o_orderpriority, 1, 8) END, CAST(8 + o_custkey % 5 AS DOUBLE) FROM {orders} WHERE o_orderkey < 8000"
)


SIZES = """u AS (SELECT work, page, size, sum(length(text)) AS c FROM sized WHERE size > 0 GROUP BY ALL), usual AS (SELECT work, page, arg_max(size, (c, -size)) AS usual_size FROM u GROUP BY ALL),
middle AS (SELECT work, page, median(size) AS median_size FROM sized WHERE size > 0 GROUP BY ALL), sizes AS (SELECT * FROM middle JOIN usual USING (work, page))"""


@query(with_tables(SIZED) + ", " + SIZES + " SELECT work, page, median_size, usual_size FROM sizes")
def size_profile(spark, d):
    return p.size_profile(SIZED.frame(spark, d))


@query(with_tables(SIZED) + ", " + SIZES + r""" SELECT s.work, s.page, line FROM sized s JOIN sizes z ON z.work = s.work AND z.page = s.page WHERE length(text) <= 80 AND (size >= 1.3 * median_size OR regexp_matches(text, '(?i)^\s*(chapter|part|book)\s+(\d+|[ivxlc]+)\b'))""")
def chapter_headings(spark, d):
    return p.chapter_headings(SIZED.frame(spark, d))


@query(listed("expected", "id long, verse boolean, hollow boolean", (1, True, False), (2, False, False), (3, False, False), (4, False, True), (5, False, False)))
def block_predicates(spark, d):
    x = table(spark, "id long, md string, title string", (1, "> one line\n> another", "T"), (2, "> ended.\n> line", "unknown"), (3, "> alone", ""), (4, "# Unknown\n\n", "Unknown"), (5, "# H", "Real"))
    return x.select("id", p.is_verse(F.col("md")).alias("verse"), p.is_empty_unit(F.col("md"), F.col("title")).alias("hollow"))


@query(listed("expected", "unit string, line long, label string", ("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, "x"), ("a", 5, "x"), ("a", 6, None), ("a", 7, "y")))
def footnote_parts(spark, d):
    return p.footnote_parts(table(spark, "unit string, line long, text string", ("a", 1, "body"), ("a", 2, "[^x]: note"), ("a", 3, "    goes on"), ("a", 4, ""), ("a", 5, "    second paragraph"), ("a", 6, "body again"), ("a", 7, "[^y]: other")))


@query(listed("expected", "work string, place long, label string, href string, level long", ("w", 1, "One", "a.xhtml", 1), ("w", 2, "Sub one", "a.xhtml#s", 2), ("w", 3, "Two", "b.xhtml", 1)))
def nav_entries(spark, d):
    return p.nav_entries(table(spark, "work string, html string", ("w", '<nav><ol><li><a href="a.xhtml">One</a><ol><li><a href="a.xhtml#s">Sub <b>one</b></a></li></ol></li><li><a href="b.xhtml">Two</a></li></ol></nav>')))


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS m FROM pages) SELECT page_id::VARCHAR AS work, count(*) AS n FROM m GROUP BY page_id""")
def nav_entry_counts(spark, d):
    x = p.nav_entries(read(spark, d, "pages").select(F.col("page_id").cast("string").alias("work"), F.coalesce("html", F.lit("")).alias("html")))
    return x.groupBy("work").agg(F.count("*").alias("n"))


@query(listed("expected", "unit string, ord long", ("a", 1), ("a", 2), ("a", 5), ("b", 2)))
def note_paragraphs(spark, d):
    return p.note_paragraphs(table(spark, "unit string, ord long, text string", ("a", 1, "1 first note"), ("a", 2, "2. second note"), ("a", 3, "prose"), ("a", 4, "9 alone"), ("a", 5, "¹ raised"), ("b", 1, "2 no start"), ("b", 2, "* starred")))


@query(listed("expected", "work string, title string, language string, creator string, n_media long, protected boolean", ("w", "A Book", "en", "Ann", 2, True)))
def package_facts(spark, d):
    opf = '<package xmlns="o" xmlns:dc="d"><metadata><dc:title>A Book</dc:title><dc:language>en</dc:language><dc:creator> Ann </dc:creator></metadata></package>'
    return p.package_facts(table(spark, "work string, path string, body string", ("w", "OEBPS/p.opf", opf), ("w", "OEBPS/a.PNG", ""), ("w", "b.svg", ""), ("w", "META-INF/encryption.xml", "")))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '## ' || page_id WHEN 1 THEN '### <b>' END AS mark FROM pages WHERE html IS NOT NULL AND page_id % 3 < 2""")
def cell_marks(spark, d):
    """Pages with a table put before them: a marked cell, one whose marks are character references, and cells of code and of numbers, which aren't headings."""
    k = F.col("page_id").cast("string")
    cell = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<td> <b>#</b># "), k, F.lit("</td><td># b</td>"))).when(F.col("page_id") % 3 == 1, "<th>x</th><td>&#35;## &lt;b&gt;</td>").otherwise("<td># 1</td><td><code># no</code></td><td>C#</td>")
    pages = read(spark, d, "pages").where("html is not null")
    return p.cell_marks(pages.select("page_id", F.concat(F.lit("<table><tr>"), cell, F.lit("</tr></table>"), "html").alias("html")))


STOPS = Literal("stops", "work string, unit string, ord long, text string", ("w", "a", 1, "中文。. 和 word. 。"), ("w", "a", 2, "3.14 中文.5 ok."), ("w", "a", 3, "end. \n。"))
STOPS.also("SELECT concat('s', source), 'u', doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e.', '。 .') ELSE replace(text, 's.', '.。') END FROM {documents}")


@query(with_tables(STOPS) + r""", found AS (SELECT work, unit, ord, regexp_extract(text, '。\s*\.|\.\s*。') AS mark FROM stops WHERE regexp_matches(text, '。\s*\.|\.\s*。'))
SELECT work, unit, ord, mark FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY unit, ord) AS n FROM found) WHERE n <= 100""")
def mixed_stops(spark, d):
    return p.mixed_stops(STOPS.frame(spark, d))


KINDS = Literal("kinds_of_units", "work string, unit string, ord long, kind string", ("a", "u3", 3, "toc"), ("a", "u1", 1, "toc"), ("a", "u2", 2, "chapter"), ("b", "u1", 1, "toc"))
KINDS.also("SELECT concat('d', CAST(floor(doc_id / 12) AS BIGINT)), concat('u', doc_id), (doc_id * 7) % 101, CASE WHEN (doc_id * 31) % 9 = 0 THEN 'toc' ELSE 'chapter' END FROM {documents}")


@query(with_tables(KINDS) + " SELECT work, string_agg(unit, ',' ORDER BY ord, unit) AS units FROM kinds_of_units WHERE kind = 'toc' GROUP BY work HAVING count(*) > 1")
def contents_units(spark, d):
    return p.lists_of_units(KINDS.frame(spark, d))


@query(f"WITH {LINES}, l AS (SELECT unit, count(*) AS n, count_if(length(text) <= 80) AS n_short, count_if(regexp_matches(text, '(?i)^\\s*(?:chapter|part|book)\\s+(?:\\d+|[ivxlc]+)\\b')) AS n_chapters FROM lines GROUP BY unit) SELECT * FROM l")
def line_profile(spark, d):
    x = lines(spark, d)
    return x.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.char_length("text") <= 80).alias("n_short"), F.count_if(F.col("text").rlike(r"(?i)^\s*(?:chapter|part|book)\s+(?:\d+|[ivxlc]+)\b")).alias("n_chapters"))
