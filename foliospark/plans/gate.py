"""Queries over the gate, reviews and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import checks as c, gate as g, ledger as k
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.plans.text import NOSPACE, STRIP
from foliospark.sources.adapters import GATE, UNITS, gate_tables, units

def _nospace(x):
    return NOSPACE.format(x)


SENTENCE_NOTES = "list_transform(regexp_extract_all({}, '[^0-9][.!?]([0-9]{{1,3}})(?:[^0-9%.)]|$)', 1), lambda x: CAST(x AS BIGINT))"
ANY_NOTES = "list_concat(" + SENTENCE_NOTES + ", list_transform(regexp_extract_all({}, '[)]([0-9]{{1,3}})(?:\\s|$)', 1), lambda x: CAST(x AS BIGINT)))"
LETTERS = "length(regexp_replace(regexp_replace({}, '\\[\\^[^\\]\\s]+\\]', '', 'g'), '[^\\p{{L}}]+', '', 'g'))"
WHOLE_WORD = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_-]+'))"

#: The thirteen checks from their rules. The tables hold no code, no abbreviation and no measure before a number, so notes are plain patterns here.
FINDINGS = GATE + f""", measured AS (SELECT r.*, u.kind, u.source_md, u.target_md, coalesce(u.kind IN ('toc', 'index'), false) AS listed, length({STRIP.format('src')}) AS n, length({STRIP.format('tgt')}) AS m_, {LETTERS.format('src')} AS spoken, {LETTERS.format('tgt')} AS kept,
  {_nospace('src')} AS a, {_nospace('tgt')} AS b, {_nospace('u.source_md')} AS doc, st.reason AS style, st.pattern FROM rows_ r JOIN gate_units u USING (unit) LEFT JOIN styles st ON st.unit = r.unit AND regexp_matches(r.src, st.pattern)),
words AS (SELECT DISTINCT unit, pos, seq, unnest(regexp_extract_all(src, '[\\p{{L}}\\p{{N}}_-]+')) AS source FROM rows_ WHERE tgt <> ''),
hits AS (SELECT w.unit, w.pos, w.seq, w.source, arg_min(g.target, g.ord) AS expected FROM words w JOIN glossary g USING (source) GROUP BY ALL),
counted AS (SELECT h.*, r.note_id, sha256(nfc_normalize(r.src)) AS digest, len(list_filter(regexp_extract_all(r.src, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: x = h.source)) AS n, len(list_filter(regexp_extract_all(r.tgt, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: x = h.expected)) AS kept FROM hits h JOIN rows_ r ON r.unit = h.unit AND r.pos = h.pos),
told AS (SELECT c.unit, c.pos, c.seq, c.source, c.expected, c.n, c.kept, count_if(e.reason = 'whole') AS whole, count_if(e.reason IN ('placed', 'note', 'stale') AND (e.digest IS NULL OR e.digest = c.digest)) AS matched, count_if(e.digest <> c.digest) AS stale
  FROM counted c LEFT JOIN exemptions e ON e.unit = c.unit AND e.source = c.source AND (e.seq IS NULL OR e.seq = c.seq) AND (e.note_id IS NULL OR e.note_id = c.note_id) WHERE c.kept = 0 GROUP BY ALL),
per AS (SELECT unit, any_value(listed) AS listed, any_value(source_md) AS source_md, any_value(target_md) AS target_md, list(seq ORDER BY pos) AS seqs, count(*) AS n, bool_or(n = 0) AS no_src, bool_or(m_ = 0) AS no_tgt,
  sum(len(regexp_extract_all(src, '\\{{\\w+:\\d+\\}}'))) AS m_src, sum(len(regexp_extract_all(tgt, '\\{{\\w+:\\d+\\}}'))) AS m_tgt, sum(len({SENTENCE_NOTES.format('src')}) + len(regexp_extract_all(src, '\\[\\^[^\\]]+\\]'))) AS n_src, sum(len({SENTENCE_NOTES.format('tgt')}) + len(regexp_extract_all(tgt, '\\[\\^[^\\]]+\\]'))) AS n_tgt,
  flatten(list({ANY_NOTES.format('src', 'src')})) AS f_src, flatten(list({ANY_NOTES.format('tgt', 'tgt')})) AS f_tgt, string_agg(a, '' ORDER BY pos) AS rows_body FROM measured GROUP BY unit),
lost AS (SELECT unit, listed, number FROM (SELECT *, unnest(list_distinct(f_src)) AS number FROM per) WHERE NOT list_contains(f_tgt, number)),
ranged AS (SELECT DISTINCT l.unit, l.listed, l.number FROM lost l JOIN per p USING (unit) JOIN registered g ON g.unit = l.unit AND g.number = l.number WHERE p.target_md IS NOT NULL AND NOT list_contains({SENTENCE_NOTES.format('p.source_md')}, l.number)
  AND NOT (list_contains(regexp_extract_all(p.target_md, '\\[\\^([^\\]]+)\\]', 1), coalesce(g.ref, '')) OR list_contains(regexp_extract_all(p.target_md, '\\[\\^([^\\]]+)\\]', 1), CAST(l.number AS VARCHAR)))),
md_lines AS (SELECT unit, unnest(string_split(source_md, chr(10))) AS line, 's' AS side FROM gate_units WHERE target_md IS NOT NULL UNION ALL SELECT unit, unnest(string_split(target_md, chr(10))), 't' FROM gate_units WHERE target_md IS NOT NULL),
heads AS (SELECT unit, side, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+\\S', 1)) AS level, count(*) AS n FROM md_lines WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+\\S') GROUP BY ALL),
headed AS (SELECT unit, side, string_agg(level || ':' || n, ',' ORDER BY level) AS counts FROM heads GROUP BY ALL),
tabled AS (SELECT unit, side, count(*) AS n_rows, length(regexp_replace(any_value(line), '[^|]', '', 'g')) - 1 AS n_cols FROM md_lines WHERE starts_with(line, '|') GROUP BY ALL),
md_blocks AS (SELECT unit, unnest(range(1, len(bs) + 1)) AS i, unnest(bs) AS block FROM (SELECT unit, list_filter(list_transform(string_split_regex(source_md, '\\n\\s*\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND NOT starts_with(x, '# ')) AS bs FROM gate_units)),
findings AS (
  SELECT unit, seq, 'length' AS "check", m_ = 0 AS blocking, CASE WHEN m_ = 0 THEN 'empty' WHEN m_ / n < 0.3 THEN 'too_short' ELSE 'too_long' END AS detail FROM measured WHERE m_ = 0 OR (n >= 20 AND (m_ / n < 0.3 OR m_ / n > 3.0))
  UNION ALL SELECT unit, seq, CASE WHEN coalesce(pattern, '') = '' THEN 'length_review' ELSE 'length_review_exempt' END, coalesce(pattern, '') = '', kept || CASE WHEN coalesce(pattern, '') = '' THEN '' ELSE ':' || style END FROM measured WHERE spoken >= 80 AND m_ > 0 AND kept <= 4
  UNION ALL SELECT unit, seq, CASE WHEN style IS NOT NULL THEN 'language_exempt' WHEN kind = 'bibliography' THEN 'bibliography_identical' ELSE 'language' END, style IS NULL AND kind <> 'bibliography', coalesce(style, '') FROM measured WHERE a = b AND length(a) >= 20 AND spoken > 0
  UNION ALL SELECT unit, seq, CASE WHEN whole > 0 OR (matched > 0 AND n <= least(matched, n)) THEN 'terminology_exempt' ELSE 'terminology' END, NOT (whole > 0 OR (matched > 0 AND n <= least(matched, n))), source || ' ' || expected || CASE WHEN matched > 0 THEN ' ' || (n - least(matched, n)) ELSE '' END FROM told
  UNION ALL SELECT unit, seq, 'terminology_exempt_stale', false, source || ' ' || expected FROM told WHERE stale > 0 AND whole = 0
  UNION ALL SELECT unit, NULL, 'align', true, 'seq' FROM per WHERE seqs <> range(1, n + 1)
  UNION ALL SELECT unit, NULL, 'align', true, 'src_blank' FROM per WHERE no_src UNION ALL SELECT unit, NULL, 'align', true, 'tgt_blank' FROM per WHERE no_tgt
  UNION ALL SELECT unit, NULL, 'align', true, 'empty' FROM gate_units WHERE unit NOT IN (SELECT unit FROM rows_) AND NOT (starts_with(source_md, '#') AND starts_with(target_md, '#'))
  UNION ALL SELECT unit, NULL, 'marker', true, m_src || '/' || m_tgt FROM per WHERE m_src <> m_tgt
  UNION ALL SELECT unit, NULL, 'footnote', NOT listed, n_src || '/' || n_tgt FROM per WHERE n_tgt < n_src
  UNION ALL SELECT unit, NULL, 'footnote_suspect', false, string_agg(number, '/' ORDER BY number) FROM lost GROUP BY unit
  UNION ALL SELECT unit, NULL, 'footnote_range', NOT any_value(listed), string_agg(number, '/' ORDER BY number) FROM ranged GROUP BY unit
  UNION ALL SELECT unit, NULL, 'heading', true, coalesce(s.counts, '') || '/' || coalesce(t.counts, '') FROM (SELECT * FROM headed WHERE side = 's') s FULL JOIN (SELECT * FROM headed WHERE side = 't') t USING (unit) WHERE s.counts IS DISTINCT FROM t.counts
  UNION ALL SELECT unit, NULL, 'table', true, '1 ' || s.n_rows || 'x' || s.n_cols || '/' || t.n_rows || 'x' || t.n_cols FROM (SELECT * FROM tabled WHERE side = 's') s JOIN (SELECT * FROM tabled WHERE side = 't') t USING (unit) WHERE s.n_cols <> t.n_cols
  UNION ALL SELECT unit, NULL, 'fidelity', false, 'block ' || i FROM md_blocks LEFT JOIN per USING (unit) WHERE NOT contains(coalesce(rows_body, ''), {_nospace('block')})
  UNION ALL SELECT unit, seq, 'fidelity', true, 'row' FROM measured WHERE NOT contains(doc, a))"""


@query(f"""WITH {FINDINGS} SELECT unit, 'marker' AS "check", m_src AS src, m_tgt AS tgt, true AS blocking FROM per WHERE m_src <> m_tgt UNION ALL SELECT unit, 'footnote', n_src, n_tgt, NOT listed FROM per WHERE n_tgt < n_src""".replace("m_src AS src, m_tgt AS tgt", "m_src::BIGINT AS src, m_tgt::BIGINT AS tgt"))
def conservation(spark, d):
    tables = gate_tables(spark, d)
    return g.conservation(tables["rows"], tables["units"])


@query(f"WITH {FINDINGS} SELECT unit, string_agg(number, ',' ORDER BY number) AS numbers FROM lost GROUP BY unit")
def footnote_suspects(spark, d):
    return g.suspects(gate_tables(spark, d)["rows"])


@query(f"""WITH {FINDINGS}, s AS (SELECT * FROM heads WHERE side = 's'), t AS (SELECT * FROM heads WHERE side = 't') SELECT unit, level, coalesce(s.n, 0) AS src, coalesce(t.n, 0) AS tgt FROM s FULL JOIN t USING (unit, level) WHERE s.n IS DISTINCT FROM t.n""")
def heading_conservation(spark, d):
    return g.headings(gate_tables(spark, d)["units"].where("target_md is not null"))


@query(f"""WITH {FINDINGS} SELECT unit, 1::BIGINT AS place, s.n_rows || 'x' || s.n_cols AS src, t.n_rows || 'x' || t.n_cols AS tgt FROM (SELECT * FROM tabled WHERE side = 's') s JOIN (SELECT * FROM tabled WHERE side = 't') t USING (unit) WHERE s.n_cols <> t.n_cols""")
def table_shapes(spark, d):
    """Hand cases with several tables, escaped pipes and lone heads are in the tests."""
    return g.table_shapes(gate_tables(spark, d)["units"].where("target_md is not null"))


@query(f"""WITH {FINDINGS} SELECT unit, seq, "check", detail FROM findings WHERE "check" IN ('language', 'language_exempt', 'bibliography_identical')""")
def same_language(spark, d):
    tables = gate_tables(spark, d)
    found = c.row_findings(tables["rows"], tables["units"], tables["styles"], same_language=False, target_language="zh-CN")
    return found.where(F.col("check").isin("language", "language_exempt", "bibliography_identical")).select("unit", "seq", "check", "detail")


def findings(spark, d):
    tables = gate_tables(spark, d)
    return c.unit_flags(tables["rows"], tables["units"], tables["glossary"], tables["exemptions"], tables["styles"], tables["registered"])


@query(f"WITH {FINDINGS} SELECT * FROM findings")
def g0_findings(spark, d):
    """All thirteen checks with their exemptions and severities."""
    return findings(spark, d)


@query(f'WITH {FINDINGS} SELECT "check", count(*) AS total, count_if(blocking) AS blocking, count_if(NOT blocking) AS advisory FROM findings GROUP BY 1')
def g0_summary(spark, d):
    return g.summary(findings(spark, d))


@query(f"""WITH {FINDINGS}, open AS (SELECT u.unit AS work, count_if("check" = 'terminology' AND blocking) AS terminology_open, count_if(blocking AND "check" NOT LIKE 'terminology%') AS structure_open, count_if(NOT blocking) AS advisory FROM gate_units u LEFT JOIN findings f ON f.unit = u.unit GROUP BY ALL)
SELECT *, CASE WHEN terminology_open > 0 THEN 'terminology_open' WHEN structure_open > 0 THEN 'structure_open' ELSE 'ok' END AS reason FROM open""")
def release_by_work(spark, d):
    """The release decision from the gate's findings, each conversation a work of its own; what other stages report is in order."""
    works = gate_tables(spark, d)["units"].select(F.col("unit").alias("work"), "unit")
    counts = c.release_counts(findings(spark, d), works)
    rest = {k: v for k, v in BASE.items() if k not in ("terminology_open", "structure_open")}
    facts = counts.select("*", *[F.lit(v).alias(k) for k, v in rest.items()])
    return facts.select("work", "terminology_open", "structure_open", "advisory", F.expr(g.RELEASE_SQL).alias("reason"))


BASE = dict(terminology_open=0, conflicts_open=0, structure_open=0, review_inconsistent=0, review_unknown=0, review_open=0, contract="v2", confirmed=0, patched=0, notes_open=0, notes_review_open=0, audit_ok=True, catalog_open=0, coverage=1.0, provenance_errors=0, check_ran=True, check_code=0, check_errors=0)
CASES = [{}, {"terminology_open": 2, "structure_open": 1}, {"conflicts_open": 1, "structure_open": 1}, {"structure_open": 1, "review_unknown": 1}, {"review_inconsistent": 1, "review_unknown": 1}, {"review_unknown": 3}, {"review_open": 1}, {"contract": "none", "confirmed": 3, "patched": 2}, {"contract": "none", "confirmed": 3, "patched": 3, "review_open": 5}, {"notes_open": 1, "audit_ok": False}, {"notes_review_open": 1}, {"audit_ok": False}, {"catalog_open": 1, "coverage": 0.5}, {"coverage": 0.9998}, {"coverage": None}, {"provenance_errors": 1}, {"check_ran": False}, {"check_code": 1}, {"check_code": None}, {"check_errors": 2}]
FACTS = Literal(
    "release_facts", "work string, terminology_open long, conflicts_open long, structure_open long, review_inconsistent long, review_unknown long, review_open long, contract string, confirmed long, patched long, notes_open long, notes_review_open long, audit_ok boolean, catalog_open long, coverage double, provenance_errors long, check_ran boolean, check_code long, check_errors long",
    *[(f"w{i:02d}", *{**BASE, **case}.values()) for i, case in enumerate(CASES)],
).also(
    """SELECT concat('d', doc_id), CASE WHEN doc_id % 17 = 1 THEN 1 ELSE 0 END, CASE WHEN doc_id % 19 = 2 THEN 2 ELSE 0 END, CASE WHEN doc_id % 23 = 3 THEN 1 ELSE 0 END, CASE WHEN doc_id % 29 = 4 THEN 1 ELSE 0 END, CASE WHEN doc_id % 31 = 5 THEN 1 ELSE 0 END, CASE WHEN doc_id % 7 = 6 THEN 1 ELSE 0 END,
    CASE doc_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'legacy' ELSE 'none' END, doc_id % 5 % 2, doc_id % 4, CASE WHEN doc_id % 37 = 1 THEN 1 ELSE 0 END, CASE WHEN doc_id % 41 = 2 THEN 1 ELSE 0 END, doc_id % 13 <> 3, CASE WHEN doc_id % 43 = 4 THEN 1 ELSE 0 END, CASE WHEN doc_id % 11 = 5 THEN 0.5 WHEN doc_id % 11 = 6 THEN NULL ELSE 1.0 END,
    CASE WHEN doc_id % 47 = 6 THEN 1 ELSE 0 END, doc_id % 9 <> 7, CASE WHEN doc_id % 10 = 8 THEN 1 WHEN doc_id % 10 = 9 THEN NULL ELSE 0 END, CASE WHEN doc_id % 53 = 1 THEN 1 ELSE 0 END FROM {documents}"""
)
#: The truth table: the first reason from above that holds. The decisions of the literal rows are held in the tests.
DECIDED = """, decided AS (SELECT work, CASE WHEN terminology_open > 0 THEN 'terminology_open' WHEN conflicts_open > 0 THEN 'glossary_conflict_open' WHEN structure_open > 0 THEN 'structure_open' WHEN review_inconsistent > 0 THEN 'review_inconsistent' WHEN review_unknown > 0 THEN 'review_unknown'
  WHEN (contract <> 'none' AND review_open > 0) OR (contract = 'none' AND confirmed > patched) THEN 'unresolved_confirmed' WHEN notes_open > 0 THEN 'notes_open' WHEN notes_review_open > 0 THEN 'notes_review_open' WHEN NOT audit_ok THEN 'audit_failed' WHEN catalog_open > 0 THEN 'catalog_open'
  WHEN provenance_errors > 0 OR coverage < 0.9999 THEN 'provenance_incomplete' WHEN NOT check_ran THEN 'epubcheck_not_run' WHEN check_code IS NULL OR check_code <> 0 OR check_errors > 0 THEN 'epubcheck_errors' ELSE 'ok' END AS reason FROM release_facts)"""
LITERAL_DECISIONS = ["ok", "terminology_open", "glossary_conflict_open", "structure_open", "review_inconsistent", "review_unknown", "unresolved_confirmed", "unresolved_confirmed", "ok", "notes_open", "notes_review_open", "audit_failed", "catalog_open", "provenance_incomplete", "ok", "provenance_incomplete", "epubcheck_not_run", "epubcheck_errors", "epubcheck_errors", "epubcheck_errors"]


@query(with_tables(FACTS) + DECIDED + " SELECT work, reason, reason = 'ok' AS released FROM decided")
def release_decision(spark, d):
    return g.release(FACTS.frame(spark, d))


REVIEWS = Literal(
    "reviews", "work string, review string, scope string, units array<string>, parents array<string>, digest string",
    ("w", "r1", "full", [], [], "d1"), ("w", "r2", "units", ["a"], ["r1"], "d1"), ("w", "r3", "full", [], ["r2", "r9"], "d1"), ("w", "r4", "units", ["b"], ["r4"], "d2"), ("w", "r5", "full", [], ["r3", "r6"], "d2"), ("w", "r6", "units", [], [], "d2"),
    ("x", "r1", "full", [], ["r2"], "d1"), ("x", "r2", "full", [], ["r1"], "d1"), ("x", "r3", "full", [], ["r2"], "d1"),
).also(
    "SELECT concat('d', CAST(floor(doc_id / 8) AS BIGINT)), concat('r', 1000000 + doc_id), CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'units' END, {list}('a'), {list}(concat('r', 1000000 + CASE WHEN doc_id % 29 = 3 THEN doc_id WHEN doc_id % 31 = 4 THEN doc_id + 1 ELSE doc_id - 1 END), concat('r', 1000000 + doc_id - 3)), concat('d', doc_id % 2) FROM {documents}"
)
EDGES = ", e AS (SELECT DISTINCT work, review, parent FROM (SELECT work, review, unnest(parents) AS parent FROM reviews) WHERE (work, parent) IN (SELECT (work, review) FROM reviews))"


@query(with_tables(REVIEWS).replace("WITH ", "WITH RECURSIVE ", 1) + EDGES + ", up(work, review, ancestor) AS (SELECT work, review, parent FROM e UNION SELECT up.work, up.review, e.parent FROM up JOIN e ON up.work = e.work AND up.ancestor = e.review) SELECT work, review, ancestor FROM up")
def review_lineage(spark, d):
    return k.ancestors(REVIEWS.frame(spark, d))


@query(with_tables(REVIEWS) + """, p AS (SELECT work, review, unnest(parents) AS parent FROM reviews)
SELECT * FROM (SELECT p.work, p.review, CASE WHEN parent = p.review THEN 'parent_self' WHEN q.review IS NULL THEN 'parent_missing' WHEN parent > p.review THEN 'parent_not_earlier' END AS code, parent FROM p LEFT JOIN reviews q ON p.work = q.work AND p.parent = q.review) WHERE code IS NOT NULL""")
def lineage_findings(spark, d):
    return k.lineage_findings(REVIEWS.frame(spark, d))


ISSUES = Literal("issues", "work string, review string, issue string, unit string", ("w", "r1", "i1", "a"), ("w", "r1", "i2", "b"), ("w", "r1", "i3", "a"), ("w", "r3", "i4", "b"), ("x", "r1", "i1", "a"))
CLOSED = Literal(
    "dispositions", "work string, review string, issue string, status string, closed_by string, evidence string",
    ("w", "r2", "i1", "fixed", "me", "seen"), ("w", "r2", "i3", "fixed", "me", " "), ("w", "r3", "i2", "rejected", "me", "ok"), ("w", "r3", "i3", "accepted", "me", "ok"), ("w", "r5", "i4", "fixed", "me", "ok"), ("x", "r3", "i1", "odd", "me", "ok"),
)
STANDING = Literal(
    "expected_issues", "work string, issue string, status string, origin string, note string",
    ("w", "i1", "fixed", "r1", "closed:r2"), ("w", "i2", "rejected", "r1", "closed:r3"), ("w", "i3", "accepted", "r1", "closed:r3"), ("w", "i4", "unknown", "r3", "inputs_changed:r5"), ("x", "i1", "unknown", "r1", "undisposed:r2"),
)


@query(with_tables(STANDING) + " SELECT * FROM expected_issues")
def review_ledger(spark, d):
    """Worked by hand."""
    reviews = REVIEWS.frame(spark).withColumn("digests", F.create_map(F.lit("*"), "digest")).drop("digest")
    return k.effective_issues(reviews, ISSUES.frame(spark), CLOSED.frame(spark))


ROUNDS = Literal(
    "rounds", "work string, round long, has_issues boolean, summary string, unresolved boolean",
    *[("clean", i, False, None, False) for i in (1, 2, 3)], *[("cycle", i, True, "ABAB"[i - 1], False) for i in (1, 2, 3, 4)], *[("max", i, i % 2 == 1, str(i), False) for i in range(1, 8)],
    ("fix", 1, True, "x", True), ("fix", 2, False, None, True), ("open", 1, True, "x", False), ("open", 2, True, "y", False), ("skip", 1, True, "A", False), ("skip", 2, False, None, False), ("skip", 3, True, "B", False), ("skip", 4, True, "A", False),
).also("SELECT concat(source, '-', doc_id % 7), doc_id, (doc_id * 31) % 5 < 3, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('x', doc_id % 2) END, doc_id % 4 = 0 FROM {documents}")
ENDED = """, r AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN has_issues THEN 1 ELSE 0 END) OVER w AS bad FROM rounds WINDOW w AS (PARTITION BY work ORDER BY round)), s AS (SELECT *, sum(CASE WHEN has_issues THEN 0 ELSE 1 END) OVER (PARTITION BY work, bad ORDER BY round) AS streak FROM r),
b AS (SELECT work, round, lag(coalesce(summary, ''), 2) OVER (PARTITION BY work ORDER BY round) = coalesce(summary, '') AS cycle FROM rounds WHERE has_issues),
t AS (SELECT s.work, s.round, CASE WHEN coalesce(cycle, false) THEN 'no_progress' WHEN streak >= 2 THEN 'clean_confirmed' WHEN unresolved AND NOT has_issues THEN 'unresolved_fixes' WHEN n >= 6 THEN 'max_rounds' END AS termination FROM s LEFT JOIN b ON b.work = s.work AND b.round = s.round),
first AS (SELECT work, min(CASE WHEN termination IS NOT NULL THEN round END) AS stop, max(round) AS last FROM t GROUP BY work)"""


@query(with_tables(ROUNDS) + ENDED + " SELECT f.work, coalesce(stop, last) AS round, coalesce(termination, '') AS termination FROM first f LEFT JOIN t ON t.work = f.work AND t.round = f.stop")
def review_convergence(spark, d):
    return k.convergence(ROUNDS.frame(spark, d))


BATCHES = Literal(
    "batches", "batch string, book string, version string, digest string",
    ("b1", "x", "1.2", "d1"), ("b2", "x", "1.10", "d2"), ("b3", "y", "1.0", "d3"), ("b4", "y", "1.0", "d4"), ("b5", "x", "1.2", "d1"), ("b5", "z", "2.0", "d5"), ("b6", "z", "1.9", "d6"), ("b7", "q", None, "d7"), ("b8", "x", "v1.9", "d8"),
).also("SELECT concat('p', CAST(floor(p_partkey / 3) AS BIGINT)), concat('k', p_partkey % 90), CASE WHEN p_partkey % 13 = 4 THEN NULL ELSE concat(CASE WHEN p_partkey % 5 = 0 THEN 'v' ELSE '' END, p_partkey % 3, '.', p_size % 14) END, concat('d', p_size % 40) FROM {part}")
#: Versions have two parts here; longer ones are in the tests.
ACTIONS = """, x AS (SELECT *, CAST(split_part(regexp_replace(version, '^[vV]', ''), '.', 1) AS INTEGER) * 1000 + CAST(split_part(version, '.', 2) AS INTEGER) AS v FROM batches), y AS (SELECT *, max(v) OVER (PARTITION BY book) AS top FROM x), c AS (SELECT book, version, count(DISTINCT digest) AS n FROM batches WHERE version IS NOT NULL GROUP BY ALL),
s AS (SELECT batch, bool_or(coalesce(n, 0) > 1) AS clash, bool_or(v IS NULL) AS bare, bool_and(v = top) AS every_, bool_or(v = top) AS some_ FROM y LEFT JOIN c ON c.book = y.book AND c.version = y.version GROUP BY batch)"""


@query(with_tables(BATCHES) + ACTIONS + " SELECT batch, CASE WHEN clash THEN 'blocked' WHEN bare THEN 'hold' WHEN every_ THEN 'keep' WHEN some_ THEN 'hold' ELSE 'move' END AS action FROM s")
def archive_plan(spark, d):
    return k.archive_plan(BATCHES.frame(spark, d))


@query(f"WITH {UNITS}, n AS (SELECT work, unit, {NOSPACE.format('text')} AS body FROM units) SELECT * FROM (SELECT work, unit, count(*) OVER (PARTITION BY work, body) AS n FROM n) WHERE n > 1")
def duplicate_units(spark, d):
    return g.duplicate_units(units(spark, d))


OLD = Literal("old_units", "work string, unit string, status string", ("a", "u1", "built"), ("a", "u2", "pending"), ("a", "u3", "reviewed")).also(
    "SELECT concat('s', source), concat('u', doc_id), CASE doc_id % 3 WHEN 0 THEN 'built' WHEN 1 THEN 'pending' ELSE 'reviewed' END FROM {documents} WHERE doc_id % 5 <> 0"
)
NEW = Literal("new_units", "work string, unit string, status string", ("a", "u1", "pending"), ("a", "u3", "pending"), ("a", "u4", "pending")).also(
    "SELECT concat('s', source), concat('u', doc_id), 'pending' FROM {documents} WHERE doc_id % 7 <> 0"
)


@query(with_tables(OLD, NEW) + " SELECT coalesce(n.work, o.work) AS work, coalesce(n.unit, o.unit) AS unit, CASE WHEN n.unit IS NULL THEN 'gone' ELSE coalesce(o.status, n.status) END AS status FROM new_units n FULL JOIN old_units o ON n.work = o.work AND n.unit = o.unit")
def carried_units(spark, d):
    return g.carried_units(NEW.frame(spark, d), OLD.frame(spark, d))


TASKS = Literal("tasks", "work string, task string, priority long, applicable boolean", ("a", "import", 2, True), ("a", "preprocess", 1, False), ("a", "build", 3, True), ("b", "build", 3, True), ("c", "qa", 1, False)).also(
    "SELECT concat('s', source), concat('t', doc_id), (doc_id * 7919) % 100003, doc_id % 3 = 0 FROM {documents}"
)


@query(with_tables(TASKS) + " SELECT work, arg_min(task, priority) AS task FROM tasks WHERE applicable GROUP BY work")
def next_task(spark, d):
    return g.calibrate_priority(TASKS.frame(spark, d))
