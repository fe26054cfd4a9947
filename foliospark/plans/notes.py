"""Queries over notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.udfs import count_sentence_notes, find_note_numbers
from foliospark.operators import notes as n
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.sources.adapters import LINES, lines

NOTES = Literal(
    "notes", "note_id string, scope_id string, source_label string, source_markdown string, n_locations long, status string, note_type string, orphan_ok boolean",
    ("n-000001", "s1", "1", "first", 1, "confirmed", "footnote", None), ("n-000002", "s1", "01", "second", 1, "confirmed", "footnote", None), ("n-000002", "s2", "1", "again", 0, "odd", "", None),
    ("bad", "", " ", "", None, "unresolved", None, True), ("n-000003", "s2", "*", "star", 2, "candidate", "endnote", False), ("n-000004", "s2", "2", "two", 1, "confirmed", "endnote", True),
).also(
    "SELECT concat('n-', lpad(concat('', doc_id + 100), 6, '0')), concat('s', source), concat('', doc_id % 40), CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'note' END, doc_id % 5, CASE doc_id % 9 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'odd' ELSE 'confirmed' END, 'footnote', doc_id % 2 = 0 FROM {documents}"
)
REFS = Literal(
    "refs", "ref_id string, note_id string, unit string, scope_id string, status string",
    ("ref-000001", "n-000001", "u1", "s1", "confirmed"), ("ref-000002", "n-000002", "u1", "s1", "confirmed"), ("ref-000002", "n-000009", "u9", "", "nope"), ("r3", "n-000002", "u2", "s2", "candidate"), ("ref-000004", "n-000001", "u3", "s1", "confirmed"),
).also(
    "SELECT concat('ref-', lpad(concat('', doc_id + 100 - doc_id % 13 % 2), 6, '0')), concat('n-', lpad(concat('', doc_id * 2), 6, '0')), CASE WHEN doc_id % 6 = 0 THEN 'u9' ELSE 'u1' END, CASE WHEN doc_id % 8 = 0 THEN '' ELSE 's' END, CASE WHEN doc_id % 10 = 0 THEN 'odd' ELSE 'candidate' END FROM {documents}"
)
UNITS = Literal("unit_md", "unit string, md string", ("u1", "Text[^ref-000001] and [^ref-000002] and [^ref-000002].\n```\n[^ref-000007]\n```\n"), ("u2", "Nothing here but [^ref-000009]"), ("u4", None))


@query(with_tables(NOTES, REFS, UNITS) + r""", lab AS (SELECT coalesce(scope_id, '') AS scope, CASE WHEN regexp_full_match(trim(source_label), '[0-9]+') AND CAST(trim(source_label) AS BIGINT) > 0 THEN CAST(CAST(trim(source_label) AS BIGINT) AS VARCHAR) ELSE trim(coalesce(source_label, '')) END AS label FROM notes)
SELECT 'note_id_format' AS code, note_id AS entity FROM notes WHERE NOT regexp_full_match(note_id, 'n-\d{6}') UNION ALL SELECT 'ref_id_format', ref_id FROM refs WHERE NOT regexp_full_match(ref_id, 'ref-\d{6}')
UNION ALL SELECT 'note_scope_id_blank', note_id FROM notes WHERE trim(coalesce(scope_id, '')) = '' UNION ALL SELECT 'note_source_label_blank', note_id FROM notes WHERE trim(coalesce(source_label, '')) = '' UNION ALL SELECT 'note_source_markdown_blank', note_id FROM notes WHERE trim(coalesce(source_markdown, '')) = ''
UNION ALL SELECT 'note_note_type_blank', note_id FROM notes WHERE trim(coalesce(note_type, '')) = '' UNION ALL SELECT 'note_no_location', note_id FROM notes WHERE coalesce(n_locations, 0) = 0 UNION ALL SELECT 'note_status', note_id FROM notes WHERE coalesce(status, '') NOT IN ('confirmed', 'candidate', 'unresolved')
UNION ALL SELECT 'note_unresolved', note_id FROM notes WHERE status = 'unresolved' UNION ALL SELECT 'ref_scope_id_blank', ref_id FROM refs WHERE trim(coalesce(scope_id, '')) = '' UNION ALL SELECT 'ref_status', ref_id FROM refs WHERE coalesce(status, '') NOT IN ('confirmed', 'candidate', 'unresolved')
UNION ALL SELECT 'note_id_twice', note_id FROM notes GROUP BY note_id HAVING count(*) > 1 UNION ALL SELECT 'ref_id_twice', ref_id FROM refs GROUP BY ref_id HAVING count(*) > 1
UNION ALL SELECT 'ref_note_unknown', ref_id FROM refs WHERE note_id NOT IN (SELECT note_id FROM notes) UNION ALL SELECT 'ref_unit_unknown', ref_id FROM refs WHERE unit NOT IN (SELECT unit FROM unit_md)
UNION ALL SELECT 'label_twice', scope || '/' || label FROM lab GROUP BY scope, label HAVING count(*) > 1 UNION ALL SELECT 'note_orphan', note_id FROM notes WHERE NOT coalesce(orphan_ok, false) AND note_id NOT IN (SELECT note_id FROM refs)""")
def note_graph_violations(spark, d):
    return n.graph_violations(NOTES.frame(spark, d), REFS.frame(spark, d), UNITS.frame(spark).select("unit"))


BALANCE = Literal("expected_balance", "unit string, ref_id string, code string", ("u1", "ref-000002", "mark_repeated"), ("u2", "r3", "mark_missing"), ("u2", "ref-000009", "mark_unknown"), ("u9", "ref-000002", "unit_missing"), ("u3", "ref-000004", "unit_missing"))


@query(with_tables(BALANCE) + " SELECT * FROM expected_balance")
def marker_balance(spark, d):
    """Worked by hand: the mark in code doesn't count."""
    return n.marker_balance(UNITS.frame(spark), REFS.frame(spark))


SOURCE_NOTES = Literal("source_notes", "note_id string, src_digest string", ("n1", "a"), ("n2", "b"), ("n3", "c"), ("n4", "d"), ("n5", "e")).also(
    "SELECT concat('m', doc_id), concat('a', doc_id % 5) FROM {documents} WHERE doc_id % 6 <> 1"
)
TARGET_NOTES = Literal("target_notes", "note_id string, target_markdown string, tgt_digest string", ("n1", "eins", "A"), ("n2", " ", "B"), ("n3", "drei", "C"), ("n3", "drei", "C"), ("n9", "neun", "N"), ("n5", "fünf", "E")).also(
    "SELECT concat('m', doc_id - doc_id % 17 % 2), CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'note' END, concat('b', (doc_id - doc_id % 17 % 2) % 3) FROM {documents} WHERE doc_id % 5 <> 1"
)
REQUIRED = Literal("required", "note_id string", ("n1",), ("n2",), ("n4",)).also(
    "SELECT concat('m', doc_id) FROM {documents} WHERE doc_id % 3 = 0"
)


@query(with_tables(SOURCE_NOTES, TARGET_NOTES, REQUIRED) + """, f AS (SELECT note_id FROM target_notes WHERE trim(coalesce(target_markdown, '')) <> '')
SELECT note_id, 'repeated' AS code FROM target_notes GROUP BY note_id HAVING count(*) > 1 UNION ALL SELECT note_id, 'unknown' FROM target_notes WHERE note_id NOT IN (SELECT note_id FROM source_notes)
UNION ALL SELECT DISTINCT note_id, 'blank' FROM target_notes WHERE note_id NOT IN (SELECT note_id FROM f) UNION ALL SELECT note_id, 'missing' FROM required WHERE note_id NOT IN (SELECT note_id FROM f)""")
def translation_note_violations(spark, d):
    return n.translation_violations(SOURCE_NOTES.frame(spark, d), TARGET_NOTES.frame(spark, d), REQUIRED.frame(spark, d))


PREVIOUS = Literal("previous", "note_id string, disposition string, was_src string, was_tgt string", ("n1", "accepted", "a", "A"), ("n3", "accepted", "c", "old"), ("n4", "accepted", "d", "D")).also(
    "SELECT concat('m', doc_id), 'accepted', concat('a', doc_id % 5 % 4), concat('b', doc_id % 3 % 2) FROM {documents} WHERE doc_id % 2 = 0"
)


@query(with_tables(SOURCE_NOTES, TARGET_NOTES, PREVIOUS) + """, t AS (SELECT DISTINCT note_id, tgt_digest FROM target_notes)
SELECT s.note_id, CASE WHEN tgt_digest IS NULL THEN 'untranslated' WHEN disposition IS NULL THEN 'open' WHEN src_digest = was_src AND tgt_digest = was_tgt THEN disposition ELSE 'stale' END AS status FROM source_notes s LEFT JOIN t USING (note_id) LEFT JOIN previous USING (note_id)""")
def note_review(spark, d):
    return n.review(SOURCE_NOTES.frame(spark, d), TARGET_NOTES.frame(spark, d).select("note_id", "tgt_digest").distinct(), PREVIOUS.frame(spark, d))


CAND_LINES = Literal(
    "cand_lines", "unit string, line long, text string",
    ("u1", 1, "It ended.12 Then more."), ("u1", 2, "See [^a] and [^ref-000001]."), ("u1", 3, "[^a]: the definition"), ("u1", 4, "241 Kubik, a long note text"), ("u1", 5, "12 short"), ("u1", 6, "It ended.12 Then more."), ("u2", 1, "p.66 only a page, 46% of it.46%"), ("u2", 2, "Ratio 3.14 and (X)14 here"),
).also(
    "SELECT concat('p', p_partkey), p_size, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ended.', 10 + p_partkey % 80, ' Then more.') WHEN 1 THEN concat(10 + p_partkey % 80, ' ', p_name, ' goes on') WHEN 2 THEN concat('[^', p_type, ']: see ', p_name) ELSE concat(p_name, ' (x)', 10 + p_partkey % 80) END FROM {part}"
)
CANDS = Literal(
    "expected_candidates", "unit string, line long, kind string, label string, head string, nth long",
    ("u1", 1, "marker", "12", "It ended.12 Then more.", 0), ("u1", 2, "pandoc_ref", "a", "See [^a] and [^ref-000001].", 0), ("u1", 3, "pandoc_ref", "a", "[^a]: the definition", 0), ("u1", 3, "definition", "a", "[^a]: the definition", 0),
    ("u1", 4, "numbered_paragraph", "241", "241 Kubik, a long note text", 0), ("u1", 6, "marker", "12", "It ended.12 Then more.", 1), ("u2", 2, "marker", "14", "Ratio 3.14 and (X)14 here", 0),
).also(
    "SELECT concat('p', p_partkey), p_size, 'marker', concat('', 10 + p_partkey % 80), CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' ended.', 10 + p_partkey % 80, ' Then more.') ELSE concat(p_name, ' (x)', 10 + p_partkey % 80) END, 0 FROM {part} WHERE p_partkey % 4 IN (0, 3) UNION ALL SELECT concat('p', p_partkey), p_size, 'numbered_paragraph', concat('', 10 + p_partkey % 80), concat(10 + p_partkey % 80, ' ', p_name, ' goes on'), 0 FROM {part} WHERE p_partkey % 4 = 1 UNION ALL SELECT concat('p', p_partkey), p_size, 'pandoc_ref', p_type, concat('[^', p_type, ']: see ', p_name), 0 FROM {part} WHERE p_partkey % 4 = 2 UNION ALL SELECT concat('p', p_partkey), p_size, 'definition', p_type, concat('[^', p_type, ']: see ', p_name), 0 FROM {part} WHERE p_partkey % 4 = 2"
)


@query(with_tables(CANDS) + " SELECT 'c-' || substr(sha1(concat_ws('|', unit, kind, label, head, nth)), 1, 10) AS candidate_id, unit, line, kind, label FROM expected_candidates")
def note_candidates(spark, d):
    return n.candidates(CAND_LINES.frame(spark, d))


NUM_NOTES = Literal("num_notes", "note_id string, scope_id string, source_label string", ("n1", "s1", "2"), ("n2", "s1", "*"), ("n3", "s1", "a"), ("n4", "s1", "1"), ("n5", "s2", "†"), ("n6", "s2", "0"), ("n7", "s1", "‡"))
NUM_REFS = Literal("num_refs", "note_id string, unit string, unit_ord long, place long", ("n1", "u2", 2, 1), ("n1", "u1", 1, 9), ("n2", "u1", 1, 5), ("n3", "u1", 1, 2), ("n4", "u2", 2, 3), ("n6", "u3", 3, 1), ("n5", "u3", 3, 2))
NUMBERED = Literal("expected_numbers", "note_id string, host string, number long", ("n1", "u1", 2), ("n2", "u1", 4), ("n3", "u1", 3), ("n4", "u2", 1), ("n5", "u3", 2), ("n6", "u3", 1), ("n7", None, 5))


@query(with_tables(NUMBERED) + " SELECT * FROM expected_numbers")
def note_numbering(spark, d):
    return n.numbering(NUM_NOTES.frame(spark, d), NUM_REFS.frame(spark, d))


NOTE_TEXTS = Literal(
    "note_texts", "id long, text string, toc boolean, n_refs long, numbers string",
    (1, "End.1 More (стр.66) and 3.14.", False, 1, "1"), (2, "正文。12 下一句。3 月 后", False, 1, "12"), (3, "Chapter one ........ 12", False, 0, ""), (4, "He hesitated ...1", False, 1, "1"), (5, "He hesitated ...1", True, 0, ""), (6, "list。1. item", False, 0, ""), (7, "note [240] and 〔7〕 and [007]", False, 0, "7,240"),
    (8, "said it,\" 23 (X)14 here", False, 0, "14"), (9, "World War II.5", True, 0, ""), (10, "World War II.5", False, 1, "5"), (11, "", False, 0, ""), (12, "46%。46%的", False, 0, ""),
).also(
    "SELECT 100 + p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' ended.' WHEN 1 THEN ' said”' WHEN 2 THEN ' see fig.' ELSE ' of ' END, 10 + p_partkey % 80), false, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 4 < 2 THEN concat('', 10 + p_partkey % 80) ELSE '' END FROM {part}"
)


@query(with_tables(NOTE_TEXTS) + " SELECT id, n_refs, numbers FROM note_texts")
def footnote_numbers(spark, d):
    """Worked by hand; see the rules in the functions."""
    x = NOTE_TEXTS.frame(spark, d)
    return x.select("id", count_sentence_notes(F.col("text"), F.col("toc")).alias("n_refs"), F.array_join(find_note_numbers(F.col("text"), F.col("toc")).cast("array<string>"), ",").alias("numbers"))
