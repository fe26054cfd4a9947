"""Queries over texts and aligned rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions import udfs
from foliospark.operators import align, passages
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.session import read
from foliospark.sources import sinks
from foliospark.sources.adapters import ALIGNED, LINES, UNITS, aligned, lines, units

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
NOSPACE = r"regexp_replace({}, '[\s\p{{Z}}]+', '', 'g')"
LENGTHS = f"""lengths AS (SELECT unit, seq, CAST(length({STRIP.format('src')}) AS BIGINT) AS src_chars, CAST(length({STRIP.format('tgt')}) AS BIGINT) AS tgt_chars FROM aligned),
gate AS (SELECT *, CASE WHEN src_chars = 0 THEN 0.0 ELSE tgt_chars / src_chars END AS q FROM lengths),
found AS (SELECT *, CASE WHEN tgt_chars = 0 THEN 'empty' WHEN src_chars >= 20 AND q < 0.3 THEN 'too_short' WHEN src_chars >= 20 AND q > 3.0 THEN 'too_long' END AS code FROM gate)"""


@query(f"WITH {ALIGNED} SELECT unit, seq, src, tgt FROM aligned")
def align_pairs(spark, d):
    return aligned(spark, d)


@query(f"WITH {ALIGNED}, {LENGTHS} SELECT unit, seq, code, src_chars, tgt_chars, round(q, 6) AS ratio, code = 'empty' AS blocking FROM found WHERE code IS NOT NULL")
def length_gate(spark, d):
    return align.length_findings(aligned(spark, d))


@query(f"""WITH {ALIGNED}, {LENGTHS} SELECT unit, count(*) AS n_rows, count_if(code = 'empty') AS n_empty, count_if(code = 'too_short') AS n_short, count_if(code = 'too_long') AS n_long FROM found GROUP BY unit""")
def length_gate_by_work(spark, d):
    rows = aligned(spark, d)
    found = align.length_findings(rows).select("unit", "seq", "code")
    counts = rows.join(found, ["unit", "seq"], "left").groupBy("unit")
    return counts.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("code") == c).alias(n) for n, c in (("n_empty", "empty"), ("n_short", "too_short"), ("n_long", "too_long"))])


@query(rf"""WITH p AS (SELECT CASE WHEN quality = 1 THEN 'ok' ELSE 'missing' END AS label, {STRIP.format("split_part(text, chr(10), 1)")} AS src,
  {STRIP.format("CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")} AS tgt FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
f AS (SELECT label = 'missing' AS m, length(tgt) = 0 OR (length(src) >= 20 AND (length(tgt) / length(src) < 0.3 OR length(tgt) / length(src) > 3.0)) AS x FROM p),
c AS (SELECT count_if(x AND m) AS tp, count_if(x AND NOT m) AS fp, count_if(NOT x AND m) AS fn, count_if(NOT x AND NOT m) AS tn FROM f)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def length_calibration(spark, d):
    at = F.instr("text", "\n")
    pairs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").where("quality is not null")
    pairs = pairs.select(F.when(F.col("quality") == 1, "ok").otherwise("missing").alias("label"), F.substring_index("text", "\n", 1).alias("src"), F.when(at > 0, F.substr("text", at + 1)).otherwise("").alias("tgt"))
    return align.calibration(pairs)


ALIGN_ROWS = Literal(
    "align_rows", "unit string, file_pos long, seq long, src string, tgt string",
    ("a", 1, 1, "One line here.", "Eine Zeile hier."), ("a", 2, 3, "A gap.", "Eine Lücke."), ("a", 3, 3, "Twice the same.", "  "),
    ("b", 1, 1, "", "Ohne Quelle."), ("b", 2, 2, "Whole.", "Ganz."), ("c", 1, None, "No number.", None), ("c", 2, 2, " \t", "x"),
).also(
    "SELECT concat('c', conv_id), turn + 1, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 9 ELSE turn + 1 END, CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END, CASE WHEN turn % 5 = 3 THEN '  ' ELSE text END FROM {conversations}"
)


@query(with_tables(ALIGN_ROWS) + rf""", p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY file_pos) AS place FROM align_rows)
SELECT unit, file_pos, seq, 'seq' AS code FROM p WHERE seq IS DISTINCT FROM place
UNION ALL SELECT unit, file_pos, seq, 'src_blank' FROM p WHERE {STRIP.format("coalesce(src, '')")} = ''
UNION ALL SELECT unit, file_pos, seq, 'tgt_blank' FROM p WHERE {STRIP.format("coalesce(tgt, '')")} = ''""")
def align_integrity(spark, d):
    return align.integrity(ALIGN_ROWS.frame(spark, d))


SENTENCES = rf"""cut AS (SELECT unit, string_split_regex(regexp_replace(text, '([。！？!?；;.؟؛۔])', '\1' || chr(10), 'g'), '\n+') AS parts FROM units),
trimmed AS (SELECT unit, list_filter(list_transform(parts, lambda p: {STRIP.format('p')}), lambda p: p <> '') AS s FROM cut)"""


@query(f"WITH {UNITS}, {SENTENCES} SELECT unit, unnest(range(1, len(s) + 1)) AS seq, unnest(s) AS sentence FROM trimmed")
def sentence_split(spark, d):
    return units(spark, d).select("unit", F.posexplode(t.sentences(F.col("text"))).alias("at", "sentence")).select("unit", (F.col("at") + 1).cast("long").alias("seq"), "sentence")


@query(f"WITH {UNITS}, {SENTENCES} SELECT unit, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda p: length(p))), 0) AS BIGINT) AS longest FROM trimmed")
def sentence_counts(spark, d):
    s = F.col("s")
    return units(spark, d).select("unit", t.sentences(F.col("text")).alias("s")).select("unit", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.char_length)), F.lit(0)).cast("long").alias("longest"))


@query(rf"""WITH {ALIGNED}, s AS (SELECT unit, seq AS pair,
  list_filter(list_transform(string_split_regex(regexp_replace(src, '([。！？!?；;.؟؛۔])', '\1' || chr(10), 'g'), '\n+'), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS a,
  list_filter(list_transform(string_split_regex(regexp_replace(tgt, '([。！？!?；;.؟؛۔])', '\1' || chr(10), 'g'), '\n+'), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS b FROM aligned),
n AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS seq FROM s)
SELECT unit || '/' || pair AS unit, seq, coalesce(a[seq], '') AS src, coalesce(b[seq], '') AS tgt, CASE WHEN seq > len(a) OR seq > len(b) THEN 'split' END AS note FROM n""")
def align_rows(spark, d):
    return align.zipped(aligned(spark, d).select(F.concat_ws("/", F.col("unit").cast("string"), F.col("seq").cast("string")).alias("unit"), "src", "tgt"))


WORDS = r"CAST(len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')) + len(regexp_extract_all(text, '[A-Za-z]+')) + len(regexp_extract_all(text, '[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]+')) AS BIGINT)"
PARAGRAPHS = rf"CAST(len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: {STRIP.format('p')} <> '')) AS BIGINT)"
FACTS = f"""{UNITS}, {SENTENCES}, facts AS (SELECT work, unit, CAST(length(text) AS BIGINT) AS chars, {WORDS} AS words, {PARAGRAPHS} AS paragraphs, CAST(len(s) AS BIGINT) AS sentences FROM units JOIN trimmed USING (unit))"""


def facts(spark, d):
    x = F.col("text")
    paragraphs = F.size(F.filter(F.split(x, r"\n\s*\n"), lambda p: t.stripped(p) != ""))
    return units(spark, d).select("work", "unit", t.long_length(x).alias("chars"), t.word_count(x).alias("words"), paragraphs.cast("long").alias("paragraphs"), F.size(t.sentences(x)).cast("long").alias("sentences"))


@query(f"WITH {FACTS} SELECT * FROM facts")
def unit_facts(spark, d):
    return facts(spark, d)


@query(f"WITH {FACTS} SELECT work, grouping(work) = 1 AS total, count(*) AS units, sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words, sum(paragraphs)::BIGINT AS paragraphs, sum(sentences)::BIGINT AS sentences, max(chars) AS longest FROM facts GROUP BY ROLLUP (work)")
def facts_rollup(spark, d):
    rolled = facts(spark, d).rollup("work")
    return rolled.agg((F.grouping("work") == 1).alias("total"), F.count("*").alias("units"), *[F.sum(c).alias(c) for c in ("chars", "words", "paragraphs", "sentences")], F.max("chars").alias("longest"))


@query(rf"""WITH {UNITS}, u AS (SELECT work, unit, length(text) AS chars, {STRIP.format("split_part(text, ' ', 1)")} AS title FROM units),
s AS (SELECT work, list_sort(list(chars)) AS c, count(*) AS n, count_if(title = '' OR lower(title) = 'unknown') AS unknown, count_if(regexp_full_match(title, '[^\p{{L}}]+')) AS numeric_, count_if(chars < 200) AS tiny FROM u GROUP BY work),
m AS (SELECT *, CAST(CASE WHEN n % 2 = 1 THEN c[n // 2 + 1] ELSE (c[n // 2] + c[n // 2 + 1]) // 2 END AS BIGINT) AS median FROM s)
SELECT work, n AS units, median AS median_chars, CAST(c[1] AS BIGINT) AS min_chars, unknown AS unknown_title_units, numeric_ AS numeric_title_units, tiny AS tiny_units,
  n >= 5 AND (median < 300 OR unknown * 2 > n OR numeric_ * 2 > n OR tiny * 2 > n) AS warning FROM m""")
def granularity(spark, d):
    """Is a work cut too fine? The median is the floored mean of the middle two."""
    title = t.stripped(F.substring_index("text", " ", 1))
    u = units(spark, d).select("work", t.long_length(F.col("text")).alias("chars"), title.alias("title"))
    by_size = Window.partitionBy("work").orderBy("chars", "title")
    u = u.withColumn("at", F.row_number().over(by_size)).withColumn("n", F.count("*").over(Window.partitionBy("work")))
    middle = (F.col("at") == F.floor((F.col("n") + 1) / 2)) | (F.col("at") == F.floor(F.col("n") / 2) + 1)
    s = u.groupBy("work").agg(
        F.count("*").alias("units"), F.floor(F.avg(F.when(middle, F.col("chars")))).cast("long").alias("median_chars"), F.min("chars").alias("min_chars"),
        F.count_if((F.col("title") == "") | (F.lower("title") == "unknown")).alias("unknown_title_units"), F.count_if(F.col("title").rlike(r"^[^\p{L}]+$")).alias("numeric_title_units"), F.count_if(F.col("chars") < 200).alias("tiny_units"),
    )
    n = F.col("units")
    return s.withColumn("warning", (n >= 5) & ((F.col("median_chars") < 300) | (F.col("unknown_title_units") * 2 > n) | (F.col("numeric_title_units") * 2 > n) | (F.col("tiny_units") * 2 > n)))


LANGUAGE_TEXTS = Literal(
    "samples", "id long, text string",
    (1, "これは日本語です"), (2, "这是中文句子"), (3, "한국어 문장"), (4, "Это русский"), (5, "هذا نص"), (6, "plain English"), (7, ""), (8, "1234 !!"), (9, "漢字だけ少しかな"), (10, "   "), (11, None),
)
LANG_SQL = """CASE WHEN han > 0 OR kana > 0 THEN CASE WHEN kana > han * 0.1 THEN 'ja' ELSE 'zh' END WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END"""


@query(with_tables(LANGUAGE_TEXTS) + rf""", x AS (SELECT id, coalesce(text, '') AS text FROM samples UNION ALL SELECT 1000 + doc_id, coalesce(text, '') FROM documents),
c AS (SELECT *, len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) AS han, len(regexp_extract_all(text, '[぀-ゟ゠-ヿ]')) AS kana FROM x), l AS (SELECT id, text, {LANG_SQL} AS language FROM c)
SELECT id, language, CASE WHEN {STRIP.format('text')} = '' OR (language = 'en' AND NOT regexp_matches(text, '[A-Za-z]')) THEN 'und' ELSE language END AS source_language FROM l""")
def detect_language(spark, d):
    x = LANGUAGE_TEXTS.frame(spark).union(read(spark, d, "documents").select(F.col("doc_id") + 1000, "text")).select("id", t.text_of("text").alias("text"))
    return x.select("id", t.language(F.col("text")).alias("language"), t.source_language(F.col("text")).alias("source_language"))


@query(f"""WITH m AS (SELECT unnest({list(t.ACADEMIC_MARKERS)}) AS marker), h AS (SELECT doc_id, count_if(contains(lower(coalesce(text, '')), marker)) AS hits FROM documents, m GROUP BY doc_id)
SELECT doc_id, hits, CASE WHEN hits >= 2 THEN 'academic' WHEN regexp_matches(coalesce(text, ''), '(?m)^(?:[A-Z][A-Za-z ,''-]{{3,40}}\\n){{3,}}') THEN 'newspaper' ELSE 'novel' END AS genre FROM documents JOIN h USING (doc_id)""")
def detect_genre(spark, d):
    x = t.text_of("text")
    hits = sum((F.contains(F.lower(x), F.lit(m)).cast("long") for m in t.ACADEMIC_MARKERS), F.lit(0).cast("long"))
    return read(spark, d, "documents").select("doc_id", hits.alias("hits"), t.genre(x).alias("genre"))


COPYRIGHT = Literal(
    "imprints", "id long, text string",
    (1, "A novel. All rights reserved. First published 1999."), (2, "First published 2001, Printed in Ghent."), (3, "Plain text."), (4, "Printed in Oslo. First published later. All rights reserved"), (5, None), (6, "British Library Cataloguing in Publication"),
)


@query(with_tables(COPYRIGHT) + f""", m AS (SELECT unnest({list(t.COPYRIGHT_MARKERS)}) AS marker, unnest(range(1, {len(t.COPYRIGHT_MARKERS) + 1})) AS place),
x AS (SELECT id, coalesce(text, '') AS text FROM imprints UNION ALL SELECT 1000 + doc_id, coalesce(text, '') FROM documents),
f AS (SELECT id, min(place) AS place FROM x JOIN m ON contains(text, marker) GROUP BY id)
SELECT id, place IS NOT NULL AS has_copyright, CAST(length(CASE WHEN place IS NULL THEN text ELSE substr(text, 1, strpos(text, marker) - 1) END) AS BIGINT) AS kept_chars
FROM x LEFT JOIN f USING (id) LEFT JOIN m USING (place)""")
def boilerplate_cut(spark, d):
    x = COPYRIGHT.frame(spark).union(read(spark, d, "documents").select(F.col("doc_id") + 1000, "text")).select("id", t.text_of("text").alias("text"))
    return x.select("id", t.has_copyright(F.col("text")).alias("has_copyright"), t.long_length(t.cut_boilerplate(F.col("text"))).alias("kept_chars"))


STRINGS = Literal(
    "strings", "id long, s string",
    (1, "beforeWord and lowerCase"), (2, "19391945 was long"), (3, "The IDG met 67 December"), (4, "Mixed  spaces\there"), (5, "Größe & Maß 3.pdf"), (6, "x = y + 2 ∑ α"), (7, "v1.10.2"), (8, "98-9"), (9, "IMG_001.png"), (10, "{fig:1} and {table:22} {not}"), (11, "[^a] text [^b]\n[^a]: note"), (12, ""), (13, "2.0"), (14, "image"), (15, "1. Chapter “One” ....."),
)


@query(with_tables(STRINGS) + r"""SELECT id,
  regexp_replace(regexp_replace(s, '([a-z])([A-Z][a-z])', '\1-\2', 'g'), '\b(\d{4})(\d{4})\b', '\1-\2', 'g') AS hyphened,
  replace(replace(replace(s, 'IDG', 'IDF'), '19487', '1948'), '67 December', '6-7 December') AS corrected,
  concat_ws('|', CASE WHEN contains(s, 'IDG') THEN 'IDG>IDF' END, CASE WHEN contains(s, '19487') THEN '19487>1948' END, CASE WHEN contains(s, '67 December') THEN '67 December>6-7 December' END) AS found,
  CASE WHEN trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'book' ELSE trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
  CAST(len(regexp_extract_all(s, '\{\w+:\d+\}')) AS BIGINT) AS markers, CAST(len(regexp_extract_all(s, '\[\^[^\]\s]+\]')) AS BIGINT) AS note_marks,
  CAST(len(regexp_extract_all(s, '(?m)^\s*\[\^[^\]\s]+\]:')) AS BIGINT) AS note_definitions, CAST(len(regexp_extract_all(s, '[∀-⋿Α-ω℀-⅏=+<>±×÷√]')) AS BIGINT) AS math_chars,
  CAST(CASE WHEN s = '98-9' THEN 99 END AS BIGINT) AS range_end,
  trim(s) <> '' AND NOT contains(trim(s), ' ') AND NOT regexp_full_match(trim(s), '\d+([.-]\d+)*\.?') AND (regexp_matches(lower(trim(s)), '\.(png|jpg|jpeg|gif|svg|tif|tiff|bmp|webp)$') OR (regexp_full_match(trim(s), '[A-Za-z0-9._-]+') AND regexp_matches(s, '[0-9]'))) AS file_caption, regexp_full_match(lower(trim(s)), '(image|img|figure|fig|picture|photo|graphic|icon|illustration|插图|图片|圖片|图像|圖像|图|未命名|待补|待定|todo|tbd|na|n/a|xxx+)\.?') AS placeholder_caption,
  array_to_string(list_reverse(string_split_regex(regexp_replace(s, '^\s+|\s+$', '', 'g'), '\s+')), ' ') AS reversed,
  regexp_replace(lower(s), '[^\p{L}\p{N}]+', '', 'g') AS title_key
FROM strings""")
def text_functions(spark, d):
    s = F.col("s")
    return STRINGS.frame(spark).select(
        "id", t.with_hyphens(s).alias("hyphened"), t.corrected(s).alias("corrected"), t.corrections_in(s).alias("found"), t.slug(s).alias("slug"), t.markers(s).alias("markers"), t.note_marks(s).alias("note_marks"),
        t.note_definitions(s).alias("note_definitions"), t.math_chars(s).alias("math_chars"), F.when(s.rlike(r"^\d+\s*[-–—]\s*\d+$"), t.range_end(s)).alias("range_end"), t.caption_is_filename(s).alias("file_caption"),
        t.caption_is_placeholder(s).alias("placeholder_caption"), t.reversed_words(s).alias("reversed"), t.title_key(s).alias("title_key"),
    )


# fidelity: benchmark passages against documents; both ways with white space deleted
@query(f"""WITH p AS (SELECT item_id, {NOSPACE.format("coalesce(text, '')")} AS body FROM benchmark), w AS (SELECT doc_id, {NOSPACE.format("coalesce(text, '')")} AS whole FROM documents)
SELECT item_id, count(doc_id) AS n_documents, min(doc_id) AS first_document FROM p LEFT JOIN w ON contains(whole, body) GROUP BY item_id""")
def fidelity_forward(spark, d):
    """Passages and the documents that hold them, white space apart: ``passages`` finds them by their rarest windows. The empty passage lies in every document."""
    p = read(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), t.without_blanks(t.text_of("text")).alias("passage"))
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), t.without_blanks(t.text_of("text")).alias("whole"))
    found = passages.held_passages(p, docs).groupBy("item_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first"))
    every, first = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    empty = p.where("passage = ''").groupBy("item_id").agg((F.count("*") * every).alias("n"), F.lit(first).cast("long").alias("first"))
    found = found.unionByName(empty).groupBy("item_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    items = p.select("item_id").distinct().join(found.withColumnRenamed("item_id", "found_id"), F.col("item_id").eqNullSafe(F.col("found_id")), "left")
    return items.select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.col("first").alias("first_document"))


@query(f"""WITH {LINES}, w AS (SELECT work, unit, {NOSPACE.format('text')} AS whole FROM units), x AS (SELECT l.unit, l.line, contains(whole, {NOSPACE.format('l.text')}) AS inside FROM lines l JOIN w USING (unit))
SELECT unit, count(*) AS n_lines, count_if(inside) AS n_inside, count_if(NOT inside) AS n_lost FROM x GROUP BY unit""")
def fidelity_reverse(spark, d):
    """Every line of a unit against the unit's whole text."""
    found = align.contained(lines(spark, d).select("unit", "line", F.col("text").alias("body")), units(spark, d).select("unit", F.col("text").alias("whole")), "unit")
    return found.groupBy("unit").agg(F.count("*").alias("n_lines"), F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_lost"))


@query(rf"""WITH {LINES}, a AS (SELECT unit, string_agg({NOSPACE.format('text')}, '' ORDER BY line) AS joined FROM lines GROUP BY unit), b AS (SELECT unit, {NOSPACE.format('text')} AS body FROM units)
SELECT unit, joined IS NOT DISTINCT FROM body AS same, CAST(length(coalesce(joined, '')) AS BIGINT) AS left_chars, CAST(length(body) AS BIGINT) AS right_chars FROM b LEFT JOIN a USING (unit)""")
def doc_drift(spark, d):
    """Is a unit's text what its lines make up, in order?"""
    a = lines(spark, d).select("unit", "line", t.without_blanks(F.col("text")).alias("body")).groupBy("unit").agg(align.in_order("body", "line").alias("joined"))
    b = units(spark, d).select("unit", t.without_blanks(F.col("text")).alias("body"))
    return b.join(a, "unit", "left").select("unit", F.col("joined").eqNullSafe(F.col("body")).alias("same"), t.long_length(F.coalesce("joined", F.lit(""))).alias("left_chars"), t.long_length(F.col("body")).alias("right_chars"))


SPANS = rf"""{UNITS}, {SENTENCES}, rows AS (SELECT unit, unnest(range(1, len(s) + 1)) AS seq, unnest(s) AS tgt FROM trimmed),
split_lines AS (SELECT unit, unnest(range(1, len(l) + 1)) AS block, unnest(l) AS raw FROM (SELECT unit, string_split(text, chr(10)) AS l FROM units)),
b0 AS (SELECT unit, block, {NOSPACE.format('raw')} AS body FROM split_lines), b1 AS (SELECT *, sum(length(body)) OVER (PARTITION BY unit ORDER BY block) AS stop FROM b0 WHERE body <> ''),
r0 AS (SELECT unit, seq, {NOSPACE.format('tgt')} AS part FROM rows), r1 AS (SELECT *, sum(length(part)) OVER (PARTITION BY unit ORDER BY seq) AS r_stop FROM r0 WHERE part <> ''),
m AS (SELECT b1.unit, block, body, min(seq) AS seq_start, max(seq) AS seq_end, string_agg(part, '' ORDER BY seq) AS joined FROM b1 LEFT JOIN r1 ON b1.unit = r1.unit AND r_stop - length(part) >= stop - length(body) AND r_stop <= stop GROUP BY ALL),
f AS (SELECT *, coalesce(joined = body, false) AS fits FROM m), g AS (SELECT *, min(CASE WHEN NOT fits THEN block END) OVER (PARTITION BY unit) AS bad FROM f),
spans AS (SELECT unit, block, coalesce(block < bad, true) AS ok, CASE WHEN coalesce(block < bad, true) THEN seq_start END AS seq_start, CASE WHEN coalesce(block < bad, true) THEN seq_end END AS seq_end, sha256(body) AS text_sha256 FROM g)"""


def spans_of_lines(spark, d):
    blocks = units(spark, d).select("unit", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("unit", (F.col("at") + 1).cast("long").alias("block"), "text")
    return align.block_spans(blocks, sentence_split(spark, d).withColumnRenamed("sentence", "tgt"))


@query(f"WITH {SPANS} SELECT * FROM spans")
def block_spans(spark, d):
    return spans_of_lines(spark, d)


@query(f"""WITH {SPANS} SELECT unit, sha256(string_agg(concat_ws(':', block, seq_start, seq_end, text_sha256), chr(10) ORDER BY block)) AS digest FROM spans WHERE ok GROUP BY unit""")
def structure_digest(spark, d):
    return align.span_digest(spans_of_lines(spark, d), with_text=True)


@query(f"""WITH {SPANS} SELECT unit, sha256(string_agg(concat_ws(':', block, seq_start, seq_end), chr(10) ORDER BY block)) AS digest FROM spans WHERE ok GROUP BY unit""")
def boundary_digest(spark, d):
    return align.span_digest(spans_of_lines(spark, d), with_text=False)


SIDE_SPANS = Literal(
    "side_spans", "side string, unit string, block long, seq_start long, seq_end long, ok boolean",
    ("s", "a", 1, 1, 2, True), ("s", "a", 2, 3, 3, True), ("s", "a", 3, 4, 6, True), ("s", "b", 1, 1, 1, True),
    ("t", "a", 1, 1, 2, True), ("t", "a", 2, 3, 4, True), ("t", "a", 3, 5, 5, True), ("t", "a", 4, 9, 9, True), ("t", "a", 5, None, None, False), ("t", "b", 1, 1, 1, True),
).also(
    "SELECT CASE WHEN turn % 2 = 0 THEN 's' ELSE 't' END, concat('c', conv_id), CAST(floor(turn / 2) AS BIGINT), CASE WHEN turn % 2 = 0 THEN turn * 3 + 1 ELSE turn * 2 + conv_id % 3 END, CASE WHEN turn % 2 = 0 THEN turn * 3 + 2 + conv_id % 4 ELSE turn * 2 + 2 + conv_id % 2 END, turn < 5 OR conv_id % 2 = 0 FROM {conversations}"
)


@query(with_tables(SIDE_SPANS) + """, s AS (SELECT * FROM side_spans WHERE side = 's' AND ok), t AS (SELECT * FROM side_spans WHERE side = 't'),
m AS (SELECT t.unit, t.block, s.block AS s_block FROM t JOIN s ON t.unit = s.unit AND t.ok AND t.seq_start <= s.seq_end AND s.seq_start <= t.seq_end),
n AS (SELECT *, count(*) OVER (PARTITION BY unit, s_block) AS targets FROM m), c AS (SELECT unit, block, count(*) AS n_source, max(targets) AS targets FROM n GROUP BY ALL)
SELECT t.unit, t.block, coalesce(n_source, 0) AS n_source, CASE WHEN NOT ok THEN 'propose' WHEN n_source IS NULL THEN 'unmatched' WHEN n_source > 1 THEN 'merge' WHEN targets > 1 THEN 'split' ELSE 'exact' END AS status FROM t LEFT JOIN c USING (unit, block)""")
def align_proposal(spark, d):
    both = SIDE_SPANS.frame(spark, d)
    return align.proposal(both.where("side = 's'").drop("side"), both.where("side = 't'").drop("side"))


@query(rf"""WITH {UNITS}, b AS (SELECT unit, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\n+|\n+$', '', 'g')), lambda x: {STRIP.format('x')} <> '') AS l FROM units WHERE NOT regexp_matches(text, '(?m)^ {{0,3}}(```|~~~)|^#{{1,6}}[ \t]'))
SELECT unit, unnest(range(1, len(l) + 1)) AS block, sha256(unnest(l)) AS digest FROM b""")
def rendered_blocks(spark, d):
    """Blocks as they are rendered, of the documents without fences and headings; those are worked by hand in the tests."""
    own = units(spark, d).where(~F.col("text").rlike(r"(?m)^ {0,3}(```|~~~)|^#{1,6}[ \t]"))
    return own.select("unit", F.posexplode(udfs.render_blocks(F.col("text"))).alias("at", "b")).select("unit", (F.col("at") + 1).cast("long").alias("block"), F.sha2(F.col("b").cast("binary"), 256).alias("digest"))


@query(f"WITH {FACTS} SELECT work, '# ' || work || chr(10) || chr(10) || '- units: ' || count(*) || ', chars: ' || sum(chars)::BIGINT || ', words: ' || sum(words)::BIGINT || ', sentences: ' || sum(sentences)::BIGINT || chr(10) || chr(10) || '| unit | chars | words | paragraphs | sentences |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || unit || ' | ' || chars || ' | ' || words || ' | ' || paragraphs || ' | ' || sentences || ' |', chr(10) ORDER BY unit) || chr(10) AS md FROM facts GROUP BY work")
def facts_report(spark, d):
    return sinks.facts_report(facts(spark, d))


FENCED = Literal("fenced", "id long, a string, b string, c string", (1, "alpha", "beta", "gamma"))
FENCED.also("SELECT 100 + p_partkey, concat(p_name, ' one'), concat(p_type, ' ', p_size), concat('see ', p_name) FROM {part}")


@query(with_tables(FENCED) + " SELECT id, 0 AS place, 'text' AS kind, a AS chunk FROM fenced UNION ALL SELECT id, 1, CASE WHEN id % 2 = 0 THEN 'raw' ELSE 'code' END, CASE WHEN id % 2 = 0 THEN '~~~~ {=html}' ELSE '```' END || chr(10) || b || chr(10) || CASE WHEN id % 2 = 0 THEN '~~~' || chr(10) || '~~~~' ELSE '```' END FROM fenced UNION ALL SELECT id, 2, 'text', c FROM fenced")
def markdown_chunks(spark, d):
    """Texts built around a fence: code, or raw markup with a shorter fence inside."""
    even = F.col("id") % 2 == 0
    opens, closes = F.when(even, "~~~~ {=html}").otherwise("```"), F.when(even, "~~~\n~~~~").otherwise("```")
    x = FENCED.frame(spark, d).select("id", F.concat_ws("\n", "a", opens, "b", closes, "c").alias("md"))
    return x.select("id", F.posexplode(udfs.chunks(F.col("md"))).alias("place", "x")).select("id", "place", "x.kind", "x.chunk")


@query(with_tables(FENCED) + " SELECT id, 0 AS place, 'text' AS kind, a AS block FROM fenced UNION ALL SELECT id, 1, 'text', c FROM fenced UNION ALL SELECT id, 2, 'code', '```' || chr(10) || b || chr(10) || chr(10) || c || chr(10) || '```' FROM fenced UNION ALL SELECT id, 3, 'text', b || chr(10) || a FROM fenced")
def content_blocks(spark, d):
    """Headings and lone comments part blocks and are none; a fence is a block with its blank lines."""
    lines = F.concat_ws("\n", F.lit("# Head"), "a", F.lit("## Next"), F.lit(""), "c", F.lit("\n<!-- a comment\nof two lines -->\n"), F.lit("```"), "b", F.lit(""), "c", F.lit("```"), "b", "a")
    x = FENCED.frame(spark, d).select("id", lines.alias("md"))
    return x.select("id", F.posexplode(udfs.blocks(F.col("md"))).alias("place", "x")).select("id", "place", "x.kind", "x.block")


@query("SELECT p_partkey AS id, '| ' || p_partkey || ' | ' || p_name || '\\|' || p_brand || ' |  | ' || p_type || ' |' AS line FROM part")
def markdown_rows(spark, d):
    cells = F.array(F.col("p_partkey").cast("string"), F.concat_ws("|", "p_name", "p_brand"), F.lit(None).cast("string"), F.col("p_type"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), t.markdown_row(cells).alias("line"))
