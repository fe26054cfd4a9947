"""Queries over text hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import hygiene as h
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.sources.adapters import LINES, lines, units

BLOCKS = Literal(
    "blocks", "unit string, block long, text string",
    ("a", 1, "He said “come here, and the the dog came"), ("a", 2, "and went on without an end"), ("a", 3, "A list follows:"), ("a", 4, "- item one"), ("a", 5, "It ended.”"), ("a", 6, "She left the House house early,"),
    ("b", 1, "「你好，世界 hello NATO (gloss) 。"), ("b", 2, "中文里留下 word 和 Another 词 epub"), ("b", 3, "x" * 1300 + "."), ("b", 4, 'An "open quote runs —'), ("b", 5, "New Paragraph starts"), ("c", 1, "Balanced “inside” fine."),
    ("e", 1, "One clause; and another;"), ("e", 2, "It cites Smith et al., vol."), ("e", 3, "Ends with the"), ("e", 4, "Capital starts [bracketed]"), ("e", 5, "重复重复的词 left-over state's abc"), ("e", 6, 'An odd " mark.'), ("e", 7, "(open bracket"), ("e", 8, "’"),
)


def spark_blocks(spark, d):
    """Literal blocks and the lines of all documents."""
    own = lines(spark, d).select(F.concat(F.lit("d"), F.col("unit").cast("string")).alias("unit"), F.col("line").alias("block"), "text")
    return BLOCKS.frame(spark).union(own)


ALL = with_tables(BLOCKS) + f", {LINES}, x AS (SELECT * FROM blocks UNION ALL SELECT 'd' || unit, line, text FROM lines)"

SIGNALS = Literal(
    "signal_texts", "unit string, text string",
    ("a", "One line\nwithout end\nlast.\n\nSecond hyphen-\nated para!\nOk."), ("b", "# Heading\nnot prose\n\n- a\n- b\n\n> q\n> r\n\n|a|\n|b|\n\n![x](y.png)"), ("c", "Same para.\n\nSame para.\n\nSame para.\n\nOther"),
    ("d", "中文,混用。“x”字\"引\n\nbroken � text â€ more"), ("e", "averyveryverylongunbrokenlatinrun end"), ("f", ""), ("g", "\n\n"),
)


@query(with_tables(SIGNALS) + r""", b AS (SELECT unit, text, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS block FROM (SELECT unit, text, string_split_regex(regexp_replace(text, '^\n+|\n+$', '', 'g'), '\n\s*\n') AS p FROM signal_texts)),
l AS (SELECT unit, k, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls FROM b), n AS (SELECT *, list_transform(ls, lambda x: trim(x)) AS st FROM l WHERE len(ls) > 0),
p AS (SELECT * FROM n WHERE NOT (starts_with(st[1], '#') OR list_bool_and(list_transform(st, lambda x: regexp_matches(x, '^(?:[-*+]|\d+[.)])\s+'))) OR list_bool_and(list_transform(st, lambda x: starts_with(x, '>'))) OR list_bool_and(list_transform(st, lambda x: starts_with(x, '|'))) OR (len(st) = 1 AND regexp_matches(st[1], '^!\[[^\]]*\]\([^)]*\)$')))),
c AS (SELECT unit, sum(len(list_filter(ls[:-2], lambda x: NOT regexp_matches(rtrim(x), '[。！？；…!?;]$')))) AS w, sum(len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[A-Za-z]-$')))) AS h, count(*) - count(DISTINCT array_to_string(st, '')) AS dup FROM p GROUP BY unit)
SELECT t.unit, CAST(coalesce(w, 0) AS BIGINT) AS hard_wrap_lines, CAST(coalesce(h, 0) AS BIGINT) AS hyphen_eol, coalesce(dup, 0) AS duplicate_paras, CAST(len(regexp_extract_all(text, '""" + h.GARBLED + r"""')) AS BIGINT) AS garbled_marks,
  CAST(len(regexp_extract_all(text, '[一-鿿]["'',.;:!?]|["'',.;:!?][一-鿿]')) AS BIGINT) AS ascii_punct_cjk, CAST(len(regexp_extract_all(text, '[A-Za-z]{20,}')) AS BIGINT) AS long_latin_run FROM signal_texts t LEFT JOIN c USING (unit)""")
def repair_signals(spark, d):
    return h.repair_signals(SIGNALS.frame(spark))


def repair_signals_documents(spark, d):
    return h.repair_signals(units(spark, d).select(F.col("unit").cast("string").alias("unit"), "text"))


query(r"""WITH u AS (SELECT doc_id::VARCHAR AS unit, coalesce(text, '') AS text, list_filter(string_split(regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g'), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
p AS (SELECT *, len(ls) > 0 AND NOT (starts_with(trim(ls[1]), '#') OR list_bool_and(list_transform(ls, lambda x: regexp_matches(trim(x), '^(?:[-*+]|\d+[.)])\s+'))) OR list_bool_and(list_transform(ls, lambda x: starts_with(trim(x), '>'))) OR list_bool_and(list_transform(ls, lambda x: starts_with(trim(x), '|')))) AS prose FROM u)
SELECT unit, CAST(CASE WHEN prose THEN len(list_filter(ls[:-2], lambda x: NOT regexp_matches(rtrim(x), '[。！？；…!?;]$'))) ELSE 0 END AS BIGINT) AS hard_wrap_lines, CAST(CASE WHEN prose THEN len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[A-Za-z]-$'))) ELSE 0 END AS BIGINT) AS hyphen_eol,
  0::BIGINT AS duplicate_paras, CAST(len(regexp_extract_all(text, '""" + h.GARBLED + r"""')) AS BIGINT) AS garbled_marks, CAST(len(regexp_extract_all(text, '[一-鿿]["'',.;:!?]|["'',.;:!?][一-鿿]')) AS BIGINT) AS ascii_punct_cjk, CAST(len(regexp_extract_all(text, '[A-Za-z]{20,}')) AS BIGINT) AS long_latin_run FROM p""")(repair_signals_documents)


DUPLICATES = r"""w AS (SELECT unit, block, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok FROM (SELECT unit, block, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM x)),
p AS (SELECT *, lead(tok, 1) OVER o AS gap, lead(tok, 2) OVER o AS nxt FROM w WINDOW o AS (PARTITION BY unit, block ORDER BY i)),
m AS (SELECT unit, block, i, tok FROM p WHERE tok = nxt AND regexp_full_match(gap, '\s+') AND regexp_full_match(tok, '[a-z]{2,}')),
g AS (SELECT unit, block, i, tok, i - 2 * row_number() OVER (PARTITION BY unit, block, tok ORDER BY i) AS isl FROM m), r AS (SELECT unit, block, tok, isl, count(*) + 1 AS run FROM g GROUP BY ALL),
han AS (SELECT unit, block, unnest(range(1, length(text) + 1)) AS i, text FROM x WHERE regexp_matches(text, '[一-鿿]{4}')),
pairs AS (SELECT unit, block, i, k, substr(text, i, k) AS word FROM han, (VALUES (4), (3), (2)) AS n(k) WHERE substr(text, i, k) = substr(text, i + k, k) AND regexp_full_match(substr(text, i, k), '[一-鿿]+')),
duplicates AS (SELECT unit, block, tok AS word, CAST(sum(run // 2) AS BIGINT) AS n FROM r GROUP BY ALL UNION ALL SELECT unit, block, arg_max(word, k) AS word, 1 FROM pairs GROUP BY unit, block)"""


@query(ALL + ", " + DUPLICATES + " SELECT * FROM duplicates")
def hygiene_duplicate_words(spark, d):
    """No literal block has two doubled groups of ideographs, so that the SQL may take the longest one at a place."""
    return h.duplicate_words(spark_blocks(spark, d))


QUOTES = ", ".join(f"('{a}', '{b}')" for a, b in h.PAIRS)


@query(ALL + f""", q(a, b) AS (VALUES {QUOTES}), e AS (SELECT unit, block, a || b AS pair, length(text) - length(replace(text, a, '')) AS o, length(text) - length(replace(text, b, '')) AS c FROM x, q),
s AS (SELECT *, sum(o - c) OVER (PARTITION BY unit, pair) AS bal FROM e WHERE o > 0 OR c > 0), k AS (SELECT unit, block, length(text) - length(replace(text, '"', '')) AS n FROM x), z AS (SELECT *, sum(n) OVER (PARTITION BY unit) AS total FROM k)
SELECT unit, block, pair, CAST(o AS BIGINT) AS open, CAST(c AS BIGINT) AS close FROM s WHERE bal <> 0 AND o <> c UNION ALL SELECT unit, block, '""', 1, 0 FROM z WHERE total % 2 = 1 AND n % 2 = 1""")
def hygiene_quotes(spark, d):
    return h.unbalanced_quotes(spark_blocks(spark, d))


ENDS = h.TERMINAL + h.CLOSERS
OPEN = " + ".join(f"greatest(0, (length(text) - length(replace(text, '{a}', ''))) - (length(text) - length(replace(text, '{b}', ''))))" for a, b in h.PAIRS)


@query(ALL + rf""", r AS (SELECT unit, block, regexp_replace(text, '[\s\p{{Z}}]+$', '') AS text, lead(text) OVER (PARTITION BY unit ORDER BY block) AS next FROM x), n AS (SELECT *, right(text, 1) AS tail FROM r WHERE text <> ''),
f AS (SELECT *, NOT contains('{ENDS}', tail) AND NOT (tail IN (':', '：') AND next IS NOT NULL) AND NOT regexp_matches(text, '^\s*(?:[-*+]|\d+[.)])\s') AS half, coalesce(regexp_matches(next, '{h.CONTINUES}'), false) AS goes,
  {OPEN} + (length(text) - length(replace(text, '"', ''))) % 2 AS depth FROM n)
SELECT unit, block, 'long_paragraph' AS code FROM f WHERE length(text) >= 1200 UNION ALL SELECT unit, block, 'cross_page_fragment' FROM f WHERE half AND goes UNION ALL SELECT unit, block, 'half_sentence' FROM f WHERE half AND NOT goes AND NOT regexp_matches(text, '{h.ABBREVIATED}')
UNION ALL SELECT unit, block, 'tail_loss' FROM f WHERE half AND NOT goes AND regexp_matches(text, '{h.TAIL}')
UNION ALL SELECT unit, block, 'quote_tail_dropped' FROM f WHERE half AND depth > 0 AND contains('，,、—–-:：', tail)""")
def hygiene_tails(spark, d):
    return h.tail_findings(spark_blocks(spark, d))


@query(ALL + r""", p AS (SELECT unit, block, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[（(][^）)]*[）)]', '', 'g'), '《[^》]*》|“[^”]*”|『[^』]*』', '', 'g'), '[A-Za-z][A-Za-z''-]{3,}')) AS word FROM x WHERE regexp_matches(text, '[一-鿿]'))
SELECT unit, block, word FROM p WHERE lower(word) NOT IN (""" + ", ".join(f"'{w}'" for w in h.LATIN_IN_PROSE) + r""") AND NOT (upper(word) = word AND length(word) <= 6)""")
def hygiene_untranslated(spark, d):
    return h.untranslated_words(spark_blocks(spark, d))


@query(ALL + rf""", r AS (SELECT unit, block, regexp_replace(text, '[\s\p{{Z}}]+$', '') AS text FROM x), c AS (SELECT unit, count(*) AS blocks, count_if(length(text) >= 1200) AS long_blocks, count_if(NOT contains('{ENDS}', right(text, 1))) AS open_ends FROM r GROUP BY unit)
SELECT count(*) AS units, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(long_blocks) AS BIGINT) AS long_blocks, CAST(sum(open_ends) AS BIGINT) AS open_ends, count_if(open_ends > 0) AS units_with_open_ends FROM c""")
def hygiene_summary(spark, d):
    x = spark_blocks(spark, d).select("unit", t.right_stripped(F.col("text")).alias("text"))
    c = x.groupBy("unit").agg(F.count("*").alias("blocks"), F.count_if(F.char_length("text") >= 1200).alias("long_blocks"), F.count_if(~F.right("text", F.lit(1)).isin(*(h.TERMINAL + h.CLOSERS))).alias("open_ends"))
    return c.agg(F.count("*").alias("units"), F.sum("blocks").alias("blocks"), F.sum("long_blocks").alias("long_blocks"), F.sum("open_ends").alias("open_ends"), F.count_if(F.col("open_ends") > 0).alias("units_with_open_ends"))
