"""The audit of provenance over works made from the documents' ids, with faults put in by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import provenance as p
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.session import written

#: rn counts a work's units; a unit that moves goes before all others, those of a work in falling order, so that the rest is the longest rising run.
NUMBERED = "(SELECT source AS work, doc_id AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM {documents})"
NL2 = "concat(chr(10), chr(10))"
LEFT, RIGHT = "concat('![](m', k % 5, '.png)')", "concat('![](n', k % 3, '.png)')"
PLACED = Literal("p_numbers", "work string, k long, rn long").also(f"SELECT work, k, rn FROM {NUMBERED}")
UNITS = Literal("p_units2", "work string, unit string, pos long, kind string, source_md string, target_md string").also(
    f"""SELECT work, concat('u', k), rn, CASE WHEN rn = 1 THEN 'cover' ELSE 'chapter' END, CASE WHEN k % 37 = 11 THEN NULL WHEN k % 29 = 3 THEN ' ' ELSE concat('# Title ', k, {NL2}, 'First paragraph of ', k, {NL2}, {LEFT}, {NL2}, {RIGHT}, {NL2}, 'Second **strong** paragraph ', k * 7, ' ends.') END,
    CASE WHEN k % 4 = 3 OR k % 29 = 3 THEN NULL ELSE concat('# Titel ', k, {NL2}, 'Absatz *eins* zu ', k, {NL2}, CASE WHEN k % 9 = 1 THEN {LEFT} WHEN k % 9 = 2 THEN concat({RIGHT}, {NL2}, {LEFT}) ELSE concat({LEFT}, {NL2}, {RIGHT}) END, {NL2}, 'Absatz zwei ', k * 7, CASE WHEN k % 6 = 0 THEN concat('[^1] mit Note.', {NL2}, '[^1]: die Note') ELSE ' endet.' END) END FROM {NUMBERED}"""
)
SPINE = Literal("p_spine2", "work string, unit string, place long").also(f"SELECT work, concat('u', k), CASE WHEN rn > 10 AND rn % 17 = 5 THEN -rn ELSE rn END FROM {NUMBERED} WHERE k % 19 <> 7 AND k % 37 <> 11 AND k % 29 <> 3 UNION ALL SELECT work, concat('x', k), 1000000 + rn FROM {NUMBERED} WHERE k % 41 = 9")
ROWS = Literal("p_rows2", "work string, unit string, pos long, tgt string").also(
    f"""SELECT work, concat('u', k), 1, concat('Absatz *eins* zu ', k) FROM {NUMBERED} WHERE k % 4 <> 3 AND k % 29 <> 3 UNION ALL SELECT work, concat('u', k), 2, CASE WHEN k % 15 = 4 THEN concat('anders ', k) ELSE concat('Absatz zwei ', k * 7, CASE WHEN k % 6 = 0 THEN '[^1] mit Note.' ELSE ' endet.' END) END FROM {NUMBERED} WHERE k % 4 <> 3 AND k % 29 <> 3"""
)
DEPTHS = Literal("p_depths", "work string, place long, depth long").also(f"SELECT work, rn, 1 + rn % 2 FROM {NUMBERED} WHERE rn < 7")
NAV = Literal("p_nav2", "work string, place long, depth long").also(f"SELECT work, rn, CASE length(work) % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 + rn % 2 ELSE CASE WHEN rn = 3 THEN 1 ELSE 1 + rn % 2 END END FROM {NUMBERED} WHERE rn < 7")
COVERS = Literal("p_covers", "work string").also(f"SELECT DISTINCT work FROM {NUMBERED} WHERE k % 50 = 1")
INSERTS = Literal("p_inserts", "work string, id string, missing boolean, page long, bbox array<long>, content_desc string, type string, latex string").also(
    f"SELECT work, concat('i', k), k % 13 = 2, CASE WHEN k % 7 = 1 THEN 0 ELSE k + 1 END, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 4 THEN {{list}}(1, 2) ELSE {{list}}(1, 2, 3, k) END, CASE WHEN k % 3 = 0 THEN ' ' ELSE 'd' END, CASE WHEN k % 2 = 0 THEN 'formula' ELSE 'table' END, CASE WHEN k % 8 = 0 THEN '' ELSE 'x^2' END FROM {NUMBERED}"
)

#: The faults as they were put in; what a unit shows depends on whether it has a target.
RULES = """, u AS (SELECT *, concat('u', k) AS unit, k % 4 <> 3 AS translated FROM p_numbers), e AS (SELECT * FROM u WHERE k % 37 <> 11 AND k % 29 <> 3),
d AS (SELECT * FROM e WHERE k % 19 <> 7), t AS (SELECT * FROM e WHERE translated),
steady AS (SELECT * FROM d WHERE NOT (rn > 10 AND rn % 17 = 5)), lined AS (SELECT work, string_agg(CAST(depth AS VARCHAR), ',' ORDER BY place) AS want FROM p_depths GROUP BY work), shown AS (SELECT work, string_agg(CAST(depth AS VARCHAR), ',' ORDER BY place) AS have, max(depth) AS deep FROM p_nav2 GROUP BY work), asked AS (SELECT work, max(depth) AS deep FROM p_depths GROUP BY work),
findings AS (
  SELECT work, 'W_STRUCT_MISSING' AS code, unit, '' AS detail FROM u WHERE k % 37 = 11
  UNION ALL SELECT DISTINCT work, 'W_NO_COVER', NULL, '' FROM e WHERE rn = 1 AND work NOT IN (SELECT work FROM p_covers)
  UNION ALL SELECT work, 'E_UNIT_MISSING', unit, '' FROM e WHERE k % 19 = 7
  UNION ALL SELECT work, 'E_UNIT_ORDER', unit, 'unknown' FROM p_spine2 WHERE starts_with(unit, 'x')
  UNION ALL SELECT work, 'E_UNIT_ORDER', unit, 'moved' FROM d WHERE rn > 10 AND rn % 17 = 5
  UNION ALL SELECT work, 'E_MEDIA_LOST', unit, concat('n', k % 3, '.png') FROM t WHERE k % 9 = 1
  UNION ALL SELECT work, 'E_MEDIA_ORDER', unit, concat('m', k % 5, '.png') FROM t WHERE k % 9 = 2
  UNION ALL SELECT work, 'E_MEDIA_EPUB_LOST', unit, concat('m', k % 5, '.png') FROM d WHERE k % 14 = 5
  UNION ALL SELECT work, 'E_EPUB_PARA_LOST', unit, CASE WHEN translated THEN concat('Absatz zwei ', k * 7, CASE WHEN k % 6 = 0 THEN '[^1] mit Note.' ELSE ' endet.' END) ELSE left(concat('Second **strong** paragraph ', k * 7, ' ends.'), 40) END FROM d WHERE k % 10 = 3
  UNION ALL SELECT work, 'E_FN_EPUB_LOST', unit, '1/0' FROM d WHERE translated AND k % 12 = 6
  UNION ALL SELECT work, 'E_ALIGN_MD_DRIFT', unit, 'row 2' FROM t WHERE k % 15 = 4
  UNION ALL SELECT work, 'E_ALIGN_MD_DRIFT', unit, left(replace(concat('block|Absatzzwei', k * 7, CASE WHEN k % 6 = 0 THEN '[^1]mitNote.' ELSE 'endet.' END), '|', ' '), 30) FROM t WHERE k % 15 = 4
  UNION ALL SELECT a.work, 'E_TOC_FLAT', NULL, '' FROM asked a LEFT JOIN shown s USING (work) WHERE a.deep > 1 AND coalesce(s.deep, 1) = 1
  UNION ALL SELECT work, 'W_TOC_DEPTH', NULL, '' FROM lined JOIN shown USING (work) JOIN asked USING (work) WHERE NOT (asked.deep > 1 AND shown.deep = 1) AND want <> have
  UNION ALL SELECT work, 'E_INSERT_MISSING_FILE', NULL, id FROM p_inserts WHERE missing UNION ALL SELECT work, 'E_INSERT_BAD_SOURCE', NULL, id FROM p_inserts WHERE page < 1 OR len(bbox) <> 4
  UNION ALL SELECT work, 'W_INSERT_NO_DESC', NULL, id FROM p_inserts WHERE trim(content_desc) = '' UNION ALL SELECT work, 'W_INSERT_NO_LATEX', NULL, id FROM p_inserts WHERE type = 'formula' AND latex = '')"""


def frame(numbered, table):
    """A table made from the numbered documents as they were written, where its SQL numbers them anew each time."""
    spark = numbered.sparkSession
    made = spark.sql(table.derived.replace(NUMBERED, "{numbered}").replace("{list}", "array"), numbered=numbered).toDF(*[n for n, _ in table.fields])
    return made.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], table.schema).schema])


def documents(numbered):
    """work, unit, html of the units on the spine, as a builder would make them but for the faults."""
    k = F.col("k")
    u = numbered.where("k % 37 <> 11 and k % 29 <> 3 and k % 19 <> 7")
    translated = k % 4 != 3
    first = F.when(translated, F.concat(F.lit("<p>Absatz <em>eins</em> zu "), k, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>First paragraph of "), k, F.lit("</p>")))
    note = F.when(translated & (k % 6 == 0), F.concat(F.lit('<a epub:type="noteref" href="#n">1</a> mit Note.'))).otherwise(" endet.")
    second = F.when(k % 10 == 3, "").when(translated, F.concat(F.lit("<p>Absatz zwei "), k * 7, note, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>Second <strong>strong</strong> paragraph "), k * 7, F.lit(" ends.</p>")))
    left = F.when(k % 14 == 5, "").otherwise(F.concat(F.lit('<img src="m'), k % 5, F.lit('.png"/>')))
    right = F.when(translated & (k % 9 == 1), "").otherwise(F.concat(F.lit('<img src="n'), k % 3, F.lit('.png"/>')))
    aside = F.when(translated & (k % 12 == 0), '<aside epub:type="footnote" id="n">die Note</aside>').otherwise("")
    return u.select("work", F.concat(F.lit("u"), k).alias("unit"), F.concat(F.lit("<html><head><title>x</title></head><body>"), first, left, right, second, aside, F.lit("</body></html>")).alias("html"))


@query(with_tables(PLACED, UNITS, SPINE, ROWS, DEPTHS, NAV, COVERS, INSERTS) + RULES + " SELECT * FROM findings")
def provenance_audit(spark, d):
    """Every code over units, spine, documents, rows, contents and inserts of all works."""
    numbered = written(PLACED.frame(spark, d), "numbered")
    units, spine, rows, nav, depths, covers = (frame(numbered, x) for x in (UNITS, SPINE, ROWS, NAV, DEPTHS, COVERS))
    inserts = frame(numbered, INSERTS).withColumn("bbox", F.col("bbox").cast("array<double>"))
    return p.audited_provenance(units, spine, documents(numbered), rows, nav, depths, covers, inserts)
