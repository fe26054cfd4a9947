"""Canonical tables from the tables at hand: documents as units and lines, conversations as aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions.udfs import nfkc
from foliospark.session import in_small_batches, read


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, unit, text: a document is a unit of its source's work."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("unit"), t.text_of("text").alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, unit, line (from 1), text: the lines that aren't blank, trimmed."""
    split = units(spark, sf_dir).select("work", "unit", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.select("work", "unit", (F.col("line") + 1).cast("long").alias("line"), t.stripped(F.col("text")).alias("text")).where("text <> ''")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, seq, src, tgt: a user's turn and the assistant's next one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("tgt"))
    pairs = turns.where("role = 'user' and next_role = 'assistant'")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return pairs.select(F.col("conv_id").alias("unit"), seq.alias("seq"), F.coalesce("text", F.lit("")).alias("src"), F.coalesce("tgt", F.lit("")).alias("tgt"))


TABLE_MD = {2: "| a | b |\n|---|---|\n| 1 | 2 |\n\n", 3: "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n\n"}


def gate_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """rows, units, glossary, exemptions, styles, registered: aligned conversations with faults of every kind put in by number, so that each check of the gate has something to find."""
    in_small_batches(spark)
    at = (F.col("unit") * 7 + F.col("seq") * 3) % 13
    base = aligned(spark, sf_dir).select("unit", "seq", F.col("src").alias("s"), F.col("tgt").alias("t"), at.alias("m"))
    m, s, g = F.col("m"), F.col("s"), F.col("t")
    src = F.when(m == 2, F.concat(s, F.lit(" {fig:1}"))).when(m == 3, F.concat(s, F.lit(" Ended.12"))).when(m == 4, F.concat(s, F.lit(" Ended.13"))).when(m == 6, F.concat(s, F.lit(" (x)45"))).when(m == 9, F.concat(s, F.lit(" [^n1]"))).when(m == 10, "").otherwise(s)
    tgt = F.when(m == 0, s).when(m == 1, "").when(m == 4, F.concat(g, F.lit(" Ended.13"))).when(m == 5, "ok").when(m == 8, F.concat_ws(" ", g, g, g, g)).when((m == 9) & (F.col("unit") % 2 == 0), F.concat(g, F.lit(" [^n1]"))).otherwise(g)
    seq = F.when((m == 7) & (F.col("unit") % 3 == 0), F.col("seq") + 100).when((F.col("seq") == 2) & (F.col("unit") % 20 == 3), 1).otherwise(F.col("seq"))
    full = base.select("unit", F.col("seq").alias("pos"), seq.alias("seq"), src.alias("src"), tgt.alias("tgt"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("note_id"), "m", "s")
    rows = full.select("unit", "pos", "seq", "src", "tgt", "note_id")

    def body(column, keep=F.lit(True)):
        parts = F.array_sort(F.collect_list(F.when(keep, F.struct("pos", column))))
        return F.array_join(F.transform(parts, lambda x: x[column]), "\n\n")

    u = F.col("unit")
    docs = full.groupBy("unit").agg(body("src", F.col("m") != 11).alias("a"), body("tgt").alias("b"))
    shown = F.when(u % 8 == 0, F.lit(TABLE_MD[2])).otherwise("")
    source_md = F.concat(F.lit("# Unit "), u.cast("string"), F.lit("\n\n"), shown, F.col("a"), F.when(u % 5 == 1, F.lit("\n\nOne more block.")).otherwise(""))
    target_md = F.when(u % 7 != 6, F.concat(F.when(u % 6 == 0, "## ").otherwise("# "), F.lit("Titel\n\n"), F.when(u % 16 == 0, F.lit(TABLE_MD[3])).otherwise(shown), F.col("b")))
    units_ = docs.select("unit", F.when(u % 10 == 0, "toc").when(u % 10 == 1, "bibliography").when(u % 10 == 2, "index").otherwise("chapter").alias("kind"), source_md.alias("source_md"), target_md.alias("target_md"))
    bare = spark.range(4).select((F.col("id") + 10**9).alias("unit"), F.lit("chapter").alias("kind"), F.when(F.col("id") < 2, "# Only").otherwise("Text.").alias("source_md"), F.lit("# Nur").alias("target_md"))
    word = F.regexp_extract("s", "([A-Za-z]{5,})", 1)
    glossary = full.where((F.col("pos") == 1) & (u % 10 == 3)).select(u.alias("ord"), word.alias("source")).where("source <> ''")
    glossary = glossary.select("ord", "source", F.array().cast("array<string>").alias("aliases"), F.when(F.col("ord") % 20 == 3, F.col("source")).otherwise(F.upper("source")).alias("target"), F.lit("seed").alias("status"))
    first = glossary.join(full.where("pos = 1").select(u.alias("ord"), F.sha2(nfkc("src").cast("binary"), 256).alias("digest")), "ord").withColumn("k", F.col("ord") % 30)
    null = F.lit(None)
    free = first.select(F.col("ord").alias("unit"), "source", F.when(F.col("k") != 3, F.lit(1).cast("long")).alias("seq"), null.cast("string").alias("note_id"), F.when(F.col("k") == 13, F.col("digest")).when(F.col("k") == 23, "old").alias("text_sha256"), F.when(F.col("k") == 3, "whole").when(F.col("k") == 13, "placed").otherwise("stale").alias("reason"))
    by_note = first.where("ord % 60 = 13").select(F.col("ord").alias("unit"), "source", null.cast("long"), F.lit("n1"), null.cast("string"), F.lit("note"))
    styles = docs.where(u % 4 < 2).select("unit", F.lit(1).cast("long").alias("ord"), F.when(u % 4 == 0, "the").otherwise("").alias("pattern"), F.when(u % 4 == 0, "style").otherwise("whole").alias("reason"))
    registered = docs.select("unit", F.lit(45).cast("long").alias("number"), F.when(u % 2 == 0, "n1").alias("ref")).union(docs.select("unit", F.lit(12).cast("long"), null.cast("string")))
    return {"rows": rows, "units": units_.unionByName(bare), "glossary": glossary, "exemptions": free.union(by_note), "styles": styles, "registered": registered}


#: The same in SQL. A blank is what the text functions strip.
UNITS = "units AS (SELECT source AS work, doc_id AS unit, coalesce(text, '') AS text FROM documents)"
LINES = UNITS + r""",
split_lines AS (SELECT work, unit, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS raw FROM (SELECT work, unit, string_split(text, chr(10)) AS l FROM units)),
lines AS (SELECT * FROM (SELECT work, unit, line, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM split_lines) WHERE text <> '')"""
ALIGNED = """turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS tgt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
aligned AS (SELECT conv_id AS unit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, coalesce(text, '') AS src, coalesce(tgt, '') AS tgt
            FROM turns WHERE role = 'user' AND next_role = 'assistant')"""

GATE = ALIGNED + """, base AS (SELECT unit, seq AS pos, src AS s, tgt AS t, (unit * 7 + seq * 3) % 13 AS m FROM aligned),
rows_ AS (SELECT unit, pos, CASE WHEN m = 7 AND unit % 3 = 0 THEN pos + 100 WHEN pos = 2 AND unit % 20 = 3 THEN 1 ELSE pos END AS seq, m, s, 'n' || pos AS note_id,
  CASE m WHEN 2 THEN s || ' {fig:1}' WHEN 3 THEN s || ' Ended.12' WHEN 4 THEN s || ' Ended.13' WHEN 6 THEN s || ' (x)45' WHEN 9 THEN s || ' [^n1]' WHEN 10 THEN '' ELSE s END AS src,
  CASE WHEN m = 0 THEN s WHEN m = 1 THEN '' WHEN m = 4 THEN t || ' Ended.13' WHEN m = 5 THEN 'ok' WHEN m = 8 THEN t || ' ' || t || ' ' || t || ' ' || t WHEN m = 9 AND unit % 2 = 0 THEN t || ' [^n1]' ELSE t END AS tgt FROM base),
docs AS (SELECT unit, coalesce(string_agg(src, chr(10) || chr(10) ORDER BY pos) FILTER (m <> 11), '') AS a, string_agg(tgt, chr(10) || chr(10) ORDER BY pos) AS b FROM rows_ GROUP BY unit),
shown AS (SELECT *, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) AS two, '| a | b | c |' || chr(10) || '|---|---|---|' || chr(10) || '| 1 | 2 | 3 |' || chr(10) || chr(10) AS three FROM docs),
gate_units AS (SELECT unit, CASE unit % 10 WHEN 0 THEN 'toc' WHEN 1 THEN 'bibliography' WHEN 2 THEN 'index' ELSE 'chapter' END AS kind,
  '# Unit ' || unit || chr(10) || chr(10) || CASE WHEN unit % 8 = 0 THEN two ELSE '' END || a || CASE WHEN unit % 5 = 1 THEN chr(10) || chr(10) || 'One more block.' ELSE '' END AS source_md,
  CASE WHEN unit % 7 <> 6 THEN CASE WHEN unit % 6 = 0 THEN '## ' ELSE '# ' END || 'Titel' || chr(10) || chr(10) || CASE WHEN unit % 16 = 0 THEN three WHEN unit % 8 = 0 THEN two ELSE '' END || b END AS target_md FROM shown
  UNION ALL SELECT 1000000000 + i, 'chapter', CASE WHEN i < 2 THEN '# Only' ELSE 'Text.' END, '# Nur' FROM range(4) AS r(i)),
terms AS (SELECT unit AS ord, regexp_extract(s, '([A-Za-z]{5,})', 1) AS source FROM rows_ WHERE pos = 1 AND unit % 10 = 3),
glossary AS (SELECT ord, source, CASE WHEN ord % 20 = 3 THEN source ELSE upper(source) END AS target FROM terms WHERE source <> ''),
exemptions AS (SELECT ord AS unit, source, CASE WHEN ord % 30 <> 3 THEN 1 END AS seq, NULL AS note_id, CASE ord % 30 WHEN 13 THEN sha256(nfc_normalize(src)) WHEN 23 THEN 'old' END AS digest, CASE ord % 30 WHEN 3 THEN 'whole' WHEN 13 THEN 'placed' ELSE 'stale' END AS reason
  FROM glossary JOIN rows_ ON unit = ord AND pos = 1 UNION ALL SELECT ord, source, NULL, 'n1', NULL, 'note' FROM glossary WHERE ord % 60 = 13),
styles AS (SELECT unit, CASE unit % 4 WHEN 0 THEN 'the' ELSE '' END AS pattern, CASE unit % 4 WHEN 0 THEN 'style' ELSE 'whole' END AS reason FROM docs WHERE unit % 4 < 2),
registered AS (SELECT unit, 45 AS number, CASE WHEN unit % 2 = 0 THEN 'n1' END AS ref FROM docs UNION ALL SELECT unit, 12, NULL FROM docs)"""


def package_sql(pages: str, joined) -> str:
    """Packages made of pages, with faults put in by number, in SQL that both engines read alike; ``joined(x, by)`` joins strings in order."""
    extra = """CASE page_id % 12 WHEN 0 THEN '<img src="img/a.png" alt="">' WHEN 1 THEN '<img src="img/b.webp" alt="image"><img src="gone.png" alt="x y">' WHEN 2 THEN '<!-- note --><h2>a</h2><h4>b</h4>'
    WHEN 3 THEN '<p>text with **bold** left</p>' WHEN 4 THEN '<a href="#nowhere">x</a><a href="javascript:x()">y</a>' WHEN 5 THEN '<table><tr><td>## Cell</td></tr></table>' WHEN 6 THEN '<aside epub:type="footnote" id="f1">note</aside><p>[1] a note here</p>'
    WHEN 7 THEN '<aside epub:type="footnote" id="f2"><a epub:type="backlink" href="#b2">b</a></aside><p>中 文 字 字 中</p>' WHEN 8 THEN '<p>1. one note</p><p>2. two note</p>' WHEN 9 THEN '<img src="https://x.org/i.png" alt="scan_001.jpg"><p>共 3 人 和 12 字</p>'
    WHEN 10 THEN '<p>$$x$$ and 。.</p>' ELSE '' END"""
    return f"""made AS (SELECT page_id, CAST(page_id % 40 AS BIGINT) AS w, concat('c', page_id, '.xhtml') AS name, concat(html, {extra}) AS html FROM {pages} WHERE html IS NOT NULL),
listed AS (SELECT w, {joined("concat('<item id=\"i', page_id, '\" href=\"', name, '\"/>')", "page_id")} AS items, {joined("concat('<itemref idref=\"i', page_id, '\"/>')", "page_id")} AS refs,
  {joined("CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('<li><a href=\"', name, '\">x</a></li>') END", "page_id")} AS entries, {joined("concat('<content src=\"', name, '#a\"/>')", "page_id")} AS points FROM made GROUP BY w),
nine AS (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9),
package_members AS (
  SELECT concat('p', w) AS work, n AS ord,
    CASE n WHEN 1 THEN CASE WHEN w % 13 = 5 THEN 'first' ELSE 'mimetype' END WHEN 2 THEN 'META-INF/container.xml' WHEN 3 THEN 'OEBPS/p.opf' WHEN 4 THEN 'OEBPS/nav.xhtml' WHEN 5 THEN 'OEBPS/toc.ncx' WHEN 7 THEN 'OEBPS/img/a.png' WHEN 8 THEN 'OEBPS/img/b.webp' ELSE 'OEBPS/style.css' END AS path,
    n = 1 AND w % 3 <> 0 AS stored,
    CASE n WHEN 1 THEN CASE WHEN w % 7 = 2 THEN 'text/plain' ELSE 'application/epub+zip' END
    WHEN 2 THEN CASE WHEN w % 10 = 8 THEN '<rootfile/>' WHEN w % 10 = 6 THEN '<rootfile full-path="OEBPS/none.opf"/>' ELSE '<rootfile full-path="OEBPS/p.opf"/>' END
    WHEN 3 THEN concat('<package>', CASE WHEN w % 4 = 0 THEN '<dc:creator>A</dc:creator><dc:date>1</dc:date><dc:publisher>P</dc:publisher><dc:rights>R</dc:rights>' ELSE '<dc:creator>A</dc:creator><dc:date> </dc:date>' END,
      CASE w % 6 WHEN 0 THEN '<meta name="cover" content="img"/>' WHEN 1 THEN '<meta name="cover" content="who"/>' WHEN 2 THEN '' ELSE '<meta name="cover" content="img"/>' END, '<manifest><item id="nav" href="nav.xhtml"/><item id="img" href="img/a.png"', CASE WHEN w % 6 = 0 OR w % 6 = 5 THEN '' ELSE ' properties="cover-image"' END, '/>',
      items, CASE WHEN w % 5 = 1 THEN '<item id="g" href="gone.xhtml"/>' ELSE '' END, '</manifest><spine>', refs, CASE WHEN w % 5 = 2 THEN '<itemref idref="zz"/>' ELSE '' END, '</spine></package>')
    WHEN 4 THEN concat('<html lang="x"><nav epub:type="toc"><ol>', entries, CASE WHEN w % 5 = 3 THEN '<li><a href="ghost.xhtml">g</a></li>' ELSE '' END, '</ol></nav></html>')
    WHEN 5 THEN concat(points, CASE WHEN w % 5 = 4 THEN '<content src="lost.xhtml"/>' ELSE '' END)
    WHEN 6 THEN CASE w % 5 WHEN 0 THEN 'p{{color:red}}' WHEN 1 THEN 'p{{font-family: "Foo"; font-size:2em}}' WHEN 2 THEN '/* color: x */p{{margin:0}}' WHEN 3 THEN '@import "x";' ELSE 'p{{font-family: serif; background-color: x}}' END
    WHEN 9 THEN '' ELSE 'same bytes' END AS body
  FROM listed CROSS JOIN nine WHERE (n <> 2 OR w % 10 <> 7) AND (n <> 9 OR w % 11 = 0)
  UNION ALL SELECT concat('p', w), 10 + page_id, concat('OEBPS/', name), false, html FROM made)"""


def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, ord, path, stored, size, body of the packages."""
    in_small_batches(spark)
    read(spark, sf_dir, "pages").createOrReplaceTempView("pages_of_packages")
    joined = lambda x, by: f"array_join(transform(array_sort(collect_list(struct({by} AS k, {x} AS x))), s -> s.x), '')"
    members = spark.sql(f"WITH {package_sql('pages_of_packages', joined)} SELECT * FROM package_members")
    return members.select("work", F.col("ord").cast("long").alias("ord"), "path", "stored", F.octet_length("body").cast("long").alias("size"), F.encode("body", "UTF-8").alias("body"))


PACKAGES = package_sql("pages", lambda x, by: f"string_agg({x}, '' ORDER BY {by})")
