"""Queries over the structure of works."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import structure as s
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.plans.text import NOSPACE
from foliospark.session import read
from foliospark.sources import readers, sinks
from foliospark.sources.adapters import LINES, lines

TOC = Literal(
    "toc_tree", "work string, ord long, level long, title string, nav boolean",
    ("a", 1, 1, "Cover", True), ("a", 2, 1, "Part one", True), ("a", 3, 2, "Chapter 1", True), ("a", 4, 4, "Deep", True), ("a", 5, 3, "Less deep", True), ("a", 6, 2, "Chapter 2", False),
    ("a", 7, 6, "Sixth", True), ("a", 8, 1, "Part two", True), ("a", 9, 3, "Jumped", True), ("a", 10, 3, "Sibling", True), ("b", 1, 3, "Starts low", True), ("b", 2, 2, "Higher", True), ("b", 3, 3, "Under it", True), ("b", 4, 5, "Deeper", True),
).also(
    "SELECT concat('s', source), doc_id, 1 + (doc_id * 7) % 6, substr(text, 1, 12), doc_id % 5 <> 0 FROM {documents}"
)
TOC_SQL = with_tables(TOC).replace("WITH ", "WITH RECURSIVE ", 1) + """,
up AS (SELECT a.*, (SELECT max(b.ord) FROM toc_tree b WHERE b.work = a.work AND b.ord < a.ord AND b.level < a.level) AS parent FROM toc_tree a),
tree(work, ord, depth) AS (SELECT work, ord, 1 FROM up WHERE parent IS NULL UNION ALL SELECT up.work, up.ord, tree.depth + 1 FROM up JOIN tree ON up.work = tree.work AND up.parent = tree.ord)
SELECT up.work, up.ord, level, title, nav, CAST(depth AS BIGINT) AS depth, parent FROM up JOIN tree USING (work, ord)"""


@query(TOC_SQL)
def toc_depth(spark, d):
    return s.toc_depths(TOC.frame(spark, d))


#: Nested text by its brackets: an entry opens at its place and closes before the next entry that isn't deeper, the deepest first.
TREE_SQL = TOC_SQL + """), ends AS (SELECT a.work, a.ord, a.title, a.depth, coalesce((SELECT min(b.ord) FROM placed b WHERE b.work = a.work AND b.ord > a.ord AND b.depth <= a.depth), 1000000000000) AS stop FROM placed a),
marks AS (SELECT work, ord AS spot, 1 AS kind, 0 AS sub, '{"children":[' AS mark FROM placed UNION ALL SELECT work, stop, 0, -depth, '],"label":' || CAST(to_json(coalesce(title, '')) AS VARCHAR) || '}' FROM ends)
SELECT work, '[' || replace(string_agg(mark, '' ORDER BY spot, kind, sub), '}{', '},{') || ']' AS tree FROM marks GROUP BY work"""


@query(TREE_SQL.replace("SELECT up.work, up.ord, level, title, nav,", ", placed AS (SELECT up.work, up.ord, level, title, nav,", 1))
def toc_nested(spark, d):
    """The contents of every work as nested JSON."""
    tree = s.toc_tree(TOC.frame(spark, d).withColumnRenamed("title", "label"))
    return tree.select("work", F.to_json("tree").alias("tree"))


@query(f"SELECT work, ord, title, depth FROM ({TOC_SQL}) WHERE nav AND depth <= 3")
def nav_projection(spark, d):
    return s.toc_depths(TOC.frame(spark, d)).where("nav and depth <= 3").select("work", "ord", "title", "depth")


TITLES = Literal(
    "titles", "work string, ord long, title string",
    *[("a", i + 1, x) for i, x in enumerate(["Cover", "Half Title", "Title Page", "Copyright", "The Covert War", "Foreword", "Contents", "Chapter One", "Index", "Appendix A", "Appendix B", "Back cover", "References", "序言", "第一章", "Sources & Literature", "Endnotes", "", "indexes of life"])],
    ("b", 1, "A Preface"), ("b", 2, None), ("b", 3, "目录"), ("b", 4, "Dedication"),
).also(
    "SELECT concat('s', source), doc_id, CASE doc_id % 20 WHEN 0 THEN 'Index' WHEN 1 THEN 'Appendix' WHEN 2 THEN 'Preface' WHEN 3 THEN 'Title Page' WHEN 4 THEN 'cover' WHEN 5 THEN '目录' ELSE substr(text, 1, 20) END FROM {documents}"
)


def _cases(column: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), '{s.title_pattern(w)}') THEN '{(r, k)[column]}'" for w, r, k in s.TITLE_KINDS) + f" ELSE '{('body', 'chapter')[column]}' END"


@query(with_tables(TITLES) + f""", k AS (SELECT *, {_cases(0)} AS region, {_cases(1)} AS kind FROM titles), n AS (SELECT *, row_number() OVER (PARTITION BY work, region, kind ORDER BY ord) AS n FROM k)
SELECT work, ord, title, region, kind, CASE region WHEN 'body' THEN 'ch' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END WHEN 'cover' THEN 'cover' || CASE WHEN n = 1 THEN '' ELSE '-' || n END
  ELSE CASE region WHEN 'frontmatter' THEN 'front-' ELSE 'back-' END || kind || CASE WHEN n = 1 THEN '' ELSE '-' || n END END AS unit_id FROM n""")
def classify_units(spark, d):
    return s.classified(TITLES.frame(spark, d))


FURNITURE = """short AS (SELECT work, unit AS page, line, text FROM lines WHERE length(text) <= 40), np AS (SELECT work, count(DISTINCT unit) AS pages FROM lines GROUP BY work),
e AS (SELECT *, min(line) OVER w AS f, max(line) OVER w AS l FROM short WINDOW w AS (PARTITION BY work, page)), edge AS (SELECT * FROM e WHERE line IN (f, l)),
tally AS (SELECT work, text, count_if(line = f) AS heads, count_if(line = l) AS feet FROM edge GROUP BY ALL),
often AS (SELECT work, text FROM tally JOIN np USING (work) WHERE pages >= 3 AND greatest(heads, feet) >= greatest(2, pages // 2))"""
PAGES = Literal(
    "page_lines", "work string, page long, line long, text string",
    *[("a", p, i + 1, x) for p in range(1, 7) for i, x in enumerate(["The Running Head" if p % 3 else "Another head", f"body of page {p} that goes on and on, well past forty characters", f"closing words {p}" + ("." if p % 2 else ""), "foot note line" if p > 2 else f"foot {p}"])],
    ("b", 1, 1, "Only"), ("b", 2, 1, "Only"), ("c", 1, 1, "Solo line"), ("c", 2, 1, "Solo line"), ("c", 3, 1, "Solo line"),
).also(
    "SELECT concat('s', source), doc_id, n, CASE n WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE concat('Work ', source) END WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'foot of the page' ELSE substr(text, 30, 50) END ELSE substr(text, 20, 90) END FROM {documents} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) m"
)


@query(with_tables(PAGES) + f", lines AS (SELECT work, page AS unit, line, text FROM page_lines), {FURNITURE} SELECT work, page, line, text, CASE WHEN line = f THEN 'repeated_header' ELSE 'repeated_footer' END AS role FROM edge JOIN often USING (work, text)")
def repeated_header_footer(spark, d):
    return s.repeated_furniture(PAGES.frame(spark, d))


@query(f"""WITH {LINES}, e AS (SELECT work, unit AS page, arg_min(text, line) AS head, arg_max(text, line) AS tail FROM lines GROUP BY ALL),
p AS (SELECT work, page, lead(page) OVER w AS next_page, tail, lead(head) OVER w AS head FROM e WINDOW w AS (PARTITION BY work ORDER BY page))
SELECT * FROM p WHERE next_page IS NOT NULL AND NOT contains('{(t.TERMINAL + t.CLOSERS + ";；:：").replace("'", "''")}', right(tail, 1))""")
def page_breaks(spark, d):
    return s.page_breaks(lines(spark, d).withColumnRenamed("unit", "page"))


@query(f"""WITH {LINES}, k AS (SELECT work, unit % 2 AS side, unit * 1000000 + line AS pos, {NOSPACE.format('text')} AS norm FROM lines),
n AS (SELECT *, row_number() OVER (PARTITION BY work, side, norm ORDER BY pos) AS n FROM k), a AS (SELECT * FROM n WHERE side = 0), b AS (SELECT * FROM n WHERE side = 1)
SELECT coalesce(a.work, b.work) AS work, count(a.pos) AS n_left, count(b.pos) AS n_right, count_if(a.pos IS NOT NULL AND b.pos IS NOT NULL) AS matched, sum(coalesce(abs(a.pos - b.pos), 0))::BIGINT AS apart
FROM a FULL JOIN b ON a.work = b.work AND a.norm = b.norm AND a.n = b.n GROUP BY 1""")
def partition_ledger(spark, d):
    """Lines of a work's even units against those of its odd ones, as multisets paired by occurrence."""
    x = lines(spark, d).select("work", "unit", (F.col("unit") * 1_000_000 + F.col("line")).alias("pos"), t.without_blanks(F.col("text")).alias("norm"))
    met = s.fifo_matched(x.where("unit % 2 = 0"), x.where("unit % 2 = 1"), "norm", by=["work"], order="pos")
    both = F.col("left_pos").isNotNull() & F.col("right_pos").isNotNull()
    return met.groupBy("work").agg(F.count("left_pos").alias("n_left"), F.count("right_pos").alias("n_right"), F.count_if(both).alias("matched"), F.sum(F.coalesce(F.abs(F.col("left_pos") - F.col("right_pos")), F.lit(0))).alias("apart"))


@query(f"""WITH RECURSIVE {LINES}, o AS (SELECT unit, line, length(text) AS n, row_number() OVER (PARTITION BY unit ORDER BY line) AS k FROM lines),
f(unit, line, k, chunk, used) AS (SELECT unit, line, k, 1::BIGINT, n::BIGINT FROM o WHERE k = 1
  UNION ALL SELECT o.unit, o.line, o.k, CASE WHEN used > 0 AND used + n > 4000 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + n > 4000 THEN n ELSE used + n END FROM f JOIN o ON o.unit = f.unit AND o.k = f.k + 1)
SELECT unit, line AS block, chunk FROM f""")
def chunk_pack(spark, d):
    return s.packed_blocks(lines(spark, d).select("unit", F.col("line").alias("block"), "text"), 4000)


BOXES = Literal(
    "boxes", "work string, page long, block long, x0 double, y0 double, x1 double, y1 double",
    ("w", 1, 1, 300.0, 100.0, 550.0, 300.0), ("w", 1, 2, 40.0, 20.0, 560.0, 60.0), ("w", 1, 3, 40.0, 100.0, 280.0, 200.0), ("w", 1, 4, 40.0, 210.0, 280.0, 300.0), ("w", 1, 5, 40.0, 320.0, 560.0, 360.0),
    ("w", 1, 6, 300.0, 380.0, 550.0, 500.0), ("w", 1, 7, 40.0, 380.0, 280.0, 500.0), ("w", 1, 8, 40.0, 700.0, 560.0, 740.0), ("w", 2, 1, 10.0, 50.0, 90.0, 60.0), ("w", 2, 2, None, None, None, None), ("w", 2, 3, 10.0, 10.0, 90.0, 20.0),
    ("w", 3, 1, 0.0, 10.0, 100.0, 20.0), ("w", 3, 2, 0.0, 0.0, 100.0, 5.0), ("w", 4, 1, 10.0, 10.0, 40.0, 20.0), ("w", 4, 2, 35.0, 10.0, 60.0, 20.0), ("w", 4, 3, 70.0, 0.0, 100.0, 30.0), ("w", 4, 4, 12.0, 30.0, 30.0, 40.0),
).also(
    "SELECT concat('o', l_orderkey % 10), l_orderkey, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000, CAST((l_partkey * 37) % 500 AS DOUBLE), CAST((l_partkey * 11) % 700 AS DOUBLE), CAST((l_partkey * 37) % 500 + 50 + (l_suppkey * 13) % 300 AS DOUBLE), CAST((l_partkey * 11) % 700 + 10 + l_suppkey % 40 AS DOUBLE) FROM {lineitem} WHERE l_orderkey < 4000"
)
BANDS = """nar AS (SELECT work, page, block, x0, x1, max(x1) OVER (PARTITION BY work, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {}),
banded AS (SELECT work, page, block, x0, x1, CAST(sum(CASE WHEN x0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY work, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS band FROM nar)"""


@query(with_tables(BOXES) + ", boxed AS (SELECT * FROM boxes WHERE x0 IS NOT NULL), " + BANDS.format("boxed") + " SELECT work, page, block, x0, x1, band FROM banded")
def column_bands(spark, d):
    return s.bands(BOXES.frame(spark, d).where("x0 is not null").select("work", "page", "block", "x0", "x1"))


@query(with_tables(BOXES) + """, m AS (SELECT *, bool_and(x0 IS NOT NULL) OVER (PARTITION BY work, page) AS whole, coalesce(x1 - x0 >= 0.6 * max(x1) OVER (PARTITION BY work, page), false) AS wide FROM boxes),
q AS (SELECT work, page, block, x0, x1 FROM m WHERE whole AND NOT wide), """ + BANDS.format("q") + """,
e AS (SELECT m.*, band, min(CASE WHEN NOT wide THEN y0 END) OVER (PARTITION BY m.work, m.page) AS top, max(CASE WHEN NOT wide THEN y1 END) OVER (PARTITION BY m.work, m.page) AS bottom FROM m LEFT JOIN (SELECT work, page, block, band FROM banded) USING (work, page, block)),
p AS (SELECT *, CASE WHEN NOT wide THEN 1 WHEN top IS NULL OR y1 <= top THEN 0 WHEN y0 >= bottom THEN 2 ELSE 1 END AS part FROM e),
z AS (SELECT p.*, CASE WHEN part = 1 THEN (SELECT count(*) FROM p w WHERE w.work = p.work AND w.page = p.page AND w.wide AND w.part = 1 AND w.y0 <= p.y0) ELSE 0 END AS zone FROM p)
SELECT work, page, block, row_number() OVER (PARTITION BY work, page ORDER BY CASE WHEN NOT whole THEN block END NULLS FIRST, part, zone, CASE WHEN wide AND part = 1 THEN -1 ELSE coalesce(band, 0) END, y0, x0, block) AS place FROM z""")
def reading_order(spark, d):
    return s.reading_order(BOXES.frame(spark, d))


@query(with_tables(BOXES).replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT work, page, block, (x0 + x1) / 2 AS c, greatest(1.0, max(x1) OVER (PARTITION BY work, page) * 0.08) AS tol, row_number() OVER (PARTITION BY work, page ORDER BY (x0 + x1) / 2, block) AS k FROM boxes WHERE x0 IS NOT NULL),
f(work, page, block, k, anchor, col) AS (SELECT work, page, block, k, c, 0::BIGINT FROM c WHERE k = 1 UNION ALL SELECT c.work, c.page, c.block, c.k, CASE WHEN c.c - anchor > tol THEN c.c ELSE anchor END, CASE WHEN c.c - anchor > tol THEN col + 1 ELSE col END FROM f JOIN c ON c.work = f.work AND c.page = f.page AND c.k = f.k + 1)
SELECT work, page, block, col AS "column" FROM f""")
def layout_columns(spark, d):
    return s.columns_by_anchor(BOXES.frame(spark, d).where("x0 is not null"))


@query(with_tables(BOXES) + """, g AS (SELECT *, lead(y0) OVER w - y1 AS gap, lead(x0) OVER w - x0 AS indent FROM boxes WHERE x0 IS NOT NULL WINDOW w AS (PARTITION BY work, page, x0 >= 300 ORDER BY y0, x0, block))
SELECT work, page, block, round(gap, 6) AS gap, CASE WHEN gap IS NULL THEN 'last' WHEN gap > 2 * (y1 - y0) THEN 'new_paragraph' WHEN indent > 0 THEN 'indented' ELSE 'continues' END AS relation FROM g""")
def layout_relations(spark, d):
    """How the next block of a column relates: a wide gap opens a paragraph, a shift to the right is an indent."""
    from pyspark.sql import Window

    w = Window.partitionBy("work", "page", F.col("x0") >= 300).orderBy("y0", "x0", "block")
    g = BOXES.frame(spark, d).where("x0 is not null").withColumn("gap", F.lead("y0").over(w) - F.col("y1")).withColumn("indent", F.lead("x0").over(w) - F.col("x0"))
    relation = F.when(F.col("gap").isNull(), "last").when(F.col("gap") > 2 * (F.col("y1") - F.col("y0")), "new_paragraph").when(F.col("indent") > 0, "indented").otherwise("continues")
    return g.select("work", "page", "block", F.round("gap", 6).alias("gap"), relation.alias("relation"))


NUMBERS = Literal(
    "edge_numbers", "work string, page long, value long",
    *[("a", p, p + 2) for p in range(3, 12) if p != 7], ("a", 5, 1968), ("a", 7, 1968), ("a", 12, 300), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3), *[("c", p, v) for p, v in ((1, 2), (2, 3), (2, 5), (3, 4), (4, 6), (5, 7), (6, 6), (7, 8), (8, 9))],
).also(
    "SELECT DISTINCT concat('c', o_custkey % 50), o_orderkey % 97, o_orderkey % 97 + (o_orderkey * 7) % 5 FROM {orders} WHERE o_orderkey < 20000"
)


@query(with_tables(NUMBERS).replace("WITH ", "WITH RECURSIVE ", 1) + """, near AS (SELECT work, page, value, dense_rank() OVER (PARTITION BY work ORDER BY page) AS k FROM (SELECT DISTINCT * FROM edge_numbers) WHERE value - page BETWEEN 0 AND 3),
f(work, start, k, page, value, n) AS (SELECT work, k, k, page, min(value), 1 FROM near GROUP BY work, k, page
  UNION ALL SELECT f.work, f.start, f.k + 1, m.page, m.value, n + 1 FROM f, LATERAL (SELECT page, min(value) AS value FROM near WHERE near.work = f.work AND near.k = f.k + 1 AND near.value > f.value AND near.value <= f.value + 3 GROUP BY page) m),
b AS (SELECT work, start, max(n) AS size FROM f GROUP BY ALL), c AS (SELECT work, arg_min(start, (-size, start)) AS start, max(size) AS size FROM b GROUP BY work)
SELECT f.work, page, value FROM f JOIN c USING (work, start) WHERE size >= 5""")
def page_chain(spark, d):
    return s.page_chain(NUMBERS.frame(spark, d))


BOOKMARKS = Literal(
    "bookmarks", "work string, ord long, level long, page long, title string",
    ("a", 1, 1, 1, "Front"), ("a", 2, 1, 5, "One"), ("a", 3, 2, 6, "One.1"), ("a", 4, 1, 4, "Back ref"), ("a", 5, 1, 5, "Same"), ("a", 6, 1, 9, "Two"), ("b", 1, 1, 3, "Alone"), ("b", 2, 2, 4, "Sub"),
).also(
    "SELECT concat('s', source), doc_id, 1 + doc_id % 2, (doc_id * 13) % 60 + doc_id % 7, concat('d', doc_id) FROM {documents}"
)
RISING = """, one AS (SELECT *, coalesce(max(page) OVER (PARTITION BY work ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM bookmarks WHERE level = 1),
rising AS (SELECT work, ord, level, page, title, count(*) OVER (PARTITION BY work) AS n FROM one WHERE page > seen)"""


@query(with_tables(BOOKMARKS) + RISING + " SELECT work, ord, level, page, title FROM rising WHERE n >= 2")
def rising_bookmarks(spark, d):
    return s.rising_bookmarks(BOOKMARKS.frame(spark, d))


@query(with_tables(BOOKMARKS) + RISING + """, r AS (SELECT work, title, page, lead(page) OVER (PARTITION BY work ORDER BY page) AS next FROM rising WHERE n >= 2), p AS (SELECT work, unnest(range(1, 61)) AS page FROM (SELECT DISTINCT work FROM bookmarks))
SELECT p.work, p.page, r.title AS chapter FROM p LEFT JOIN r ON p.work = r.work AND p.page >= r.page AND (next IS NULL OR p.page < next)""")
def chapter_ranges(spark, d):
    pages = BOOKMARKS.frame(spark, d).select("work").distinct().select("work", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))).alias("page"))
    return s.ranged(s.rising_bookmarks(BOOKMARKS.frame(spark, d)), pages)


PARAGRAPHS = Literal("numbered", "unit string, ord long, n long", ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 7), ("a", 5, 1), ("a", 6, 3), ("a", 7, 1), ("a", 8, 2), ("b", 1, 2), ("b", 2, 3), ("b", 3, 1)).also(
    "SELECT concat('s', source), doc_id, 1 + CAST(floor(doc_id / 20) AS BIGINT) % 4 FROM {documents}"
)


@query(with_tables(PARAGRAPHS) + """, x AS (SELECT *, n - row_number() OVER (PARTITION BY unit ORDER BY ord) AS g FROM numbered), y AS (SELECT *, CASE WHEN lag(g) OVER (PARTITION BY unit ORDER BY ord) = g THEN 0 ELSE 1 END AS s FROM x),
z AS (SELECT *, sum(s) OVER (PARTITION BY unit ORDER BY ord) AS run FROM y) SELECT unit, ord, n FROM (SELECT *, min(n) OVER w AS f, count(*) OVER w AS c FROM z WINDOW w AS (PARTITION BY unit, run)) WHERE f = 1 AND c >= 2""")
def numbered_runs(spark, d):
    return s.numbered_runs(PARAGRAPHS.frame(spark, d))


PARTS = Literal("batch_items", "work string, batch long, page long, n_pages long, item long", ("w", 1, 1, 2, 1), ("w", 1, 2, 2, 2), ("w", 2, 1, 3, 3), ("v", 2, 1, 9, 4), ("v", 1, 1, 4, 5))
PARTS.also("SELECT concat('c', o_custkey % 40), o_orderkey % 7, 1 + o_orderkey % 30, 31 + o_orderkey % 7, o_orderkey + 100 FROM {orders}")


@query(with_tables(PARTS) + ", s AS (SELECT work, batch, max(n_pages) AS n FROM batch_items GROUP BY ALL) SELECT work, batch, page + coalesce((SELECT sum(n) FROM s WHERE s.work = b.work AND s.batch < b.batch), 0)::BIGINT AS page, item FROM batch_items b")
def merged_batches(spark, d):
    return readers.merged_batches(PARTS.frame(spark, d)).select("work", "batch", "page", "item")


@query("SELECT '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation")
def report_table(spark, d):
    return sinks.markdown_table(read(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])
