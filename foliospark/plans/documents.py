"""Queries over files of several formats, markup and catalogues."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from foliospark.functions import markup, text as t
from foliospark.functions.udfs import rtl_ratio
from foliospark.plans.evidence import listed
from foliospark.operators.gate import release
from foliospark.plans.gate import DECIDED, FACTS
from foliospark.plans.registry import Literal, query, with_tables
from foliospark.session import read
from foliospark.sources import documents as docs


def packed(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name.replace("__", "/").replace("_dot_", ".")), body)
    return out.getvalue()


def files(spark):
    epub = packed(
        mimetype="application/epub+zip", **{"META-INF/container.xml": '<container xmlns="u"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'},
        **{"OEBPS/p.opf": '<package xmlns="o"><manifest><item id="a" href="a.xhtml"/><item id="b" href="t/b%20c.xhtml"/><item id="n" href="n.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="n" linear="no"/></spine></package>'},
        **{"OEBPS/a.xhtml": "<html><body><h1>A</h1><p>one <b>two</b></p></body></html>", "OEBPS/t/b c.xhtml": "<p>first</p><h2>B &amp; C</h2><p>x<br/>y</p>", "OEBPS/n.xhtml": "<p>no</p>"},
    )
    w = 'xmlns:w="w"'
    docx = packed(**{"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p></w:body></w:document>'})
    rows = [("/in/one.md", "intro\n# H1\ntext\n```\n# no\n```".encode()), ("/in/two.html", b"<title>t</title><h1>X</h1><p>y</p><script>z</script>"), ("/in/three.epub", epub), ("/in/four.docx", docx), ("/in/five.xyz", b"?"), ("/in/six.epub", b"broken"), ("/in/seven.txt", b"")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


LOADED = [
    ("one", 1, "", "intro", "text"), ("one", 2, "H1", "text\n```\n# no\n```", "text"), ("two", 1, "", "t", "html"), ("two", 2, "X", "y", "html"), ("three", 1, "", "first", "epub"), ("three", 2, "B & C", "x y", "epub"), ("three", 3, "A", "one two", "epub"), ("four", 1, "Head", "Body", "docx"), ("five", 1, "", "", "unsupported"),
]


@query(listed("expected", "work string, ord long, title string, body string, kind string", *LOADED))
def loaded_documents(spark, d):
    """Units of files by their format, worked by hand."""
    return docs.load(files(spark))


@query("SELECT * FROM (VALUES ('/in/five.xyz', 'xyz', 1::BIGINT, sha256('?')), ('/in/six.epub', 'epub', 6, sha256('broken')), ('/in/seven.txt', 'txt', 0, sha256(''))) v(path, kind, size, sha256)")
def file_facts(spark, d):
    return docs.file_facts(files(spark).where("path rlike 'five|six|seven'"))


TREE = json.dumps({"blocks": [{"t": "Header", "c": [2, ["h", [], []], [{"t": "Str", "c": "Two"}, {"t": "Space"}, {"t": "Str", "c": "words"}]]}, {"t": "Para", "c": [{"t": "Emph", "c": [{"t": "Str", "c": "a"}]}, {"t": "Note", "c": [{"t": "Para", "c": [{"t": "Str", "c": "n"}]}]}]}, {"t": "BulletList", "c": [[{"t": "Plain", "c": [{"t": "Str", "c": "i"}]}], [{"t": "Plain", "c": [{"t": "Str", "c": "j"}]}]]}, {"t": "Div", "c": [["", [], []], [{"t": "BlockQuote", "c": [{"t": "Para", "c": [{"t": "Code", "c": [["", [], []], "q"]}]}]}]]}, {"t": "CodeBlock", "c": [["", [], []], "x = 1"]}]})


@query(listed("expected", "id long, place long, kind string, level long, text string", (1, 0, "heading", 2, "Two words"), (1, 1, "paragraph", None, "a"), (1, 2, "item", None, "i"), (1, 3, "item", None, "j"), (1, 4, "quote", None, "q"), (1, 5, "code", None, "x = 1")))
def tree_blocks(spark, d):
    x = spark.createDataFrame([(1, TREE), (2, "not json"), (3, None)], "id long, tree string")
    return x.select("id", F.posexplode(docs.ast_blocks(F.col("tree"))).alias("place", "b")).select("id", F.col("place").cast("long").alias("place"), "b.kind", "b.level", "b.text")


HREFS = Literal("hrefs", "id long, document string, href string, want string", (1, "OEBPS/a.xhtml", "b.xhtml#x", "OEBPS/b.xhtml"), (2, "OEBPS/t/a.xhtml", "../i/p%20q.png", "OEBPS/i/p q.png"), (3, "a.xhtml", "../x", None), (4, "a.xhtml", "http://x/y", None), (5, "a.xhtml", "#top", None), (6, "a.xhtml", "/abs", None)).also(
    "SELECT 100 + p_partkey, concat('OEBPS/t/', p_size, '.xhtml'), CASE WHEN p_size % 3 = 0 THEN concat('../i/', p_partkey, '.png') ELSE concat('c', p_partkey, '.xhtml#a') END, CASE WHEN p_size % 3 = 0 THEN concat('OEBPS/i/', p_partkey, '.png') ELSE concat('OEBPS/t/c', p_partkey, '.xhtml') END FROM {part}"
)


@query(with_tables(HREFS) + " SELECT id, want AS member FROM hrefs")
def member_paths(spark, d):
    return HREFS.frame(spark, d).select("id", docs.resolved_member(F.col("document"), F.col("href")).alias("member"))


CATALOG = Literal("catalog", "item string, kind string, status string, unit string, note string", ("a", "text", "included", "u1", ""), ("b", "odd", "included", "", ""), ("c", "image", "excluded", None, " "), ("d", "text", "included", "u9", ""), ("e", "toc", None, None, "n"), ("f", "note", "absent", None, "lost"))


@query(listed("expected", "item string, code string", ("b", "kind"), ("b", "unit_missing"), ("c", "note_missing"), ("d", "unit_unknown"), ("e", "status")))
def catalog_violations(spark, d):
    return docs.catalog_violations(CATALOG.frame(spark), spark.createDataFrame([("u1",)], "unit string"))


LABELS = Literal(
    "md_labels", "id long, s string, want string",
    (1, "**Bold** and *it* of `code`", "Bold and it of code"), (2, "[text](x.md) ![alt](y.png)", "text alt"), (3, "Head {#id} [^1]", "Head"), (4, "a \\* b <i>c</i>", "a * b c"), (5, "snake_case_word", "snake_case_word"), (6, "", ""),
).also(
    "SELECT 100 + p_partkey, concat('**', p_name, '** and *', p_type, '* of [', p_brand, '](x', p_size, '.md) `c', p_size, '`'), concat(p_name, ' and ', p_type, ' of ', p_brand, ' c', p_size) FROM {part}"
)


@query(with_tables(LABELS) + " SELECT id, want AS label FROM md_labels")
def plain_labels(spark, d):
    return LABELS.frame(spark, d).select("id", markup.plain_label(F.col("s")).alias("label"))


RESIDUE = Literal("md_residue", "id long, s string, want string", (1, "::: note\ntext\n:::\nmore", "text\nmore"), (2, "[span]{.x} y{#z}", "span y"), (3, "a\n\n\n\nb", "a\n\nb"), (4, "x <!-- fingerprint: {\"v\":1} --> y <!-- other -->", "x <!-- fingerprint: {\"v\":1} --> y <!-- other -->")).also(
    "SELECT 100 + p_partkey, concat('::: box', chr(10), p_name, chr(10), ':::', chr(10), '[', p_type, ']', chr(123), '.k', chr(125)), concat(p_name, chr(10), p_type) FROM {part}"
)


@query(with_tables(RESIDUE) + " SELECT id, want AS clean, CASE id WHEN 4 THEN 'x  y <!-- other -->' ELSE s END AS unstamped FROM md_residue")
def residue_cleaning(spark, d):
    return RESIDUE.frame(spark, d).select("id", markup.without_residue(F.col("s")).alias("clean"), markup.own_comments_removed(F.col("s")).alias("unstamped"))


CORRECTED = Literal("corrected_rows", "id long, src string, note string, want string", (1, "The IDG met", "kept", "corrected:IDG>IDF;kept"), (2, "The IDG met", None, "corrected:IDG>IDF"), (3, "fine", "kept", "kept"), (4, "fine", None, None)).also(
    "SELECT 100 + p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('The IDG of ', p_name) ELSE p_name END, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'corrected:IDG>IDF' ELSE concat('corrected:IDG>IDF;', p_type) END ELSE CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END END FROM {part}"
)


@query(with_tables(CORRECTED) + " SELECT id, want AS note FROM corrected_rows")
def correction_notes(spark, d):
    return CORRECTED.frame(spark, d).select("id", markup.with_correction_note(F.col("note"), t.corrections_in(F.col("src"))).alias("note"))


MDS = Literal("mds", "id long, md string", (1, "# A\n\n## B"), (2, "# A\ntext"), (3, ""), (4, None), (5, "    # code"), (6, "## Only {fig:1}\n[^1]: note  text[^2]\nbody {fig:2}")).also(
    "SELECT 100 + p_partkey, concat('## ', p_name, chr(10), CASE WHEN p_size % 2 = 0 THEN concat(chr(10), '# ', p_type) ELSE concat('[^1]: ', p_type, ' and ', p_brand) END) FROM {part}"
)


@query(with_tables(MDS) + r""", x AS (SELECT id, coalesce(md, '') AS md FROM mds), l AS (SELECT id, list_filter(string_split(md, chr(10)), lambda v: trim(v) <> '') AS ls FROM x)
SELECT x.id, len(ls) > 0 AND len(list_filter(ls, lambda v: NOT regexp_matches(v, '^#{1,6}[ \t]+\S'))) = 0 AS heading_only, regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^#{1,6}[ \t]+.*$', '', 'g'), '(?m)^\[\^[^\]]+\]:\s*', '', 'g'), '\[\^[^\]]+\]|\{\w+:\d+\}', '', 'g'), '\s+', '', 'g') AS drift FROM x JOIN l USING (id)""")
def markdown_predicates(spark, d):
    return MDS.frame(spark, d).select("id", markup.heading_only(F.col("md")).alias("heading_only"), markup.drift_key(t.text_of("md")).alias("drift"))


RTL = Literal("rtl_texts", "id long, s string, ratio double", (1, "שלום abc", 0.571429), (2, "abc", 0.0), (3, "", 0.0), (4, "سلام", 1.0), (5, "123 !", 0.0)).also(
    "SELECT 100 + p_partkey, concat('שלום ', substr('abcdefghij', 1, CAST(1 + p_size % 9 AS INT))), round(CAST(4 AS DOUBLE) / (5 + p_size % 9), 6) FROM {part}"
)


@query(with_tables(RTL) + " SELECT id, ratio, ratio AS approximate, CASE WHEN ratio >= 0.5 THEN array_to_string(list_reverse(string_split(s, ' ')), ' ') ELSE s END AS ordered FROM rtl_texts")
def right_to_left(spark, d):
    s = F.col("s")
    exact = rtl_ratio(s)
    return RTL.frame(spark, d).select("id", F.round(exact, 6).alias("ratio"), F.round(t.rtl_share(s), 6).alias("approximate"), F.when(t.rtl_share(s) >= 0.5, t.reversed_words(t.without_bidi(s))).otherwise(t.without_bidi(s)).alias("ordered"))


@query("""WITH s AS (SELECT source AS work, len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏͰ-ϿЀ-ԯ]')) AS ltr, len(regexp_extract_all(coalesce(text, ''), '[֐-ࣿיִ-﷿ﹰ-﻿]')) AS rtl FROM documents) SELECT work, sum(rtl) * 2 > sum(rtl + ltr) AS rtl FROM s GROUP BY work""")
def works_right_to_left(spark, d):
    x = t.text_of("text")
    s = read(spark, d, "documents").select(F.col("source").alias("work"), t.count_of(x, r"[֐-ࣿיִ-﷿ﹰ-﻿]").alias("r"), t.count_of(x, r"[A-Za-zÀ-ɏͰ-ϿЀ-ԯ]").alias("l"))
    return s.groupBy("work").agg((F.sum("r") * 2 > F.sum(F.col("r") + F.col("l"))).alias("rtl"))


FORMULAS = Literal("formulas", "id long, s string, x0 double, x1 double, want boolean", (1, "a = b + c", 200.0, 400.0, True), (2, "The value of x = 3 follows from this long line", 50.0, 550.0, False), (3, "Chapter = 1", 250.0, 350.0, False), (4, "xyz = abc", 50.0, 100.0, False), (5, "∑ α = β × γ", 50.0, 150.0, True))


@query(with_tables(FORMULAS) + " SELECT id, want AS formula FROM formulas")
def formula_blocks(spark, d):
    return FORMULAS.frame(spark).select("id", markup.is_formula(F.col("s"), F.col("x1") - F.col("x0"), F.col("x0"), F.col("x1"), F.lit(600.0)).alias("formula"))


CODE = Literal("code_spans", "id long, s string, want string, stem string", (1, "a `b` c", "a  c", "a-b-c"), (2, "a ``b ` c`` d", "a  d", "a-b-c-d"), (3, "open ` only", "open ` only", "open-only"), (4, "`x``y`", "", "x-y"), (5, "ch01", "ch01", "ch01")).also(
    "SELECT 100 + p_partkey, concat(p_name, ' ``', p_type, ' ` ', p_size, '`` x'), concat(p_name, '  x'), concat(replace(p_name, ' ', '-'), '-', p_type, '-', p_size, '-x') FROM {part}"
)


@query(with_tables(CODE) + " SELECT id, want AS prose, stem FROM code_spans")
def inline_code(spark, d):
    """Worked by hand: a run only closes with one of its own length."""
    return CODE.frame(spark, d).select("id", markup.without_inline_code(F.col("s")).alias("prose"), markup.file_stem(F.col("s")).alias("stem"))


@query(with_tables(FACTS) + DECIDED + """ SELECT work, '{"work":"' || work || '","reason":"' || reason || '","released":' || CASE WHEN reason = 'ok' THEN 'true' ELSE 'false' END || '}' AS report FROM decided""")
def release_report(spark, d):
    """The release decision of each work as JSON."""
    return release(FACTS.frame(spark, d)).select("work", F.to_json(F.struct("work", "reason", "released")).alias("report"))
