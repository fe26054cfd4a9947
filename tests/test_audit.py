"""The audit of packages on a package that breaks every rule, and the rules of styles, edits and sinks."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import audit, evidence
from foliospark.sources import archive, sinks

OPF = """<package><metadata><dc:creator>A</dc:creator><meta name="cover" content="who"/></metadata><manifest><item id="nav" href="nav.xhtml"/><item id="c1" href="c1.xhtml"/><item id="c2" href="t/c%202.xhtml"/>
<item id="gone" href="gone.xhtml"/><item id="i" href="i.png" properties="cover-image"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="zz"/></spine><a href="data:x"/></package>"""
NAV = '<html><body><nav epub:type="toc"><a href="c1.xhtml#a">1</a><a href="lost.xhtml">2</a></nav></body></html>'
C1 = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><h2>a</h2><h4>b</h4><!-- c --><p>x **bold**</p><p>价格 $$ 5</p><table><tr><td>&#35;## C</td><td><code># no</code></td></tr></table>
<p>中 文 断 开 的</p><p>这是一个没有结束的段落它一直写下去直到最后也没有标点</p><p>文字 12 文字</p><p>完。 .</p><p>[3] a marked note</p><img src="i.png"/><img src="i.png" alt="image"/><img src="w.webp" alt="IMG_01"/><img src="no.png" alt="fine words"/>
<img src="https://x/y.png" alt="far away"/><figure><img src="wide.png" alt="a wide one"/><figcaption>scan.jpg</figcaption></figure><a href="#none">n</a><a href="javascript:x">j</a><aside epub:type="footnote" id="f1">note</aside>
<aside epub:type="footnote" id="f2"><a epub:type="backlink" href="#r2">b</a></aside><section epub:type="endnotes"><p>LONG</p><p>9. one alone</p></section></body></html>""".replace("LONG", "1. first note " + "word " * 250 + "2. second note")
C2 = "<html lang='x'><body><h1>t</h1><p>1. one</p><p>2. two</p><p>open <b>markup</p></body></html>"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + bytes(8) + width.to_bytes(4, "big") + height.to_bytes(4, "big")


def packed(*members, stored=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name), body, compress_type=zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return bytearray(out.getvalue())


@pytest.fixture(scope="module")
def findings(spark):
    bad = packed(
        ("mimetype", "text/plain"), ("META-INF/container.xml", '<r full-path="OEBPS/p.opf"/>'), ("OEBPS/p.opf", OPF), ("OEBPS/nav.xhtml", NAV), ("OEBPS/toc.ncx", '<content src="c1.xhtml#a"/><content src="x.xhtml"/>'), ("OEBPS/landmarks.xhtml", '<a href="y.xhtml"/>'),
        ("OEBPS/c1.xhtml", C1), ("OEBPS/t/c 2.xhtml", C2), ("OEBPS/style.css", 'p{color:red;font-size:1em;font-family:"A"} @import "x"; /* url(y) */'), ("OEBPS/i.png", png(10, 10)), ("OEBPS/w.webp", b"RIFF"), ("OEBPS/wide.png", png(5000, 100)),
    )
    good = packed(
        ("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<r full-path="p.opf"/>'), ("p.opf", '<package><dc:creator>A</dc:creator><dc:date>1</dc:date><dc:publisher>P</dc:publisher><dc:rights>R</dc:rights><item id="a" href="a.xhtml"/><itemref idref="a"/></package>'),
        ("a.xhtml", '<html lang="x"><body><h1 id="t">T</h1><h2>U</h2><p>Fine.</p><a href="#t">t</a></body></html>'), ("nav.xhtml", '<html lang="x"><nav epub:type="toc"><a href="a.xhtml">a</a></nav></html>'.replace("epub:type", "type")), stored=("mimetype",),
    )
    bare = packed(("first", "x"), ("mimetype", "application/epub+zip"), stored=("mimetype",))
    packages = spark.createDataFrame([("bad", bad), ("good", good), ("bare", bare), ("broken", bytearray(b"no zip"))], "work string, content binary")
    members = archive.members(packages).withColumn("size", F.octet_length("body").cast("long"))
    rows = audit.unreadable(packages, members).union(audit.audit(members)).collect()
    return {w: sorted((r["code"], r["path"] or "", r["detail"] or "") for r in rows if r["work"] == w) for w in ("bad", "good", "bare", "broken")}


def test_a_package_that_breaks_every_rule(findings):
    c1, c2 = "OEBPS/c1.xhtml", "OEBPS/t/c 2.xhtml"
    assert findings["bad"] == sorted([
        ("E_MIMETYPE_STORED", "mimetype", ""), ("E_MIMETYPE_CONTENT", "mimetype", ""), ("E_SPINE_REF", "", "zz"), ("E_MANIFEST_HREF", "OEBPS/p.opf", "gone.xhtml"), ("E_NAV_HREF", "OEBPS/nav.xhtml", "lost.xhtml"), ("E_NCX_HREF", "OEBPS/toc.ncx", "x.xhtml"),
        ("E_LANDMARKS_HREF", "OEBPS/landmarks.xhtml", "y.xhtml"), ("E_TOC_COVERAGE", c2, "not listed"), ("E_TOC_COVERAGE", "OEBPS/lost.xhtml", "not in the spine"), ("E_COVER_META", "OEBPS/p.opf", "unknown who"), ("W_META_INCOMPLETE", "OEBPS/p.opf", "dc:date,dc:publisher,dc:rights"), ("E_UNSAFE_URL", "OEBPS/p.opf", ""),
        ("E_THEME_FONT", "OEBPS/style.css", "family"), ("E_THEME_FONT", "OEBPS/style.css", "size"), ("E_THEME_COLOR", "OEBPS/style.css", "color"), ("E_THEME_EXTERNAL", "OEBPS/style.css", "external"), ("E_IMG_REMOTE", c1, "https://x/y.png"), ("E_IMG_SRC", c1, "no.png"),
        ("W_IMG_NO_ALT", c1, "0"), ("W_IMG_FORMAT", c1, "w.webp"), ("W_IMG_LARGE", c1, "wide.png"), ("W_IMG_RATIO", c1, "wide.png"), ("W_IMAGE_DUPLICATE", "OEBPS/i.png", "2"), ("E_CAPTION_PLACEHOLDER", c1, "image"), ("E_CAPTION_FILENAME", c1, "IMG_01"), ("E_CAPTION_FILENAME", c1, "scan.jpg"),
        ("W_NO_LANG", c1, ""), ("W_H1_COUNT", c1, "0"), ("E_UNSAFE_URL", c1, ""), ("E_HEADING_SKIP", c1, "2>4"), ("E_RESIDUE", c1, "comment"), ("W_RESIDUE", c1, "**"), ("W_RESIDUE", c1, "$$"), ("W_CELL_ATX", c1, "### C"), ("W_CJK_SPACED", c1, ""), ("W_PARA_UNCLOSED", c1, "点"),
        ("W_NOTE_IN_PHRASE", c1, ""), ("W_PUNCT_MIXED", c1, "。."), ("E_XHTML_XML", "OEBPS/nav.xhtml", ""), ("E_XHTML_XML", c2, ""), ("E_ANCHOR", c1, "none"), ("E_ANCHOR", c1, "r2"), ("E_FN_BACKLINK", c1, "f1"), ("E_FN_BACKLINK", c1, "f2"), ("E_FOOTNOTES_NOT_SEMANTIC", "", "1"), ("W_COLLECTED_NOTES_UNSEGMENTED", c1, "1"),
    ])


def test_good_and_unreadable_packages(findings):
    assert findings["good"] == []
    assert findings["bare"] == [("E_MIMETYPE_FIRST", "first", ""), ("E_NO_CONTAINER", "META-INF/container.xml", "")]
    assert findings["broken"] == [("E_NOT_EPUB", "", "")]


def test_collected_notes_of_known_units(spark):
    """A unit of notes whose source has many more notes than there are blocks; without that knowledge short blocks pass."""
    html = "<html><body>" + "<p>1. a 2. b 3. c 4. d 5. e</p>" * 2 + "<pre>1. a 2. b</pre></body></html>"
    docs = spark.createDataFrame([("w", "n.xhtml", html), ("w", "m.xhtml", "<html><open></html>")], "work string, path string, html string")
    contexts = spark.createDataFrame([("w", "n.xhtml", "notes", 10), ("w", "m.xhtml", "notes", 10)], "work string, path string, kind string, n_source long")
    docs = docs.select("work", "path", audit.regions_of("html").alias("regions"))
    assert [tuple(r) for r in audit.collected_notes(docs, contexts).collect()] == [("w", "W_COLLECTED_NOTES_UNSEGMENTED", "n.xhtml", "1,2")]
    assert audit.collected_notes(docs).count() == 0


@pytest.mark.parametrize("css, want", [
    ("p { text-indent: 2em; margin: 0 }", None), ("", None), ("/* only */", None), ("p { margin: 0", "braces"), ("@media x { p { margin: 0 } }", "at"), ("p { margin: 0 } \n { margin: 0 }", "selector"), ("{ margin: 0 }", "rules"), ("p { margin }", "colon"), ("p { color: red }", "property"), ("p { margin: url(x) }", "value"), ("just text", "rules"), ("p { margin: 0 } } {", "rules"),
])
def test_styles_of_works(spark, css, want):
    assert spark.createDataFrame([(css,)], "css string").select(audit.style_violation(F.col("css"))).first()[0] == want


def test_bodies_are_read_once(spark):
    members = spark.createDataFrame([("w", 1, "mimetype", True, 1, bytearray(b"x"))], "work string, ord long, path string, stored boolean, size long, body binary")
    findings = audit.audit(members)
    plan = findings._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bbody#", plan) and "ExistingRDD" not in plan and 5 < plan.count("Scan parquet") <= 50
    assert findings.inputFiles() and all("audit-events" in x for x in findings.inputFiles())


def test_edits_are_made_together(spark):
    files = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1"), ("b", "y", "changed"), ("c", "x", "new")], "work string, path string, content string")
    plan = spark.createDataFrame([(w, p, c, "new") for w, p, c in (("a", "x", "1"), ("b", "x", "1"), ("b", "y", "2"), ("c", "x", "1"))], "work string, path string, old string, after string").select("work", "path", F.sha2("old", 256).alias("old_sha256"), "after")
    out = evidence.applied_edits(files, plan)
    assert sorted(map(tuple, out.collect())) == [("a", "x", "new", "applied"), ("a", "y", "2", "applied"), ("b", "x", "1", "refused"), ("b", "y", "changed", "refused"), ("c", "x", "new", "already_applied")]
    again = evidence.applied_edits(out.drop("status"), plan)
    assert {(r["work"], r["status"]) for r in again.collect()} == {("a", "already_applied"), ("b", "refused"), ("c", "already_applied")}


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.replaced(spark.createDataFrame([(1,), (2,)], "x long"), path)
    first = spark.read.json(path)
    sinks.replaced(spark.createDataFrame([(3,)], "x long"), path)
    assert [r["x"] for r in spark.read.json(path).collect()] == [3] and first.columns == ["x"]
    with pytest.raises(Exception):
        sinks.replaced(spark.createDataFrame([(1,)], "x long").select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert [r["x"] for r in spark.read.json(path).collect()] == [3]
    store = spark.createDataFrame([("guild", "行会", ["a", "b"])], "source string, target string, aliases array<string>")
    sinks.save_store(store, str(tmp_path / "store"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "store"), header=True).collect()] == [("guild", "行会", "a|b")]
