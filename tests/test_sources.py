import io
import zipfile

from pyspark.sql import functions as F

from foliospark.sources import archive, readers, sinks


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_glossary_is_coerced(spark, tmp_path):
    path = write(tmp_path / "g.csv", "﻿source,target,type,aliases,status\nguild,行会,ORG,gild|craft,confirmed\n,x,,,\nmoot,集会,odd,,odd\n")
    got = [tuple(r) for r in readers.glossary(spark, path).orderBy("source").collect()]
    assert got == [("guild", "行会", "org", ["gild", "craft"], "", "", "confirmed", ""), ("moot", "集会", "term", [], "", "", "seed", "")]
    store = readers.term_store(spark, path)
    assert store.columns[-3:] == ["src_lang", "tgt_lang", "book"]
    path = write(tmp_path / "old.csv", "category,source,target,note\n人名,Ann,安,\n别的,x,某,n\n")
    assert [r["type"] for r in readers.legacy_glossary(spark, path).orderBy("source").collect()] == ["person", "term"]


def test_exemptions_are_checked(spark, tmp_path):
    digest = "a" * 64
    path = write(tmp_path / "e.csv", f"unit,source,reason,seq,note_id,occurrence,text_sha256,evidence\na,guild,ok,,,,,\na,guild,ok,1,,1,{digest},seen\n,guild,,0,,x,zz,\n")
    rows, wrong = readers.exemptions(spark, path)
    assert rows.count() == 2
    assert sorted(r["code"] for r in wrong.collect()) == ["digest", "evidence_missing", "occurrence_number", "reason_missing", "seq_number", "unit_missing"]


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", '{"source":"a","proposed_target":"x","status":"open"}\nbroken\n{"source":"a","proposed_target":"x","status":"later"}\n{"source":"a","proposed_target":"y"}\n')
    got = sorted((r["proposed_target"], r["status"]) for r in readers.conflicts(spark, path).collect())
    assert got == [("x", "open"), ("y", None)]
    assert readers.json_lines(spark, path, "source string").count() == 3


def test_text_units(spark):
    docs = spark.createDataFrame([("w", "intro\n# One\nbody\n```\n# no\n```\n## Two\nChapter 3\nmore"), ("v", "no heading")], "work string, text string")
    got = sorted((r["work"], r["unit"], r["title"], r["body"]) for r in readers.text_units(docs).collect())
    assert got == [("v", 0, "", "no heading"), ("w", 0, "", "intro"), ("w", 1, "One", "body\n```\n# no\n```"), ("w", 2, "Two", ""), ("w", 3, "Chapter 3", "more")]


def test_merged_batches(spark):
    parts = spark.createDataFrame([("w", 1, 1, 2, "a"), ("w", 1, 2, 2, "b"), ("w", 2, 1, 3, "c"), ("v", 2, 1, 9, "d"), ("v", 1, 1, 4, "e")], "work string, batch long, page long, n_pages long, text string")
    assert sorted((r["work"], r["page"], r["text"]) for r in readers.merged_batches(parts).collect()) == [("v", 1, "e"), ("v", 5, "d"), ("w", 1, "a"), ("w", 2, "b"), ("w", 3, "c")]


def test_spine(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="one.xhtml"/><item id="b" href="two.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
    got = archive.spine(spark.createDataFrame([("w", bytearray(out.getvalue()))], "work string, content binary"))
    assert sorted((r["place"], r["path"]) for r in got.collect()) == [(1, "OEBPS/two.xhtml"), (2, "OEBPS/one.xhtml")]


def test_sinks(spark, tmp_path):
    align = spark.createDataFrame([(1, "a", "b", None, None)], readers.ALIGN)
    sinks.save_align(align, str(tmp_path / "align"))
    assert readers.align_rows(spark, str(tmp_path / "align")).select("seq", "src").first() == (1, "a")
    schema = "source string, existing_target string, proposed_target string"
    standing, proposed = spark.createDataFrame([("a", "x", "y")], schema), spark.createDataFrame([("a", "x", "y"), ("a", "x", "z"), ("a", "x", "z")], schema)
    path = str(tmp_path / "conflicts")
    assert sinks.append_conflicts(standing, proposed, path) == 1
    assert sinks.append_conflicts(standing.union(spark.read.schema(schema).json(path)), proposed, path) == 0
    md = sinks.markdown_table(spark.createDataFrame([(2, "b|c"), (1, "a")], "n long, s string"), ["n", "s"], ["n"]).first()["md"]
    assert md == "| n | s |\n|---|---|\n| 1 | a |\n| 2 | b\\|c |"
    g = spark.createDataFrame([("s", "t", "term", ["a", "b"], "", "", "seed", "")], "source string, target string, type string, aliases array<string>, gender string, reading string, status string, note string")
    sinks.save_glossary(g, str(tmp_path / "g"))
    assert readers.glossary(spark, str(tmp_path / "g")).first()["aliases"] == ["a", "b"]
    sinks.save_findings(spark.createDataFrame([("w", "c")], "work string, code string"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).where(F.col("work") == "w").count() == 1
