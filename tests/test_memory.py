import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.operators import audit, terms


def test_repeats_of_a_source_do_not_widen_its_entries(spark, monkeypatch):
    """A name holds an entry a source, however often the glossary repeats it; which target counts doesn't change."""
    g = [(i, "harbour", ["port"], f"Hafen{i}", "seed") for i in range(3, 200)] + [(1, "quay", ["port"], "Kai", "seed"), (2, "quay", [], "Ufer", "seed")]
    glossary = spark.createDataFrame(g, "ord long, source string, aliases array<string>, target string, status string")
    rows = spark.createDataFrame([(1, "the harbour, the harbour", "no word of it"), (2, "a port", "Hafen3"), (3, "a quay", "Ufer"), (4, "nothing", "nothing")], "id long, src string, tgt string")
    seen, plain = [], terms.finder
    monkeypatch.setattr(terms, "finder", lambda names, **options: seen.append(names) or plain(names, **options))
    told = terms.with_missing_targets(rows, glossary).select("id", F.explode("missing").alias("m")).select("id", "m.source", "m.expected", "m.n")
    assert sorted(map(tuple, told.collect())) == [(1, "harbour", "Hafen3", 2), (2, "quay", "Kai", 0), (3, "quay", "Kai", 1)]
    assert {r["name"]: r["n"] for r in seen[0].select("name", F.size("entries").alias("n")).collect()} == {"harbour": 1, "port": 2, "quay": 1}


def test_markup_is_checked_without_a_tree():
    faults = ["", None, "<a>", "<a></b>", "<a/><b/>", "<a>&nbsp;</a>", "<!DOCTYPE a SYSTEM 'x'><a>&nbsp;</a>", "x"]
    right = ["<a/>", "<a b='1'>&amp;&#233;<!-- c --><?p q?></a>", "<!DOCTYPE a><a>é</a>"]
    assert audit.well_formed.func(pa.array(faults + right, pa.string())).to_pylist() == [False] * len(faults) + [True] * len(right)
    contents = pa.array(["<ol>" + "<li><a href='c.xhtml'>x</a></li>" * 50_000 + "</ol>"])
    tracemalloc.start()
    assert audit.well_formed.func(contents).to_pylist() == [True]
    assert tracemalloc.get_traced_memory()[1] < 6_000_000  # the text is 1,600,000 bytes; as a tree it takes over 10,000,000
    tracemalloc.stop()
