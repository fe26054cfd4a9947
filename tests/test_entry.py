import importlib.util
import re
import subprocess
import sys
import warnings
from pathlib import Path

import __spark_entry__ as entry
from foliospark import views

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views(spark):
    names = views.register(spark, entry.SMOKE)
    assert spark.sql("SELECT work, count(*) FROM lines JOIN units USING (work, unit) GROUP BY work").count() > 0
    assert set(names) <= {t.name for t in spark.catalog.listTables()}


def test_nothing_else_imports_the_training_operators():
    for file in ROOT.joinpath("foliospark").rglob("*.py"):
        if "llm" not in file.parts:
            assert "foliospark.llm" not in file.read_text(), file


def test_catalogue_without_training_operators(monkeypatch):
    """Neither a missing subpackage nor a missing library of theirs takes the other queries away."""
    for gone in ("foliospark.llm.queries", "foliospark.llm"):
        monkeypatch.setitem(sys.modules, gone, None)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        found = entry.queries()
    assert (ROOT / "corpus_pipeline.py").exists() == any("left out" in str(w.message) for w in told)
    assert not [q for q in found if re.match(r"op\d+_|pipeline$", q)] and len(found) > 150
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None)
    assert len(entry.queries()) == len(found) and entry.oracle_sql()


def test_command_line_lists_queries():
    out = subprocess.run([sys.executable, "-m", "foliospark"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "length_gate_by_work" in out.stdout.split()
