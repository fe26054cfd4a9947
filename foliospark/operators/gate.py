"""The gate: conservation between source and target, findings of all rules, and the release decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions.udfs import count_sentence_notes, find_note_numbers, tables
from foliospark.operators.notes import prose

#: Checks that block a release as structure; terminology blocks by itself.
STRUCTURE = ("align", "marker", "footnote", "footnote_range", "heading", "table", "fidelity", "language", "length", "length_review")
LISTS = ("toc", "index")


def conservation(rows: DataFrame, units: DataFrame) -> DataFrame:
    """unit, check, src, tgt, blocking: marks of inserted elements must be as many on either side; notes no fewer on the target side (advice only in contents and indexes).

    Rows: unit, src, tgt; units: unit, kind."""
    toc = F.coalesce(F.col("kind").isin(*LISTS), F.lit(False))
    joined = rows.join(units.select("unit", "kind"), "unit", "left").withColumn("toc", toc)
    notes = lambda c: count_sentence_notes(t.text_of(c), F.col("toc")) + t.note_marks(t.text_of(c))
    sums = joined.groupBy("unit").agg(
        F.sum(t.markers(t.text_of("src"))).alias("m_src"), F.sum(t.markers(t.text_of("tgt"))).alias("m_tgt"), F.sum(notes("src")).alias("n_src"), F.sum(notes("tgt")).alias("n_tgt"), F.bool_or("toc").alias("toc"),
    )
    marks = sums.where("m_src <> m_tgt").select("unit", F.lit("marker").alias("check"), F.col("m_src").alias("src"), F.col("m_tgt").alias("tgt"), F.lit(True).alias("blocking"))
    feet = sums.where("n_tgt < n_src").select("unit", F.lit("footnote").alias("check"), F.col("n_src").alias("src"), F.col("n_tgt").alias("tgt"), (~F.col("toc")).alias("blocking"))
    return marks.union(feet)


def suspects(rows: DataFrame) -> DataFrame:
    """unit, numbers: note numbers of the source side that the target side lacks."""
    found = rows.groupBy("unit").agg(*[F.array_distinct(F.flatten(F.collect_list(find_note_numbers(t.text_of(c), F.lit(False))))).alias(c) for c in ("src", "tgt")])
    missing = F.array_sort(F.array_except("src", "tgt"))
    return found.where(F.size(missing) > 0).select("unit", F.array_join(F.slice(missing, 1, 8).cast("array<string>"), ",").alias("numbers"))


def headings(docs: DataFrame) -> DataFrame:
    """unit, level, src, tgt where the counts of headings outside code differ; docs: unit, source_md, target_md."""

    def counted(column, name):
        lines = docs.select("unit", F.explode(F.split(prose(F.col(column)), "\n")).alias("line"))
        level = t.heading_level(F.col("line"))
        return lines.select("unit", level.alias("level")).where("level > 0").groupBy("unit", "level").agg(F.count("*").alias(name))

    both = counted("source_md", "src").join(counted("target_md", "tgt"), ["unit", "level"], "full_outer").na.fill(0, ["src", "tgt"])
    return both.where("src <> tgt")


def table_shapes(docs: DataFrame) -> DataFrame:
    """unit, place, src, tgt: the number of pipe tables (place 0), else the tables whose shape differs, by position."""
    d = docs.select("unit", tables(F.col("source_md")).alias("s"), tables(F.col("target_md")).alias("g"))
    count = d.where(F.size("s") != F.size("g")).select("unit", F.lit(0).cast("long").alias("place"), F.size("s").cast("string").alias("src"), F.size("g").cast("string").alias("tgt"))
    shape = lambda x: F.concat_ws("x", x["rows"].cast("string"), x["cols"].cast("string"))
    each = d.where(F.size("s") == F.size("g")).select("unit", F.posexplode(F.arrays_zip("s", "g")).alias("at", "p")).select("unit", (F.col("at") + 1).cast("long").alias("place"), shape(F.col("p.s")).alias("src"), shape(F.col("p.g")).alias("tgt"))
    return count.union(each.where("src <> tgt"))


def summary(findings: DataFrame) -> DataFrame:
    """check, total, blocking, advisory."""
    return findings.groupBy("check").agg(F.count("*").alias("total"), F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("advisory"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Reasons in the order in which the first that holds is given; ``ok`` when none does.
RELEASE = (
    ("terminology_open", "terminology_open > 0"),
    ("glossary_conflict_open", "conflicts_open > 0"),
    ("structure_open", "structure_open > 0"),
    ("review_inconsistent", "review_inconsistent > 0"),
    ("review_unknown", "review_unknown > 0"),
    ("unresolved_confirmed", "CASE WHEN contract IN ('v2', 'legacy') THEN review_open > 0 ELSE confirmed > patched END"),
    ("notes_open", "notes_open > 0"),
    ("notes_review_open", "notes_review_open > 0"),
    ("audit_failed", "NOT audit_ok"),
    ("catalog_open", "catalog_open > 0"),
    ("provenance_incomplete", "coalesce(coverage, 1.0) < 0.9999 OR provenance_errors > 0"),
    ("epubcheck_not_run", "NOT check_ran"),
    ("epubcheck_errors", "coalesce(check_code, 1) <> 0 OR check_errors > 0"),
)
RELEASE_SQL = "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in RELEASE) + " ELSE 'ok' END"


def release(facts: DataFrame) -> DataFrame:
    """work, reason, released."""
    return facts.select("work", F.expr(RELEASE_SQL).alias("reason")).withColumn("released", F.col("reason") == "ok")


def calibrate_priority(tasks: DataFrame) -> DataFrame:
    """work, task: the applicable task of the highest priority (smallest number)."""
    return tasks.where("applicable").groupBy("work").agg(F.min_by("task", "priority").alias("task"))


def carried_units(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new set of units with the status that known ones had; units that are gone are marked."""
    both = new.join(old.withColumnRenamed("status", "was"), ["work", "unit"], "full_outer")
    return both.select("work", "unit", F.when(F.col("status").isNull(), "gone").otherwise(F.coalesce("was", "status")).alias("status"))


def duplicate_units(units: DataFrame) -> DataFrame:
    """work, unit: units whose text, white space apart, another unit of the work has too."""
    w = Window.partitionBy("work", "digest")
    d = units.select("work", "unit", F.sha2(t.without_blanks(F.col("text")).cast("binary"), 256).alias("digest"))
    return d.withColumn("n", F.count("*").over(w)).where("n > 1").select("work", "unit", "n")
