"""The note graph: notes, references and marks in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import text_of
from foliospark.functions.udfs import chunks, find_note_numbers

STATUSES = ("confirmed", "candidate", "unresolved")


def label_key(label):
    """A positive number's plain form; other labels as they are."""
    return F.when(label.rlike("^[0-9]+$") & (label.cast("decimal(20,0)") > 0), label.cast("decimal(20,0)").cast("string")).otherwise(label)


def findings(df: DataFrame, code: str, entity: str, where) -> DataFrame:
    return df.where(where).select(F.lit(code).alias("code"), F.col(entity).cast("string").alias("entity"))


def graph_violations(notes: DataFrame, refs: DataFrame, units: DataFrame) -> DataFrame:
    """code, entity: what breaks the contract of notes (note_id, scope_id, source_label, source_markdown, n_locations, status, note_type, orphan_ok) and references (ref_id, note_id, unit, scope_id, status)."""
    blank = lambda c: F.trim(text_of(c)) == ""
    out = [
        findings(notes, "note_id_format", "note_id", ~F.coalesce(F.col("note_id").rlike(r"^n-\d{6}$"), F.lit(False))),
        findings(refs, "ref_id_format", "ref_id", ~F.coalesce(F.col("ref_id").rlike(r"^ref-\d{6}$"), F.lit(False))),
        *[findings(notes, f"note_{c}_blank", "note_id", blank(c)) for c in ("scope_id", "source_label", "source_markdown", "note_type")],
        findings(notes, "note_no_location", "note_id", F.coalesce(F.col("n_locations"), F.lit(0)) == 0),
        findings(notes, "note_status", "note_id", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        findings(notes, "note_unresolved", "note_id", F.col("status") == "unresolved"),
        findings(refs, "ref_scope_id_blank", "ref_id", blank("scope_id")),
        findings(refs, "ref_status", "ref_id", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        findings(notes.groupBy("note_id").count(), "note_id_twice", "note_id", "count > 1"),
        findings(refs.groupBy("ref_id").count(), "ref_id_twice", "ref_id", "count > 1"),
        findings(refs.join(notes.select("note_id").distinct(), "note_id", "left_anti"), "ref_note_unknown", "ref_id", F.lit(True)),
        findings(refs.join(units, "unit", "left_anti"), "ref_unit_unknown", "ref_id", F.lit(True)),
    ]
    labels = notes.groupBy(text_of("scope_id").alias("scope"), label_key(F.trim(text_of("source_label"))).alias("label")).count()
    out.append(findings(labels.withColumn("entity", F.concat_ws("/", "scope", "label")), "label_twice", "entity", "count > 1"))
    out.append(findings(notes.where("not coalesce(orphan_ok, false)").join(refs, "note_id", "left_anti"), "note_orphan", "note_id", F.lit(True)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def prose(md):
    """The text outside fenced code."""
    return F.array_join(F.transform(F.filter(chunks(md), lambda c: c["kind"] == "text"), lambda c: c["chunk"]), "\n")


def markers(units: DataFrame) -> DataFrame:
    """unit, place, ref_id: reference marks in the prose of units (unit, md), in order."""
    return units.select("unit", F.posexplode(F.regexp_extract_all(prose(F.col("md")), F.lit(r"\[\^(ref-\d{6})\]"), F.lit(1))).alias("place", "ref_id"))


def marker_balance(units: DataFrame, refs: DataFrame) -> DataFrame:
    """unit, ref_id, code: each reference stands exactly once in its own unit's prose, and nothing else does."""
    found = markers(units).groupBy("unit", "ref_id").agg(F.count("*").alias("found"))
    wanted = refs.select("unit", "ref_id").distinct().withColumn("wanted", F.lit(True))
    there = units.select("unit").withColumn("there", F.lit(True))
    both = wanted.join(found, ["unit", "ref_id"], "full_outer").join(there, "unit", "left")
    code = F.when(F.col("there").isNull(), "unit_missing").when(F.col("found").isNull(), "mark_missing").when(F.col("wanted").isNull(), "mark_unknown").when(F.col("found") != 1, "mark_repeated")
    return both.select("unit", "ref_id", code.alias("code")).where("code is not null")


def translation_violations(source: DataFrame, target: DataFrame, required: DataFrame) -> DataFrame:
    """note_id, code: target notes (note_id, target_markdown) against source notes and those a batch requires."""
    filled = target.where(F.trim(text_of("target_markdown")) != "")
    parts = [
        target.groupBy("note_id").count().where("count > 1").select("note_id", F.lit("repeated").alias("code")),
        target.join(source, "note_id", "left_anti").select("note_id", F.lit("unknown").alias("code")),
        target.join(filled, "note_id", "left_anti").select("note_id", F.lit("blank").alias("code")).distinct(),
        required.join(filled, "note_id", "left_anti").select("note_id", F.lit("missing").alias("code")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def candidates(lines: DataFrame) -> DataFrame:
    """candidate_id, unit, line, kind, label: note candidates of lines (unit, line, text) by four forms. The id is of unit, kind, label, text and occurrence, so lines that move keep theirs."""
    text = F.trim("text")
    kinds = F.flatten(F.array(
        F.transform(find_note_numbers(text, F.lit(False)), lambda n: F.struct(F.lit("marker").alias("kind"), n.cast("string").alias("label"))),
        F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1)), lambda x: ~x.rlike(r"^ref-\d{6}$")), lambda x: F.struct(F.lit("pandoc_ref").alias("kind"), x.alias("label"))),
        F.transform(F.regexp_extract_all(text, F.lit(r"^\[\^([^\]\s]+)\]:"), F.lit(1)), lambda x: F.struct(F.lit("definition").alias("kind"), x.alias("label"))),
        F.transform(F.regexp_extract_all(text, F.lit(r"^(\d{1,3})\s+\S.{7,}$"), F.lit(1)), lambda x: F.struct(F.lit("numbered_paragraph").alias("kind"), x.alias("label"))),
    ))
    each = lines.select("unit", "line", F.substr(text, F.lit(1), F.lit(200)).alias("head"), F.posexplode(kinds).alias("at", "k")).select("unit", "line", "at", "head", "k.kind", "k.label")
    nth = F.row_number().over(Window.partitionBy("unit", "kind", "label", "head").orderBy("line", "at")) - 1
    key = F.concat_ws("|", "unit", "kind", "label", "head", nth.cast("string"))
    return each.select(F.concat(F.lit("c-"), F.substr(F.sha1(key.cast("binary")), F.lit(1), F.lit(10))).alias("candidate_id"), "unit", "line", "kind", "label")


def review(source: DataFrame, target: DataFrame, previous: DataFrame) -> DataFrame:
    """note_id, status: a note's disposition stays while both digests do, else it is stale; open without one, untranslated without a target."""
    joined = source.join(target, "note_id", "left").join(previous, "note_id", "left")
    same = (F.col("src_digest") == F.col("was_src")) & (F.col("tgt_digest") == F.col("was_tgt"))
    status = F.when(F.col("tgt_digest").isNull(), "untranslated").when(F.col("disposition").isNull(), "open").when(same, F.col("disposition")).otherwise("stale")
    return joined.select("note_id", status.alias("status"))


def numbering(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """note_id, host, number: a note is hosted by its first referencing unit; a positive number is its own label, other notes take the smallest numbers of their scope that no label uses, by first reference and id."""
    first = refs.groupBy("note_id").agg(F.min_by("unit", F.struct("unit_ord", "place")).alias("host"), F.min(F.struct("unit_ord", "place")).alias("at"))
    n = notes.join(first, "note_id", "left").withColumn("own", F.when(F.col("source_label").rlike("^[0-9]+$") & (F.col("source_label").cast("long") > 0), F.col("source_label").cast("long")))
    scope = Window.partitionBy("scope_id")
    n = n.withColumn("reserved", F.collect_set("own").over(scope)).withColumn("size", F.count("*").over(scope))
    nth = F.row_number().over(Window.partitionBy("scope_id", F.col("own").isNull()).orderBy(F.col("at").asc_nulls_last(), "note_id"))
    n = n.withColumn("nth", nth)
    free = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("size") + F.size("reserved")), F.col("reserved"))
    return n.select("note_id", "host", F.coalesce("own", F.element_at(free, F.col("nth"))).alias("number"))
