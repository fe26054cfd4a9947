"""The whole of quality assurance: what is imported and what is released, from the checks themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import checks, evidence, gate

#: What a release decision takes as in order where no table says otherwise.
IN_ORDER = dict(conflicts_open=0, review_inconsistent=0, review_unknown=0, review_open=0, contract="v2", confirmed=0, patched=0, notes_review_open=0, catalog_open=0, coverage=1.0, check_ran=True, check_code=0, check_errors=0)


def rows_digests(rows: DataFrame) -> DataFrame:
    """unit, n_rows, digest of a unit's rows (pos, seq, src, tgt), in their order."""
    each = F.struct("pos", F.sha2(F.to_json(F.struct("seq", t.text_of("src").alias("src"), t.text_of("tgt").alias("tgt"))).cast("binary"), 256).alias("x"))
    return rows.groupBy("unit").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda r: r["x"]), ",").cast("binary"), 256).alias("digest"))


def imported(tables: dict[str, DataFrame], standing: DataFrame, **options) -> DataFrame:
    """unit, outcome, errors, warnings of a batch of units: the gate (``checks.unit_flags`` with its ``tables``) runs over the batch, and its findings decide.

    ``standing``: unit, digest of the rows that are there already; a unit whose rows are those is skipped."""
    units = tables["units"].select("unit").join(rows_digests(tables["rows"]), "unit", "left").join(standing.select("unit", F.col("digest").alias("was")), "unit", "left")
    units = units.select("unit", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (~F.coalesce(F.col("digest") == F.col("was"), F.lit(False))).alias("changed"))
    found = checks.unit_flags(**tables, **options)
    reverse = (F.col("check") == "fidelity") & (F.col("detail") == "row")
    return evidence.admission(units, found.select("unit", "check", "blocking", reverse.alias("reverse")))


def released(works: DataFrame, gate_findings: DataFrame, audit: DataFrame, notes: DataFrame, provenance: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """work, terminology_open, structure_open, advisory, notes_open, audit_errors, provenance_errors, reason, released.

    ``works``: work, unit; findings of the gate by unit, of the audits of packages, notes and provenance by work and code.
    ``facts``: work and any columns of ``gate.release`` that other tables know; the rest counts as in order."""
    errors = lambda df, name: df.groupBy("work").agg(F.count_if(F.col("code").startswith("E_")).alias(name))
    told = checks.release_counts(gate_findings, works)
    for df, name in ((notes, "notes_open"), (audit, "audit_errors"), (provenance, "provenance_errors")):
        told = told.join(errors(df, name), "work", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if facts is not None:
        told = told.join(facts, "work", "left")
    kept = told.select("*", (F.col("audit_errors") == 0).alias("audit_ok"), *[F.lit(v).alias(k) for k, v in IN_ORDER.items() if facts is None or k not in facts.columns])
    reason = F.expr(gate.RELEASE_SQL)
    return kept.select("work", "terminology_open", "structure_open", "advisory", "notes_open", "audit_errors", "provenance_errors", reason.alias("reason"), (reason == "ok").alias("released"))
