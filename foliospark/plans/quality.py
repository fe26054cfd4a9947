"""Imports and releases with the checks run on the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import audit as a, checks as c, notes_audit as n, quality as q
from foliospark.operators.evidence import IMPORT_BLOCKS
from foliospark.plans.gate import FINDINGS
from foliospark.plans.package import AUDIT
from foliospark.plans.registry import query
from foliospark.sources.adapters import gate_tables, package_members

HARD = ", ".join(f"'{x}'" for x in IMPORT_BLOCKS)


@query(f"""WITH {FINDINGS}, n AS (SELECT unit, count(*) AS n_rows FROM rows_ GROUP BY unit), f AS (SELECT unit, count_if(hard) AS errors, count_if(NOT hard) AS warnings FROM (SELECT unit, blocking AND ("check" IN ({HARD}) OR ("check" = 'fidelity' AND detail = 'row')) AS hard FROM findings) GROUP BY unit)
SELECT u.unit, CASE WHEN n_rows IS NULL THEN 'pending' WHEN u.unit % 4 = 1 THEN 'skipped' WHEN coalesce(errors, 0) > 0 THEN 'failed' ELSE 'imported' END AS outcome, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM gate_units u LEFT JOIN n USING (unit) LEFT JOIN f USING (unit)""")
def import_batch(spark, d):
    """A batch of all units, of which every fourth is there already with the same rows."""
    tables = gate_tables(spark, d)
    return q.imported(tables, q.rows_digests(tables["rows"]).where("unit % 4 = 1"))


#: A work is a package and the conversations that it stands for; its documents' notes are unregistered, as of works that have none.
@query(f"""WITH gated AS (SELECT 'p' || (unit % 40) AS work, "check", blocking FROM (WITH {FINDINGS} SELECT unit, "check", blocking FROM findings)), units AS (WITH {FINDINGS} SELECT DISTINCT 'p' || (unit % 40) AS work FROM gate_units),
audited AS (SELECT work, count_if(starts_with(code, 'E_')) AS errors FROM (WITH {AUDIT}) GROUP BY work), noted AS (SELECT 'p' || (page_id % 40) AS work, page_id % 12 AS id, count(*) AS n FROM pages WHERE html IS NOT NULL AND page_id % 12 IN (6, 7) GROUP BY ALL), open AS (SELECT work, 1 + sum(n - 1) AS notes_open FROM noted GROUP BY work),
g AS (SELECT u.work, count_if("check" = 'terminology' AND blocking) AS terminology_open, count_if(blocking AND "check" NOT LIKE 'terminology%') AS structure_open, count_if(NOT blocking) AS advisory FROM units u LEFT JOIN gated x ON x.work = u.work GROUP BY u.work),
r AS (SELECT g.*, CAST(coalesce(o.notes_open, 0) AS BIGINT) AS notes_open, coalesce(errors, 0) AS audit_errors, 0::BIGINT AS provenance_errors FROM g LEFT JOIN open o USING (work) LEFT JOIN audited USING (work)),
s AS (SELECT *, CASE WHEN terminology_open > 0 THEN 'terminology_open' WHEN structure_open > 0 THEN 'structure_open' WHEN notes_open > 0 THEN 'notes_open' WHEN audit_errors > 0 THEN 'audit_failed' ELSE 'ok' END AS reason FROM r) SELECT *, reason = 'ok' AS released FROM s""")
def release_packages(spark, d):
    """The release of each package from the gate, the audit of the package and the audit of its notes, all run here."""
    tables, members = gate_tables(spark, d), package_members(spark, d)
    works = tables["units"].select(F.concat(F.lit("p"), F.col("unit") % 40).alias("work"), "unit")
    audited = a.audit(members).where("code <> 'E_XHTML_XML'")
    docs = members.where("path like '%.xhtml'").select("work", "path", F.col("body").cast("string").alias("html"))
    empty = lambda columns: spark.createDataFrame([], columns)
    inventories = works.select("work", F.lit("none").alias("inventory")).distinct()
    notes = n.audited_notes(inventories, empty("work string, ref_id string, note_id string"), empty("work string, note_id string, source_markdown string, orphan_ok boolean"), empty("work string, note_id string, target_markdown string"), members.select("work", "path"), docs, empty("work string, ref string, member string"))
    return q.released(works, c.unit_flags(**tables), audited, notes.join(works.select("work").distinct(), "work", "left_semi"), empty("work string, code string"))
