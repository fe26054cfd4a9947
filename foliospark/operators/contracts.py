"""Contracts of working tables as violation rows, and the state of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t


def blank(c: str) -> Column:
    return t.stripped(t.text_of(c)) == ""


def broken(df: DataFrame, entity: str, **rules: Column) -> DataFrame:
    """entity, code: a row for every rule that a row breaks."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return df.select(F.col(entity).cast("string").alias("entity"), F.explode(codes).alias("code"))


def repair_violations(repairs: DataFrame, units: DataFrame) -> DataFrame:
    """Of a repair log (id, unit, kind, before, after, evidence): fields, kinds, and units that exist."""
    r = repairs.join(units.select("unit", F.lit(True).alias("known")).distinct(), "unit", "left")
    return broken(r, "id", unit_missing=blank("unit"), unit_unknown=~blank("unit") & F.col("known").isNull(), kind=~F.coalesce(F.col("kind").isin("hyphen", "wrap", "ocr", "order", "duplicate", "other"), F.lit(False)), evidence_missing=blank("evidence"), unchanged=F.col("before") == F.col("after"))


def style_violations(exemptions: DataFrame, units: DataFrame, styles: DataFrame) -> DataFrame:
    """Of style exemptions (id, unit, pattern, style): a unit and a style that exist, a pattern that isn't empty."""
    s = exemptions.join(units.select("unit", F.lit(True).alias("known")).distinct(), "unit", "left").join(styles.select("style", F.lit(True).alias("styled")).distinct(), "style", "left")
    return broken(s, "id", unit_unknown=F.col("known").isNull(), style_unknown=F.col("styled").isNull(), pattern_missing=blank("pattern"))


def policy_violations(policies: DataFrame) -> DataFrame:
    """Of page-number policies (unit, policy, evidence): a known policy, evidence where pages are produced, one row a unit."""
    p = policies.withColumn("n", F.count("*").over(Window.partitionBy("unit")))
    return broken(p, "unit", policy=~F.coalesce(F.col("policy").isin("source", "product", "none"), F.lit(False)), evidence_missing=(F.col("policy") == "product") & blank("evidence"), repeated=F.col("n") > 1).distinct()


def insert_rows(files: DataFrame) -> DataFrame:
    """id, type, page: inserts of JSON files (path, value), in order; files that don't parse are passed over."""
    x = files.select(F.from_json("value", "id string, type string, source struct<page:long>").alias("r"))
    return x.where("r.id is not null").select("r.id", "r.type", "r.source.page")


def work_states(works: DataFrame, units: DataFrame) -> DataFrame:
    """work, n_units, done, state: of all works, those without units and of another schema too. Unit states rise from pending to built."""
    rank = F.array_position(F.array(*map(F.lit, ("pending", "structured", "aligned", "translated", "reviewed", "audited", "built"))), F.col("status"))
    u = units.withColumn("rank", rank).groupBy("work").agg(F.count("*").alias("n_units"), F.count_if(F.col("rank") >= 5).alias("done"), F.min("rank").alias("least"))
    w = works.join(u, "work", "left").na.fill(0, ["n_units", "done"])
    state = F.when(F.col("schema_version") != 1, "unsupported").when(F.col("n_units") == 0, "empty").when(F.col("least") == 7, "built").when(F.col("done") == F.col("n_units"), "reviewed").otherwise("open")
    return w.select("work", "n_units", "done", state.alias("state"))


def stale_units(units: DataFrame, products: DataFrame) -> DataFrame:
    """work, unit, code: units whose product was made from another text, products without a unit, and units without one."""
    u, p = units.select("work", "unit", F.col("digest").alias("now")), products.select("work", "unit", F.col("digest").alias("was"))
    code = F.when(F.col("now").isNull(), "orphan").when(F.col("was").isNull(), "missing").when(F.col("now") != F.col("was"), "stale")
    return u.join(p, ["work", "unit"], "full_outer").select("work", "unit", code.alias("code")).where("code is not null")


def note_registration(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """work, n_notes, n_refs, n_scopes, n_units: what a register holds."""
    a = notes.groupBy("work").agg(F.count("*").alias("n_notes"), F.countDistinct("scope_id").alias("n_scopes"))
    b = refs.groupBy("work").agg(F.count("*").alias("n_refs"), F.countDistinct("unit").alias("n_units"))
    return a.join(b, "work", "full_outer").na.fill(0)


def required_notes(refs: DataFrame) -> DataFrame:
    """unit, notes: the notes each unit refers to, in order, as text."""
    return refs.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("note_id")), ",").alias("notes"))


def disposition_violations(entries: DataFrame) -> DataFrame:
    """Of review entries (note_id, disposition, reason, signals): a known disposition with a reason; translated contradicts a signal."""
    known = F.coalesce(F.col("disposition").isin("translated", "kept", "retranslate"), F.lit(False))
    return broken(entries, "note_id", disposition=~known, reason_missing=blank("reason"), contradiction=(F.col("disposition") == "translated") & ~blank("signals"))


def quality_ledger(checks: DataFrame) -> DataFrame:
    """check, status: fail where anything failed, else manual where something waits for a person, else pass, unknown without evidence."""
    g = checks.groupBy("check").agg(F.count_if(F.col("result") == "fail").alias("f"), F.count_if(F.col("result") == "manual").alias("m"), F.count_if(F.col("result") == "pass").alias("p"))
    return g.select("check", F.when(F.col("f") > 0, "fail").when(F.col("m") > 0, "manual").when(F.col("p") > 0, "pass").otherwise("unknown").alias("status"))


def folder_digests(files: DataFrame) -> DataFrame:
    """folder, digest: of the files below, by their relative path and content."""
    f = files.withColumn("line", F.concat_ws(":", "path", F.sha2("content", 256)))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n")
    return f.groupBy("folder").agg(F.sha2(ordered.cast("binary"), 256).alias("digest"))
