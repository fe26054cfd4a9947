"""Reviews: lineage, effective issues, convergence, archives."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import version_key
from foliospark.session import written

WAY = ["work", "review", "ancestor"]


def ancestors(reviews: DataFrame) -> DataFrame:
    """work, review, ancestor: the closure over known parents; a cycle ends where it meets itself.

    A round lengthens all ways found so far by ways of exactly 2, 4, 8 ... steps, so that the rounds are as many as the
    logarithm of the longest way. A work rests when a round finds nothing new in it. Every round is written out, and
    meets on work and review, so that a work isn't one group."""
    known = reviews.select("work", F.col("review").alias("ancestor"))
    edges = reviews.select("work", "review", F.explode("parents").alias("ancestor")).join(known, ["work", "ancestor"], "left_semi").select(*WAY).distinct()
    found = leap = written(edges, "lineage")
    parts = [found]
    while True:
        on = leap.select("work", F.col("review").alias("ancestor"), F.col("ancestor").alias("further"))
        after = lambda ways: ways.join(on, ["work", "ancestor"]).select("work", "review", F.col("further").alias("ancestor")).distinct()  # noqa: B023, E731
        new = written(after(found).join(found, WAY, "left_anti"), "lineage")
        if new.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(new)
        going = new.select("work").distinct()
        leap = written(after(leap.join(going, "work", "left_semi")), "lineage")
        found = written(found.join(going, "work", "left_semi").union(new), "lineage")


def lineage_findings(reviews: DataFrame) -> DataFrame:
    """work, review, code, parent: parents that are the review itself, unknown, or later."""
    edges = reviews.select("work", "review", F.explode("parents").alias("parent"))
    known = reviews.select("work", F.col("review").alias("parent"), F.lit(True).alias("known")).distinct()
    e = edges.join(known, ["work", "parent"], "left")
    code = F.when(F.col("parent") == F.col("review"), "parent_self").when(F.col("known").isNull(), "parent_missing").when(F.col("parent") > F.col("review"), "parent_not_earlier")
    return e.select("work", "review", code.alias("code"), "parent").where("code is not null")


LEDGER = "work string, issue string, status string, origin string, note string"


def effective_issues(reviews: DataFrame, issues: DataFrame, dispositions: DataFrame) -> DataFrame:
    """work, issue, status, origin, note: what stands after all reviews of a work, in their order.

    Reviews: work, review, scope, units, parents, digests (map); issues: work, review, issue, unit; dispositions: work,
    review, issue, status, closed_by, evidence. A review that covers an open issue's unit must dispose of it, else the
    issue is unknown. A closure counts with its author and evidence, when the issue's review is an ancestor and the
    inputs are the same; other inputs make the issue unknown. The state passes from review to review, so the reviews of
    one work are folded together; works are independent."""
    up = ancestors(reviews).groupBy("work", "review").agg(F.collect_set("ancestor").alias("ancestors"))
    i = issues.groupBy("work", "review").agg(F.collect_list(F.struct("issue", "unit")).alias("found"))
    c = dispositions.groupBy("work", "review").agg(F.collect_list(F.struct("issue", "status", "closed_by", "evidence")).alias("closed"))
    all_ = reviews.join(up, ["work", "review"], "left").join(i, ["work", "review"], "left").join(c, ["work", "review"], "left")
    digests = F.map_entries("digests").alias("digests")
    all_ = all_.select("work", "review", "scope", "units", digests, "ancestors", "found", "closed")

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["review"])
        inputs = {r["review"]: {x["key"]: x["value"] for x in r["digests"] or []} for r in rows}
        state: dict[str, dict] = {}
        for r in rows:
            given = {x["issue"]: x for x in r["closed"] or []}
            for issue, s in state.items():
                covered = r["scope"] == "full" or s["unit"] in (r["units"] or [])
                if s["status"] not in ("open", "unknown") or not covered:
                    continue
                x = given.get(issue)
                if x is None:
                    s.update(status="unknown", note=f"undisposed:{r['review']}")
                    continue
                if x["status"] not in ("fixed", "rejected", "accepted") or not (x["closed_by"] or "").strip() or not (x["evidence"] or "").strip() or s["origin"] not in (r["ancestors"] or []):
                    continue
                was, now = (inputs[k].get(s["unit"]) or inputs[k].get("*") for k in (s["origin"], r["review"]))
                if was and now and was != now:
                    s.update(status="unknown", note=f"inputs_changed:{r['review']}")
                else:
                    s.update(status=x["status"], note=f"closed:{r['review']}")
            for x in sorted(r["found"] or [], key=lambda x: x["issue"]):
                state[x["issue"]] = {"unit": x["unit"], "status": "open", "origin": r["review"], "note": ""}
        work = rows[0]["work"]
        out = [(work, k, s["status"], s["origin"], s["note"]) for k, s in state.items()]
        return pa.table({n.split()[0]: pa.array([o[j] for o in out], pa.string()) for j, n in enumerate(LEDGER.split(", "))})

    return all_.groupBy("work").applyInArrow(fold, LEDGER)


def convergence(rounds: DataFrame, *, clean=2, fixes=2) -> DataFrame:
    """work, round, termination: the round that ends each work's review and why; the last round and nothing where none does.

    In order: no_progress, when the last three rounds with issues go A, B, A; clean_confirmed, after ``clean`` rounds
    without issues in a row; unresolved_fixes, in a round without issues but with fixes that failed; max_rounds."""
    order = Window.partitionBy("work").orderBy("round")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = rounds.withColumn("n", F.row_number().over(order)).withColumn("bad", F.sum(F.col("has_issues").cast("int")).over(upto))
    df = df.withColumn("streak", F.sum((~F.col("has_issues")).cast("int")).over(Window.partitionBy("work", "bad").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))
    # rounds with issues among themselves: the one before the last looks back over two
    summary = F.coalesce("summary", F.lit(""))
    df = df.withColumn("cycle", F.col("has_issues") & F.coalesce(F.lag(summary, 2).over(Window.partitionBy("work", "has_issues").orderBy("round")) == summary, F.lit(False)))
    ends = F.when(F.col("cycle"), "no_progress").when(F.col("streak") >= clean, "clean_confirmed").when(F.col("unresolved") & ~F.col("has_issues"), "unresolved_fixes").when(F.col("n") >= (fixes + 1) * clean, "max_rounds")
    df = df.withColumn("termination", ends)
    first = df.groupBy("work").agg(F.min(F.when(F.col("termination").isNotNull(), F.struct("round", "termination"))).alias("end"), F.max("round").alias("last"))
    return first.select("work", F.coalesce("end.round", "last").alias("round"), F.coalesce("end.termination", F.lit("")).alias("termination"))


def archive_plan(batches: DataFrame) -> DataFrame:
    """batch, action: batches (batch, book, version, digest) to keep, move, hold or block.

    blocked: the same book and version elsewhere with another digest, in any of its books; hold: no version, or some
    books at their newest version and some not; keep: all of them; move: none of them."""
    b = batches.withColumn("v", version_key(F.coalesce("version", F.lit(""))))
    newest = F.max("v").over(Window.partitionBy("book"))
    digests = F.size(F.collect_set("digest").over(Window.partitionBy("book", "version")))
    b = b.withColumn("newest", F.col("v") == newest).withColumn("clash", (digests > 1) & F.col("v").isNotNull())
    s = b.groupBy("batch").agg(F.bool_or("clash").alias("clash"), F.bool_or(F.col("v").isNull()).alias("bare"), F.bool_and("newest").alias("every"), F.bool_or("newest").alias("some"))
    action = F.when(F.col("clash"), "blocked").when(F.col("bare"), "hold").when(F.col("every"), "keep").when(F.col("some"), "hold").otherwise("move")
    return s.select("batch", action.alias("action"))
