"""Packaged HTML: facts of a page, links, headings, residue; members of a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, title, language, og_title: from the first 200,000 characters."""
    head = F.substr(t.text_of("html"), F.lit(1), F.lit(200_000))
    return pages.select(
        "page_id", F.trim(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.trim(F.regexp_extract(head, "(?i)<html[^>]*\\blang=[\"']([^\"']+)[\"']", 1)).alias("language"),
        F.trim(F.regexp_extract(head, "(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)).alias("og_title"),
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, scope: the references of anchors in order; fragment, local, remote or unsafe."""
    found = F.regexp_extract_all(t.text_of("html"), F.lit('(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"'), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("place", "href"))
    low = F.lower(F.trim("href"))
    scope = F.when(low.startswith("#"), "fragment").when(low.rlike("^(?:javascript|data|vbscript):"), "unsafe").when(low.rlike("^(?:[a-z][a-z0-9+.-]*:)?//|^mailto:"), "remote").otherwise("local")
    return each.select("page_id", F.col("place").cast("long").alias("place"), "href", scope.alias("scope"))


def heading_entries(pages: DataFrame) -> DataFrame:
    """page_id, place, level, text: headings in order, tags removed."""
    marks = F.regexp_extract_all(t.text_of("html"), F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    each = pages.select("page_id", F.posexplode(marks).alias("place", "mark"))
    return each.select("page_id", F.col("place").cast("long").alias("place"), F.regexp_extract("mark", r"(?i)^<h([1-6])", 1).cast("long").alias("level"), F.trim(F.regexp_replace("mark", "<[^>]*>", "")).alias("text"))


def heading_skips(entries: DataFrame, key="page_id") -> DataFrame:
    """key, place, level, before: a page's first heading that is more than one level below the one before it."""
    order = Window.partitionBy(key).orderBy("place")
    jumps = entries.withColumn("before", F.lag("level").over(order)).where(F.col("level") > F.col("before") + 1)
    return jumps.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "place", "level", "before")


def residue(pages: DataFrame) -> DataFrame:
    """page_id, code: what shouldn't be left in a finished page; one finding a page and code."""
    html = t.text_of("html")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", ""), "<[^>]*>", " ")
    codes = F.array(
        F.when(~html.rlike(r"(?i)<html[^>]*\blang="), "no_lang"), F.when(F.regexp_count(html, F.lit(r"(?i)<h1\b")) != 1, "h1_count"), F.when(bare.rlike(r"(?m)^\s*#{1,6}\s\S"), "atx_residue"), F.when(bare.rlike(r"\[\^[^\]\s]+\]|\{\w+:\d+\}"), "marker_residue"),
        F.when(bare.rlike(r"\*\*[^*\s][^*]*\*\*"), "bold_residue"), F.when(bare.rlike(r"\$[^$\s][^$]*\$"), "math_residue"), F.when(html.rlike(r"(?is)<img\b(?![^>]*\balt=)"), "img_no_alt"), F.when(html.rlike(r"(?i)<img\b[^>]*\bsrc=.https?:"), "img_remote"), F.when(~html.rlike(r"(?i)</html\s*>"), "unclosed"),
    )
    return pages.select("page_id", F.explode(F.array_compact(codes)).alias("code"))


def member_findings(members: DataFrame, refs: DataFrame) -> DataFrame:
    """work, code, path: rules over a package's members (work, path, ord, stored, body) and the references of its documents (work, path, target)."""
    first = members.groupBy("work").agg(F.min_by(F.struct("path", "stored", "body"), "ord").alias("f")).select("work", "f.*")
    parts = [
        first.where("path <> 'mimetype'").select("work", F.lit("mimetype_first").alias("code"), "path"),
        first.where("path = 'mimetype' and not stored").select("work", F.lit("mimetype_stored").alias("code"), "path"),
        first.where("path = 'mimetype' and trim(body) <> 'application/epub+zip'").select("work", F.lit("mimetype_content").alias("code"), "path"),
        members.groupBy("work", "path").count().where("count > 1").select("work", F.lit("path_twice").alias("code"), "path"),
        members.groupBy("work").agg(F.bool_or(F.col("path") == "META-INF/container.xml").alias("has")).where("not has").select("work", F.lit("no_container").alias("code"), F.lit("META-INF/container.xml").alias("path")),
        refs.join(members.select("work", F.col("path").alias("target")).distinct(), ["work", "target"], "left_anti").select("work", F.lit("reference_dangling").alias("code"), "target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reconciled(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Both sides of an ordered reconciliation: missing, extra, moved or matched by place."""
    e, a = expected.select(*key, F.col("place").alias("expected_place")), actual.select(*key, F.col("place").alias("actual_place"))
    code = F.when(F.col("actual_place").isNull(), "missing").when(F.col("expected_place").isNull(), "extra").when(F.col("actual_place") != F.col("expected_place"), "moved").otherwise("matched")
    return e.join(a, key, "full_outer").withColumn("code", code)
