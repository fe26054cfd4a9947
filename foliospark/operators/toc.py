"""Tables of contents and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions.udfs import nfkc, parse_index_line

#: A label, leaders or wide space, a page. Fixed form.
LABEL_PAGE = r"^(.*?\S)(?:[ \t]*[.．·…]{2,}[ \t]*|[ \t]{2,}|\t)([0-9]{1,4}|[ivxlcdm]{1,8})$"


def label_key(x):
    return t.toc_label(nfkc(F.coalesce(x, F.lit(""))))


def printed_entries(lines: DataFrame) -> DataFrame:
    """work, line, label, page: printed entries of lines (work, line, text). A page alone on a line belongs to the entry before it, where that has none."""
    l = lines.select("work", "line", F.trim("text").alias("text")).where("text <> '' and not startswith(text, '#')")
    l = l.withColumn("alone", F.col("text").rlike(r"(?i)^(?:[0-9]{1,4}|[ivxlcdm]{1,8})$"))
    l = l.withColumn("label", F.when(F.col("text").rlike(LABEL_PAGE), F.trim(F.regexp_extract("text", LABEL_PAGE, 1))).otherwise(F.col("text")))
    l = l.withColumn("page", F.nullif(F.regexp_extract("text", LABEL_PAGE, 2), F.lit("")))
    order = Window.partitionBy("work").orderBy("line")
    l = l.withColumn("entry", F.sum((~F.col("alone")).cast("int")).over(order))
    first_alone = F.min_by(F.when(F.col("alone"), F.col("text")), F.when(F.col("alone"), F.col("line")))
    e = l.groupBy("work", "entry").agg(F.max(F.when(~F.col("alone"), F.struct("line", "label", "page"))).alias("e"), first_alone.alias("extra")).where("e is not null")
    return e.select("work", "e.line", "e.label", F.coalesce("e.page", "extra").alias("page"))


def diff(printed: DataFrame, nav: DataFrame) -> DataFrame:
    """work, side, place, label, match: printed entries are matched, ambiguous or printed_only by the navigation of their work; navigation entries not matched by a single one are nav_only."""
    p = printed.withColumn("key", label_key(F.col("label")))
    n = nav.withColumn("key", label_key(F.col("label")))
    hits = n.where("key <> ''").groupBy("work", "key").agg(F.count("*").alias("hits"))
    both = p.join(hits, ["work", "key"], "left")
    match = F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("printed_only")
    single = both.where("hits = 1").select("work", "key").distinct()
    left = both.select("work", F.lit("printed").alias("side"), F.col("line").alias("place"), "label", match.alias("match"))
    right = n.join(single, ["work", "key"], "left_anti").select("work", F.lit("nav").alias("side"), F.col("place"), "label", F.lit("nav_only").alias("match"))
    return left.union(right)


#: Characters of the windows that keys which hold one another must share; shorter keys match by equality alone.
WINDOW = 4


def windows(key) -> Column:
    """The different windows of a key; none for a key that is shorter."""
    n = F.char_length(key) - WINDOW + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(key, i, F.lit(WINDOW))))


def held_keys(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """work, key, other: keys of ``inner`` (work, key) and those of ``outer`` (work, key) that hold them.

    A substring index: a key that another holds shares all of its windows with it, so it's looked up under its rarest one
    in the work alone; only these pairs meet, and containment is verified. A key shorter than a window is held by none."""
    spread = outer.select("work", F.col("key").alias("other"), F.explode(windows(F.col("key"))).alias("window"))
    often = spread.groupBy("work", "window").agg(F.count("*").alias("n"))
    wanted = inner.select("work", "key", F.explode(windows(F.col("key"))).alias("window")).join(often, ["work", "window"], "left")
    # a window that no other key has says that none holds this one
    rare = wanted.groupBy("work", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "window")).alias("w")).where("w.n > 0").select("work", "key", F.col("w.window").alias("window"))
    return rare.join(spread, ["work", "window"]).where(F.contains("other", F.col("key"))).select("work", "key", "other")


def missing_titles(titles: DataFrame, labels: DataFrame) -> DataFrame:
    """work, title of source entries that no unit's label of the work matches: by equal keys, or by one key of at least ``WINDOW`` characters inside the other."""
    a = titles.select("work", "title", t.title_key(nfkc("title")).alias("key"))
    b = labels.select("work", t.title_key(nfkc("label")).alias("key")).where("key <> ''").distinct()
    rest = a.join(b, ["work", "key"], "left_anti").where("key <> ''")
    keys = rest.select("work", "key").distinct()
    near = held_keys(keys, b).select("work", "key").union(held_keys(b, keys).select("work", F.col("other").alias("key"))).distinct()
    return rest.join(near, ["work", "key"], "left_anti").select("work", "title")


def index_entries(lines: DataFrame) -> DataFrame:
    """work, unit, line, label, refs (as text) and unresolved: entries of index lines; a reference-free entry is unresolved."""
    e = lines.select("work", "unit", "line", parse_index_line(F.col("text")).alias("e")).where("e is not null")
    return e.select("work", "unit", "line", "e.label", F.array_join("e.refs", ";").alias("refs"), (F.size("e.refs") == 0).alias("unresolved"))


def index_pages(entries: DataFrame) -> DataFrame:
    """work, unit, line, label, page: the pages each entry refers to, ranges spread out."""
    ref = F.explode(F.split("refs", ";"))
    start = F.regexp_extract("ref", r"^(\d+)", 1).cast("long")
    e = entries.where("refs <> ''").select("work", "unit", "line", "label", ref.alias("ref")).withColumn("a", start).withColumn("b", t.range_end(F.col("ref")))
    return e.select("work", "unit", "line", "label", F.explode(F.when(F.col("b") >= F.col("a"), F.sequence("a", "b")).otherwise(F.array("a"))).alias("page"))


def index_orphans(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Index pages that the work doesn't have; pages: work, page."""
    return index_pages(entries).join(pages, ["work", "page"], "left_anti").select("work", "unit", "line", "label", "page")
