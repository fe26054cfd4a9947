"""Readers of the working files. Schemas are explicit; a reader either coerces (unknown values become defaults) or checks a contract and gives the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t

# Fixed values of the enumerations.
TYPES = ("person", "place", "org", "term", "work", "title", "event", "concept", "abbr", "style", "other")
STATES = ("seed", "candidate", "confirmed", "conflict")
GENDERS = ("", "m", "f", "n")
ALIGN = "seq long, src string, tgt string, note string, note_id string"
GLOSSARY = ("source", "target", "type", "aliases", "gender", "reading", "status", "note")
STORE = (*GLOSSARY, "src_lang", "tgt_lang", "book")
CATEGORIES = {"人名": "person", "地名": "place", "机构": "org", "书名": "work", "事件": "event", "概念": "concept"}


def align_rows(spark: SparkSession, path: str) -> DataFrame:
    """Aligned sentences, with the file they come from."""
    return spark.read.schema(ALIGN).json(path).withColumn("unit", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.jsonl?)?$", 1))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _filled(df: DataFrame, columns) -> DataFrame:
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def glossary(spark: SparkSession, path: str, columns=GLOSSARY) -> DataFrame:
    """Entries with a source; unknown types, states and genders become term, seed and none; aliases are split at pipes."""
    df = _filled(_csv(spark, path), columns).where("source <> ''")
    known = lambda c, values, default: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(default)
    df = df.withColumn("type", known("type", TYPES, "term")).withColumn("status", known("status", STATES, "seed")).withColumn("gender", known("gender", GENDERS, ""))
    return df.withColumn("aliases", F.filter(F.transform(F.split("aliases", r"\|"), F.trim), lambda a: a != ""))


def term_store(spark: SparkSession, path: str) -> DataFrame:
    return glossary(spark, path, STORE)


def legacy_glossary(spark: SparkSession, path: str) -> DataFrame:
    """The older form with a category instead of a type."""
    df = _filled(_csv(spark, path), ("category", "source", "target", "note")).where("source <> ''")
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return df.select("source", "target", F.coalesce(F.try_element_at(kinds, F.col("category")), F.lit("term")).alias("type"), "note")


def exemptions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): a unit, a source and a reason each; a row with a place needs a digest and evidence."""
    df = _filled(_csv(spark, path), ("unit", "source", "reason", "seq", "note_id", "occurrence", "text_sha256", "evidence")).withColumn("row", F.monotonically_increasing_id())
    placed = (F.col("seq") != "") | (F.col("note_id") != "")
    number = lambda c: (F.col(c) == "") | F.coalesce(F.expr(f"try_cast({c} AS INT)") > 0, F.lit(False))
    wrong = F.array_compact(F.array(*[F.when(F.col(c) == "", f"{c}_missing") for c in ("unit", "source", "reason")], F.when(~number("seq"), "seq_number"), F.when(~number("occurrence"), "occurrence_number"), F.when(placed & ~F.col("text_sha256").rlike("^[0-9a-f]{64}$"), "digest"), F.when(placed & (F.col("evidence") == ""), "evidence_missing")))
    checked = df.withColumn("wrong", wrong)
    return checked.where(F.size("wrong") == 0).drop("wrong", "row"), checked.select("row", F.explode("wrong").alias("code"))


def json_lines(spark: SparkSession, path: str, schema: str, *, strict=False) -> DataFrame:
    """Rows of JSON lines; bad lines fail a strict read and are passed over else."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("row")).where("row is not null and row._bad is null").select("row.*").drop("_bad")


def conflicts(spark: SparkSession, path: str) -> DataFrame:
    """Conflicts, the first of each source and proposal in file order."""
    df = json_lines(spark, path, "source string, existing_target string, proposed_target string, type string, status string").withColumn("at", F.monotonically_increasing_id())
    n = F.row_number().over(Window.partitionBy("source", "proposed_target").orderBy("at"))
    return df.withColumn("n", n).where("n = 1").drop("n", "at")


def events(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "ts string, event string, data string")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page file, blocks nested."""
    block = "struct<type:string,text:string,bbox:array<double>,font_size:double,lines:array<struct<text:string,bbox:array<double>,size:double>>>"
    return spark.read.schema(f"page_idx long, rtl boolean, blocks array<{block}>").option("multiLine", True).json(path)


def text_units(docs: DataFrame) -> DataFrame:
    """work, unit, title, body: a document cut at its headings; what stands before the first is a unit without a title.

    Takes work, text. A running count of headings numbers the units; fenced code holds no headings."""
    lines = docs.select("work", F.posexplode(F.split("text", r"\R")).alias("at", "line"))
    order = Window.partitionBy("work").orderBy("at")
    fence = F.sum(F.col("line").rlike(r"^ {0,3}(?:```|~~~)").cast("int")).over(order) % 2
    heading = (t.heading_level(F.col("line")) > 0) | F.col("line").rlike(r"^\s*(?:第[一二三四五六七八九十百0-9]+[章节回部篇]|(?i:chapter)\s+\S+)")
    l = lines.withColumn("fenced", fence == 1).withColumn("opens", heading & ~F.col("fenced"))
    l = l.withColumn("unit", F.sum(F.col("opens").cast("long")).over(order))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("at", "line"))))
    whole = l.groupBy("work", "unit").agg(F.max(F.when(F.col("opens"), F.trim(F.regexp_replace("line", r"^#{1,6}[ \t]+", "")))).alias("title"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))
    return whole.select("work", "unit", F.coalesce("title", F.lit("")).alias("title"), t.stripped(F.col("body")).alias("body")).where("title <> '' or body <> ''")


def merged_batches(parts: DataFrame) -> DataFrame:
    """Items of a work's batches (work, batch, page) with pages numbered through: each batch is offset by the pages before it."""
    sizes = parts.groupBy("work", "batch").agg(F.max("n_pages").alias("n_pages"))
    before = Window.partitionBy("work").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_pages").over(before), F.lit(0))
    return parts.drop("n_pages").join(sizes.withColumn("offset", offset), ["work", "batch"]).withColumn("page", F.col("page") + F.col("offset")).drop("offset", "n_pages")
