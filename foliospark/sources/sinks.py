"""Sinks: tables of fixed columns, replaced whole or appended to without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.terms import new_conflicts
from foliospark.sources.readers import GLOSSARY


def save_align(rows: DataFrame, path: str) -> None:
    rows.select("seq", "src", "tgt", "note", "note_id").write.mode("overwrite").json(path)


def save_glossary(entries: DataFrame, path: str) -> None:
    flat = entries.withColumn("aliases", F.array_join("aliases", "|")).select(*GLOSSARY)
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_conflicts(standing: DataFrame, proposed: DataFrame, path: str, keys=("source", "existing_target", "proposed_target")) -> int:
    """Appends what isn't there yet; the number of new rows."""
    fresh = new_conflicts(standing, proposed, list(keys)).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def save_findings(findings: DataFrame, path: str) -> None:
    """By work, so that a reader of one work reads its files alone."""
    findings.write.mode("overwrite").partitionBy("work").json(path)


def save_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("unit").parquet(path)


def markdown_table(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row, md: the rows as a pipe table in order; for reports, which are short."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("md"))


def replaced(df: DataFrame, path: str, kind: str = "json", **options) -> None:
    """The table at ``path`` replaced whole or not at all: written beside it, then renamed into its place.

    A reader sees the old table or the new one, and a failure before the renaming leaves the old one. What Spark's commit
    protocol gives a single job - no file of a failed task is seen - is kept; its overwrite deletes before it writes, which
    this doesn't."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(fresh)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = make(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, make(old))
    files.rename(make(fresh), target)
    files.delete(make(old), True)


def save_store(store: DataFrame, path: str) -> None:
    """The term store as CSV, aliases and books joined by bars, replaced whole."""
    flat = store.withColumn("aliases", F.array_join("aliases", "|"))
    flat = flat.withColumn("books", F.array_join("books", "|")) if "books" in flat.columns else flat
    replaced(flat, path, "csv", header=True, escape='"')


def facts_report(facts: DataFrame) -> DataFrame:
    """work, md: the facts of a work's units (work, unit, chars, words, paragraphs, sentences) as a short report with its totals; reports are short, a work's units are held."""
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", number("unit"), *[number(c) for c in ("chars", "words", "paragraphs", "sentences")]), F.lit(" |"))
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("chars", "words", "sentences")]
    whole = facts.groupBy("work").agg(F.count("*").alias("n"), *sums, F.array_sort(F.collect_list(F.struct("unit", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("# "), F.col("work"), F.lit("\n\n- units: "), number("n"), F.lit(", chars: "), number("sum_chars"), F.lit(", words: "), number("sum_words"), F.lit(", sentences: "), number("sum_sentences"), F.lit("\n\n| unit | chars | words | paragraphs | sentences |\n|---|---|---|---|---|\n"))
    return whole.select("work", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("md"))
