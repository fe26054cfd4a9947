"""The canonical tables as temporary views, for queries in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliospark.session import read
from foliospark.sources import adapters

TABLES = ("documents", "conversations", "pages", "benchmark", "labels", "events")


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Registers units, lines, aligned and the raw tables; the names."""
    views = {"units": adapters.units, "lines": adapters.lines, "aligned": adapters.aligned}
    for name, make in views.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    for name in TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return [*views, *TABLES]
