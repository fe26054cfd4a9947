"""Increments that arrive as a stream: a log that grows by batches, and a store that is merged with each.

Both are written for ``foreachBatch``, which may hand a batch over again after a failure; its id makes that change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEPT_VERSIONS = 2


def _folder(spark: SparkSession, path: str):
    """(path, file system) of the store that Spark itself reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds a batch to the log at ``path``: one folder a batch, replaced whole when the batch comes again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a store, oldest first."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store as its last finished version has it; empty before the first batch."""
    known = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)


def merged(path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that makes ``merge(store, batch)`` the store's next version.

    A version has its batch's number and counts when Spark has marked it as finished, so a batch that comes again is left
    alone, and one that broke off is made again from the version before. The last ``KEPT_VERSIONS`` stay, for readers that
    are at work."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, path)
        if known and known[-1] >= batch_id:
            return
        merge(latest(spark, path, schema), batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for old in known[: 1 - KEPT_VERSIONS]:
            folder, files = _folder(spark, f"{path}/version={old}")
            files.delete(folder, True)

    return write
