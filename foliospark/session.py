"""Sessions: the package on the executors' path, input tables, and tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers where their path doesn't hold it already."""
    context = spark.sparkContext
    path = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if str(ROOT) not in path and "foliospark.zip" not in {os.path.basename(str(p)) for p in context._python_includes}:
        archive = Path(tempfile.mkdtemp(prefix="foliospark-")) / "foliospark.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((ROOT / "foliospark").rglob("*.py")):
                out.write(file, file.relative_to(ROOT))
        context.addPyFile(str(archive))
    return spark


#: Bytes of a batch of rows that goes to Python.
BATCH = "4m"


def in_small_batches(spark: SparkSession) -> None:
    """Holds what goes to Python at once at ``BATCH`` bytes, unless the session sets a limit of its own. A batch stands in memory on either side, in each task, and Spark's own limit is a number of rows, however long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def read(spark: SparkSession, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: This process's own folder inside the shared one.
SESSION = f"foliospark-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where it is unset a local session gets a temporary one, removed at the end; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no more than the reading of a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{SESSION}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes the tables that this process has written. Results that read them must have been used or written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{SESSION}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
