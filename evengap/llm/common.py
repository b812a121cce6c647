"""Shared folder, stored tables and small column helpers of this subpackage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a local session without it gets one of its own, a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evengap-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back, so that later steps and retries never redo the work above."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as --py-files would, and bound the rows of a batch of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    files = sorted(PACKAGE.rglob("*.py"))
    name = f"evengap-{hashlib.md5(b''.join(p.read_bytes() for p in files)).hexdigest()}.zip"
    context = spark.sparkContext
    if any(x.endswith(name) for x in context._python_includes):
        return
    path = Path(tempfile.mkdtemp()) / name
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those wanted that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"_{x}" + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken) for x in names]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
