"""Writers of stage tables, the trial ledger and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a stage table as Parquet; later reads prune on ``partition_by``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_clustered(df: DataFrame, path: str, table: str, keys: Sequence[str], order: Sequence[str] = (),
                    buckets: int = 200) -> DataFrame:
    """Write a stage table in buckets of its window keys and open it; see :func:`open_clustered`.

    The rows are shuffled by the keys once, here, and a bucket is one file, in the order of keys and ``order``. A group
    is never split, so keys whose largest group does not fit a task call for more keys, not for more buckets; choose
    ``buckets`` so that a file has some hundred megabytes, as a bucket is read by one task. Null keys are a group.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.mode("overwrite").format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_clustered(spark: SparkSession, path: str, table: str, keys: Sequence[str], order: Sequence[str] = (),
                   buckets: int = 200) -> DataFrame:
    """Open a stage that another session wrote in buckets, under the same keys, order and number of buckets.

    Grouping, windows and joins on the keys (or more columns) then need no shuffle.
    """
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({quoted(keys)}) "
              f"SORTED BY ({quoted([*keys, *order])}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def append_results(df: DataFrame, path: str) -> None:
    """Add finished trials to the ledger, so that a run can be taken up again."""
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str,
                 keys: Sequence[str] = ("model", "k", "name", "metric")) -> DataFrame:
    """The ledger with one row per trial: of rows with equal keys (null equals null) the one written last.

    A trial that was retried, or run by two drivers, counts once. Rows of one file are ordered by their values.
    """
    ledger = spark.read.parquet(path)
    written = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.struct(*ledger.columns))
    last = ledger.groupBy(*keys).agg(F.max_by(F.struct(*ledger.columns), written).alias("__row"))
    return last.select(*[F.col("__row")[c].alias(c) for c in ledger.columns])


def compact_results(spark: SparkSession, path: str, target: str,
                    keys: Sequence[str] = ("model", "k", "name", "metric")) -> None:
    """Write the trials of a ledger of many small files as one file of a new ledger; the old one is left as it is."""
    read_results(spark, path, keys).coalesce(1).write.mode("errorifexists").parquet(target)


def pending(configs: DataFrame, ledger: DataFrame | str, keys: Sequence[str] = ("model", "k", "name")) -> DataFrame:
    """Configurations that the ledger has no result for. A ledger path that does not exist yet is empty."""
    if isinstance(ledger, str):
        try:
            ledger = configs.sparkSession.read.parquet(ledger)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return configs
    return configs.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def results_wide(df: DataFrame, metric: str, rows: str = "k", columns: str = "model",
                 values: Sequence | None = None) -> DataFrame:
    """One row per horizon and one column per model. Naming the models saves a pass to find them."""
    grouped = df.groupBy(rows)
    pivoted = grouped.pivot(columns, list(values)) if values is not None else grouped.pivot(columns)
    return pivoted.agg(F.max(metric))


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
