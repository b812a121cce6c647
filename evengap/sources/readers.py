"""Readers of raw event files, static tables and stage tables."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.operators.enrich import union_all

# Types of the raw event columns. Line and route ids are text ("185H" occurs).
EVENT_TYPES = {
    "date": "int", "LineNumber": "string", "route_id": "string", "TransportMode": "string", "direction_id": "int",
    "trip_id": "bigint", "VehicleID": "bigint", "shape_id": "string", "stop_sequence": "int",
    "dist_traveled": "double", "previous_stop_id": "bigint", "observed_stop_id": "bigint",
    "scheduled_arrival_time_sfm": "bigint", "observed_arrival_time_sfm": "bigint", "observed_arrival_delay": "bigint",
    "observed_arrival_uncertainty": "int", "scheduled_departure_time_sfm": "bigint",
    "observed_departure_time_sfm": "bigint", "observed_departure_delay": "bigint",
    "observed_departure_uncertainty": "int", "tripupdates_and_gtfs_not_merged_within_service_id": "int",
    "tripupdates_not_merged_with_stoptimes_or_trip": "int",
}

ARROW_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
BLOCK = 1 << 16


def _names(line: str, sep: str) -> tuple[str, ...]:
    return tuple(n.strip().strip('"') for n in line.lstrip("\ufeff").split(sep))


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, ...]:
    """Column names of one file: the first line, read without scanning the rest."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return _names(first[0][0], sep) if first else ()


def _files_by_header(spark: SparkSession, glob: str | list[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header: one job over the paths opens every file and reads as far as its first line.

    Files without any line have no header. Paths and headers reach the driver, which lists the files for any scan
    anyhow. On file systems that pyarrow does not know each file's first line costs a small job; naming ``columns``
    saves them.
    """
    def first_lines(batches):  # local, so that workers need not have this package
        for batch in batches:
            lines = []
            for uri in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                with system.open_input_stream(inner, compression="detect") as file:
                    head = b""
                    while not (text := head.lstrip()) or b"\n" not in text:
                        if not (block := file.read(BLOCK)):
                            break
                        head += block
                lines.append(text.split(b"\n")[0].decode() if (text := head.lstrip()) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["path", "line"])

    paths = spark.read.text(glob).inputFiles()
    if all(p.split(":", 1)[0] in ARROW_SCHEMES for p in paths):
        table = spark.createDataFrame([(p,) for p in paths], "path string")
        spread = table.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
        found = spread.mapInArrow(first_lines, "path string, line string").where("line IS NOT NULL").collect()
        heads = [(path, _names(line, sep)) for path, line in found]
    else:
        heads = [(path, _header(spark, unquote(path), sep)) for path in paths]
    files: dict[tuple[str, ...], list[str]] = {}
    for path, names in sorted(heads):
        if names:
            files.setdefault(names, []).append(unquote(path))
    return files


def read_events(spark: SparkSession, glob: str | list[str], types: dict[str, str] | None = None, sep: str = ",",
                partitions: int | None = None, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Read CSV files (plain or gzip) whose columns may differ in order and number; union by name.

    A schema on a CSV reader binds by position, so every file is read with the
    columns of its own header as text and cast by name. One job finds the headers, the
    first line of every file that is not blank, and files with equal headers share one scan. ``columns`` names the columns of
    all files in their order and saves that job; then and otherwise the scan
    checks every file's header and fails where it differs. A value that does not
    fit its type becomes null, or ends the read if ``strict``. A gzip file is one
    task whatever its size; ``partitions`` spreads the rows afterwards.
    """
    types = types or EVENT_TYPES
    if columns is not None:
        files = {tuple(columns): glob}
    else:
        files = _files_by_header(spark, glob, sep) if glob else {}
    if not files:
        raise FileNotFoundError(f"no file with a header: {glob}")
    cast = "cast" if strict else "try_cast"
    frames = []
    for names, group in files.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.csv(group, schema=schema, header=True, sep=sep, enforceSchema=False)
        frames.append(raw.select(*[F.expr(f"{cast}(`{n}` AS {types[n]})").alias(n) if n in types else F.col(n)
                                   for n in names]))
    df = union_all(*frames)
    return df.repartition(partitions) if partitions else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_static(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Read a small CSV table with a header. Without a schema the types are inferred."""
    if schema is None:
        return spark.read.csv(path, header=True, sep=sep, inferSchema=True)
    names = _header(spark, path, sep)
    raw = spark.read.csv(path, header=True, sep=sep,
                         schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    wanted = T.StructType.fromDDL(schema)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
