"""Ordered computations over groups, kept whole and balanced when one group is very large.

A plain ``Window`` sends each group to one task. That is right for trips and
stop-days, but nothing promises that one key never holds a large part of the
table. Before a window is built the helpers here look for groups above
``GROUP_ROWS`` rows (an aggregation with map-side combine over the key columns
only, whatever the size of the input, and over the last of them only where the
others leave large groups). Only the rows of those groups take the second route: they are range-partitioned by
(keys, order), so that a large group spans many tasks, numbered through
per-partition counts, and cut into blocks of consecutive rows. Each block gets
copies of as many neighbour rows as the frame can reach, and the windows then
run per block. Results are equal on both routes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP_ROWS = 1_000_000
BROADCAST_ROWS = 100_000

Columns = Callable[[WindowSpec], dict[str, Column]]
LOOK = object()  # "find the large groups yourself"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can read: under ``spark.checkpoint.dir``, which a cluster has to name.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="evengap-")
    return f"{root.rstrip('/')}/evengap-{uuid.uuid4().hex}"


#: Folders that `durable` wrote inside of `passing`, in this thread.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread makes ``durable`` inside are deleted at the end: nothing lazy that reads them may leave."""
    folders: list[str] = []
    token = _FOLDERS.set(folders)
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        for folder in folders:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SWITCH = Lock()
_SWITCHED: dict[str, list] = {}  # session: how many are inside, its own setting


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go at its end, not when the driver happens to collect its garbage."""
    session = spark._jsparkSession.sessionUUID()
    with _SWITCH:
        inside = _SWITCHED.setdefault(session, [0, spark.conf.get(CLEANUP, None)])
        inside[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _SWITCH:
            inside[0] -= 1
            if not inside[0]:
                own = _SWITCHED.pop(session)[1]
                spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)


def durable(df: DataFrame) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it from there.

    Cuts the lineage, survives lost executors, fixes the rows, and leaves a scan
    that prunes columns and knows its size.
    """
    folder = shared_folder(df.sparkSession)
    if (folders := _FOLDERS.get()) is not None:
        folders.append(folder)
    with tidied(df.sparkSession):
        df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where null equals null, as in grouping; the right-hand keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    if not keys:
        raise ValueError("same_keys needs at least one key column")
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in keys])


def large_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys of the groups above ``limit`` rows, or None when there are none.

    A group over all keys can only be large where the group over all but the last one is. Those are counted first: they
    are few, and what the last key rests on (a window, perhaps) is not evaluated. All keys are counted in the large ones.
    """
    if len(keys) > 1:
        wide = _counted(df, keys[:-1], limit)
        if wide is None:
            return None
        df = same_keys(df, wide, keys[:-1], "left_semi")
    return _counted(df, keys, limit)


def _counted(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    with tidied(df.sparkSession):
        if found.isEmpty():
            return None
    found = durable(found)
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found  # at most rows / limit


def _split(df: DataFrame, keys: list[str], limit: int, hot):
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    if hot is LOOK:
        hot = large_groups(df, keys, limit)
    if hot is None:
        return df, None, keys
    return same_keys(df, hot, keys, "left_anti"), same_keys(df, hot, keys, "left_semi"), keys


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with the number of the sorted range they fall in, fixed by writing them out."""
    by_range = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return durable(by_range.withColumn("__part", F.spark_partition_id()))


def _with_offsets(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (keys, range) totals of everything in earlier ranges, joined to the rows."""
    totals = parts.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    return same_keys(parts, offsets, [*keys, "__part"], "left")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
            limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Add running sums (first row of the group up to this row) named by ``sums``.

    ``hot`` takes the result of :func:`large_groups` when the caller has it.
    """
    cold, hot, by = _split(df, keys, limit, hot)

    def local(rows: DataFrame, part: list[str], offset: bool) -> DataFrame:
        w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        cols = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}
        if offset:
            cols = {n: c + F.col(f"__o_{n}") for n, c in cols.items()}
        kept = ["*"] if not offset and keys else df.columns
        return rows.select(*kept, *[c.alias(n) for n, c in cols.items()])

    out = local(cold, by, False)
    if hot is None:
        return out
    parts = _with_offsets(_ranged(hot, by, order), by, sums)
    return out.unionByName(local(parts, [*by, "__part"], True))


def along(df: DataFrame, keys: list[str], order: list[Column], columns: Columns | None = None,
          whole: dict[str, Column] | None = None, back: int = 0, ahead: int = 0,
          limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Add window columns that reach at most ``back`` rows behind and ``ahead`` rows ahead.

    ``columns`` gets the ordered window and returns named columns; ``whole``
    holds plain aggregates over the entire group. ``hot`` takes the result of
    :func:`large_groups` when the caller has it.
    """
    columns = columns or (lambda w: {})
    whole = whole or {}
    cold, hot, by = _split(df, keys, limit, hot)
    named = lambda cols: [c.alias(n) for n, c in cols.items()]

    group = W.partitionBy(*by)
    out = cold.select(*(["*"] if keys else df.columns), *named({n: c.over(group) for n, c in whole.items()}),
                      *named(columns(group.orderBy(*order))))
    if hot is None:
        return out

    if whole:
        hot = same_keys(hot, hot.groupBy(*by).agg(*named(whole)), by, "left")
    if not columns(group.orderBy(*order)):
        return out.unionByName(hot.select(*df.columns, *list(whole)))
    parts = _with_offsets(_ranged(hot, by, order), by, {"row": F.lit(1)})
    numbered = parts.withColumn(
        "__pos", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)) - 1 + F.col("__o_row"))
    block, place = F.floor(F.col("__pos") / limit), F.col("__pos") % limit
    homes = F.array(F.lit(0), F.when(place < ahead, F.lit(-1)), F.when(place >= limit - back, F.lit(1)))
    copies = (numbered.withColumn("__home", block)
              .withColumn("__shift", F.explode(F.array_compact(homes)))
              .withColumn("__block", F.col("__home") + F.col("__shift")))
    w = W.partitionBy(*by, "__block").orderBy(*order)
    done = copies.select(*df.columns, *list(whole), "__shift", *named(columns(w)))
    return out.unionByName(done.filter("__shift = 0").drop("__shift"))
