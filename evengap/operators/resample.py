"""Day-block bootstrap of ranking metrics.

Rows of one day belong together, so days are drawn, not rows. A replicate gives
every day a weight (how often it was drawn). The weights come from hashes of
replicate and draw number, so any task can form them and two scores get the same
ones.

Scored rows are added up per (score, day) once. The distinct scores are numbered
in descending order and cut into slices of at most ``SLICE_CELLS`` (score, day)
cells besides the days of one score; a slice is one task-sized unit in which
numpy forms the weighted running sums of all replicates. What lies above a slice
enters as one offset per replicate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.operators.skew import GROUP_ROWS, durable, running, same_keys
from evengap.roles import DEFAULT, Roles

SLICE_CELLS = 100_000
CELLS_AT_ONCE = 4_000_000


@lru_cache(maxsize=4)
def draw_weights(n_days: int, replicates: int, seed: int = 0) -> np.ndarray:
    """(replicates, n_days) array: how often each day was drawn in ``n_days`` draws. Kept for the next slice."""
    prefix = f"{seed}-" if seed else ""
    out = np.zeros((replicates, n_days), dtype=np.int64)
    for r in range(replicates):
        for i in range(n_days):
            digest = hashlib.md5(f"{prefix}{r}-{i}".encode()).hexdigest()
            out[r, int(digest[:8], 16) % n_days] += 1
    return out


def unit_weights(n_days: int, replicates: int, seed: int = 0) -> np.ndarray:
    return np.ones((replicates, n_days), dtype=np.int64)


def _slices(scored: DataFrame, by: list[str], days_by: list[str], score: str, roles: Roles, limit: int,
            slice_cells: int) -> DataFrame:
    """One row per (group, distinct score, day) with day number and slice number."""
    days = scored.select(*days_by, roles.day).distinct()
    w = W.partitionBy(*days_by)  # one row per day
    days = days.withColumns({"__d": F.row_number().over(w.orderBy(roles.day)) - 1,
                             "__n_days": F.count(F.lit(1)).over(w)})
    counts = scored.groupBy(*by, F.col(score).alias("score"), roles.day).agg(
        F.sum("y").alias("__pos"), F.sum(1 - F.col("y")).alias("__neg"))
    counts = same_keys(counts, days, [*days_by, roles.day], "inner")
    # At most one entry per day in each list.
    packed = counts.groupBy(*by, "score").agg(
        F.collect_list(F.struct("__d", "__pos", "__neg")).alias("__cells"), F.max("__n_days").alias("__n_days"))
    packed = running(packed, by, [F.col("score").desc_nulls_last()],
                     {"__at": F.lit(1), "__through": F.size("__cells")}, limit)
    return (packed.withColumn("__slice", F.floor((F.col("__through") - F.size("__cells")) / slice_cells).cast("long"))
            .select(*by, "__slice", "__at", "__n_days", F.explode("__cells").alias("c"))
            .select(*by, "__slice", "__at", "__n_days", "c.*"))


def _weighted(pdf: pd.DataFrame, weights) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per block of replicates: weighted positives and negatives of every distinct score, top score first."""
    pdf = pdf.sort_values("__at", kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(pdf["__at"].to_numpy()) != 0])
    day = pdf["__d"].to_numpy()
    pos, neg = pdf["__pos"].to_numpy(dtype=np.int64), pdf["__neg"].to_numpy(dtype=np.int64)
    step = max(1, CELLS_AT_ONCE // len(pdf))
    for a in range(0, len(weights), step):
        w = weights[a:a + step][:, day]
        yield (slice(a, a + len(w)), np.add.reduceat(w * pos, starts, axis=1),
               np.add.reduceat(w * neg, starts, axis=1))


def bootstrap_metrics(scored: DataFrame, replicates: int = 1000, seed: int = 0, by: Sequence[str] = ("k",),
                      days_by: Sequence[str] | None = None, level: float = 0.80, score: str = "score",
                      roles: Roles = DEFAULT, limit: int = GROUP_ROWS, slice_cells: int = SLICE_CELLS,
                      weigh=draw_weights) -> DataFrame:
    """PR-AUC and recall at a precision for every group and replicate.

    ``days_by`` names the groups that share one set of days (default: ``by``).
    """
    by = list(by)
    cells = durable(_slices(scored, by, list(days_by if days_by is not None else by), score, roles, limit,
                            slice_cells))
    keys = cells.select(*by).schema.fields
    head = [*keys, T.StructField("__slice", T.LongType()), T.StructField("replicate", T.IntegerType())]
    key_names = [*by, "__slice"]

    def frame(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        out = {c: [pdf[c].iloc[0]] * replicates for c in key_names}
        return pd.DataFrame({**out, "replicate": np.arange(replicates, dtype=np.int32), **columns})

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = weigh(int(pdf["__n_days"].iloc[0]), replicates, seed)
        tp, fp = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        for part, pos, neg in _weighted(pdf, weights):
            tp[part], fp[part] = pos.sum(axis=1), neg.sum(axis=1)
        return frame(pdf, tp=tp, fp=fp)

    sums = cells.groupBy(*key_names).applyInPandas(
        totals, T.StructType([*head, T.StructField("tp", T.LongType()), T.StructField("fp", T.LongType())]))
    w = W.partitionBy(*by, "replicate")  # one row per slice
    above = w.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*key_names, "replicate", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp_above"),
                          F.coalesce(F.sum("fp").over(above), F.lit(0)).alias("fp_above"),
                          F.sum("tp").over(w).alias("n_pos"))

    def partials(pdf: pd.DataFrame, off: pd.DataFrame) -> pd.DataFrame:
        off = off.sort_values("replicate")
        weights = weigh(int(pdf["__n_days"].iloc[0]), replicates, seed)
        above_tp, above_fp = off["tp_above"].to_numpy(np.int64), off["fp_above"].to_numpy(np.int64)
        area, reached = np.zeros(replicates), np.zeros(replicates, np.int64)
        for part, pos, neg in _weighted(pdf, weights):
            tp = above_tp[part][:, None] + np.cumsum(pos, axis=1)
            fp = above_fp[part][:, None] + np.cumsum(neg, axis=1)
            precision = tp / np.maximum(tp + fp, 1)
            area[part] = (pos * precision).sum(axis=1)
            reached[part] = np.where(precision >= level, tp, 0).max(axis=1)
        return frame(pdf, area=area, reached=reached, n_pos=off["n_pos"].to_numpy(np.int64))

    schema = T.StructType([*head, T.StructField("area", T.DoubleType()), T.StructField("reached", T.LongType()),
                           T.StructField("n_pos", T.LongType())])
    parts = (cells.groupBy(*key_names).cogroup(offsets.groupBy(*key_names)).applyInPandas(partials, schema))
    return parts.groupBy(*by, "replicate").agg(
        F.try_divide(F.sum("area"), F.max("n_pos")).alias("pr_auc"),
        F.try_divide(F.max("reached").cast("double"), F.max("n_pos")).alias("recall"))


def bootstrap_ci(scored: DataFrame, replicates: int = 1000, seed: int = 0, by: Sequence[str] = ("k",),
                 roles: Roles = DEFAULT, **options) -> DataFrame:
    """95 % interval of PR-AUC over the replicates."""
    metrics = bootstrap_metrics(scored, replicates, seed, by, roles=roles, **options)
    return metrics.groupBy(*by).agg(F.percentile("pr_auc", 0.025).alias("ci_low"),
                                    F.percentile("pr_auc", 0.975).alias("ci_high"),
                                    F.count("pr_auc").alias("n_replicates"))


def paired_bootstrap(scored: DataFrame, a: str = "score", b: str = "score_b", replicates: int = 1000, seed: int = 0,
                     by: Sequence[str] = ("k",), level: float = 0.80, roles: Roles = DEFAULT, **options) -> DataFrame:
    """Difference of two scores on the same rows and draws: PR-AUC and recall, intervals, share of positive ones."""
    both = scored.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *by, roles.day, "y", F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col(a).alias("score")),
            F.struct(F.lit("b").alias("side"), F.col(b).alias("score")))).alias("s")
    ).select(*by, roles.day, "y", "s.side", "s.score")
    metrics = bootstrap_metrics(both, replicates, seed, [*by, "side"], list(by), level, roles=roles, **options)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = metrics.groupBy(*by, "replicate").agg(
        (side("a", "pr_auc") - side("b", "pr_auc")).alias("d_auc"),
        (side("a", "recall") - side("b", "recall")).alias("d_recall"))
    share = lambda c: F.try_divide(F.count_if(F.col(c) > 0), F.count(c))
    return wide.groupBy(*by).agg(
        F.percentile("d_auc", 0.025).alias("auc_low"), F.percentile("d_auc", 0.975).alias("auc_high"),
        share("d_auc").alias("auc_share_positive"),
        F.percentile("d_recall", 0.025).alias("recall_low"), F.percentile("d_recall", 0.975).alias("recall_high"),
        share("d_recall").alias("recall_share_positive"))
