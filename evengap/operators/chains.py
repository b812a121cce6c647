"""Chains of consecutive bunched stops: onsets, lengths, and which onsets a score foresaw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.functions import ratio
from evengap.operators.skew import GROUP_ROWS, along, running
from evengap.roles import DEFAULT, HORIZONS, Roles


def chain_onsets(ds: DataFrame, roles: Roles = DEFAULT, state: str = "is_bunched_now",
                 limit: int = GROUP_ROWS) -> DataFrame:
    """Add the stop's number on the trip, the previous state, and whether a chain starts here.

    An onset needs an observed, unbunched stop before it; a chain at the first
    stop or after a missing observation is none.
    """
    order = [F.col(roles.seq)]
    df = along(ds, roles.trip_group, order, lambda w: {"prev_bunched": F.lag(state).over(w)}, back=1, limit=limit)
    df = running(df, roles.trip_group, order, {"rn": F.lit(1)}, limit)
    onset = F.coalesce(F.col(state) & ~F.col("prev_bunched"), F.lit(False))
    return df.withColumn("onset", onset)


def chain_lengths(ds: DataFrame, roles: Roles = DEFAULT, state: str = "is_bunched_now",
                  limit: int = GROUP_ROWS) -> DataFrame:
    """Number of stops of every chain; a missing state ends a chain."""
    on = F.coalesce(F.col(state), F.lit(False))
    order = [F.col(roles.seq)]
    df = along(ds.select(*roles.key, on.alias("__on")), roles.trip_group, order,
               lambda w: {"__prev": F.coalesce(F.lag("__on").over(w), F.lit(False))}, back=1, limit=limit)
    starts = (F.col("__on") & ~F.col("__prev")).cast("int")
    df = running(df, roles.trip_group, order, {"chain": starts}, limit)
    return df.filter("__on").groupBy(*roles.trip_group, "chain").agg(F.count(F.lit(1)).alias("length"))


def chain_length_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_chains"), F.avg("length").alias("mean_length"),
                       F.median("length").alias("median_length"))


def onset_hits(onsets: DataFrame, scored: DataFrame, k: int, roles: Roles = DEFAULT) -> DataFrame:
    """Score given ``k`` stops before each onset; null where the trip was not scored there.

    ``scored`` carries the row number ``rn`` of the scored stop.
    """
    place = [*roles.trip_group, "rn"]
    shifted = (scored.filter(F.col("k") == k)
               .select(*roles.trip_group, (F.col("rn") + k).alias("rn"), F.col("score").alias(f"score_k{k}")))
    return onsets.join(shifted, place, "left")


def all_onset_hits(onsets: DataFrame, scored: DataFrame, ks: Sequence[int] = HORIZONS,
                   roles: Roles = DEFAULT) -> DataFrame:
    """Scores of all horizons per onset, by one shuffle: every score is moved to the stop it is about."""
    place = [*roles.trip_group, "rn"]
    aimed = scored.filter(F.col("k").isin(list(ks))).select(
        *roles.trip_group, (F.col("rn") + F.col("k")).alias("rn"),
        *[F.when(F.col("k") == k, F.col("score")).alias(f"score_k{k}") for k in ks])
    per_stop = aimed.groupBy(*place).agg(*[F.max(f"score_k{k}").alias(f"score_k{k}") for k in ks])
    return onsets.select(*place).join(per_stop, place, "left")


def _levels_long(hits: DataFrame, thresholds: DataFrame, ks: Sequence[int], keep: list[str]) -> DataFrame:
    """One row per onset, horizon and precision level; thresholds are a few rows (k, level, threshold)."""
    long = hits.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"score_k{k}").alias("score")) for k in ks])).alias("s"))
    return long.select(*keep, "s.k", "s.score").join(thresholds, "k")


def onsets_caught(hits: DataFrame, thresholds: DataFrame, ks: Sequence[int] = HORIZONS) -> DataFrame:
    """Onsets with a score, onsets caught, and both shares, per horizon and precision level."""
    hit = F.col("score") >= F.col("threshold")
    out = _levels_long(hits, thresholds, ks, []).groupBy("k", "level").agg(
        F.count(F.lit(1)).alias("n_onsets"), F.count("score").alias("with_prediction"),
        F.count_if(hit).alias("caught"))
    return out.withColumns({"share_of_onsets": ratio("caught", "n_onsets"),
                            "share_of_predictable": ratio("caught", "with_prediction")})


def earliest_warning(hits: DataFrame, thresholds: DataFrame, ks: Sequence[int] = HORIZONS,
                     roles: Roles = DEFAULT) -> DataFrame:
    """Distribution of the largest horizon that caught an onset, per level; 0 = never caught."""
    place = [*roles.trip_group, "rn"]
    caught = F.when(F.col("score") >= F.col("threshold"), F.col("k")).otherwise(0)
    per_onset = (_levels_long(hits, thresholds, ks, place).groupBy(*place, "level")
                 .agg(F.max(caught).alias("earliest_k")))
    counts = per_onset.groupBy("level", "earliest_k").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("level").agg(F.sum("n").alias("__n"))
    return (counts.join(totals, "level")
            .select("level", "earliest_k", "n", ratio("n", "__n").alias("share")))
