"""Stage tables: raw events -> headways -> model table -> long-horizon and sequence tables.

Each stage is lazy. In production the result of a stage is written with
``write_table`` (the model table partitioned by ``split``) and the next stage
reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.functions import safe_div
from evengap.operators import enrich, features, headway, select
from evengap.operators.skew import GROUP_ROWS, large_groups
from evengap.roles import DEFAULT, HORIZONS, TIME_ZONE, Roles

# The lines of the study.
SELECTED_LINES = ["4", "117", "179", "401", "474", "541", "607", "116"]


def bus_subset(raw: DataFrame, mode: str = "BUS", lines: list[str] | None = None, roles: Roles = DEFAULT) -> DataFrame:
    return select.select_events(select.select_lines(raw, mode, lines or SELECTED_LINES, roles))


def headways(events: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """Two shuffles: one by trip (bounds, running time), one by stop-day and line for both headway orders.

    Large groups are looked for once per kind, on the events themselves. Columns that follow from a row alone are added
    behind the shuffles, which need not carry them.
    """
    pairs = large_groups(events, roles.headway_group, limit)
    df = headway.with_trip_context(events, roles, limit, large_groups(events, roles.trip_group, limit))
    df = headway.with_dwell(df, roles)
    df = headway.scheduled_headway(df, roles, limit, pairs)
    df = headway.observed_headway(df, roles, limit, pairs)
    df = headway.with_speed(headway.with_event_ts(df, roles), roles)
    df = headway.with_headway_ratio(df)
    return headway.with_labels(headway.with_calendar(df))


BASE_FEATURES = [
    "event_ts_arr", "hour_of_day", "day_of_week", "month_of_year", "headway_ratio", "is_bunched_now",
    "dwell", "dwell_rel_median", "speed_mps", "leader_trip_id", "leader_dwell", "leader_arrival_delay",
    "leader_delay_growth", "first_seq", "last_seq", "route_frac", "headway_ratio_lag1", "headway_ratio_lag2",
    "headway_ratio_lag3", "closing_speed_3", "cum_delay_growth_3", "speed_lag1", "speed_lag2",
]


def trip_features(hw: DataFrame, ks=HORIZONS, fit_split: str | None = None, gate_leader: bool = False,
                  same_pair: bool = False, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """The part of the model table that comes from the events alone: history, labels and split.

    ``fit_split`` limits the stop medians to one split, ``gate_leader`` hides
    leader columns until the leader has arrived, ``same_pair`` drops labels whose
    leader changes on the way.
    """
    df = select.with_split(hw, roles=roles).withColumn("route_frac", select.route_frac(roles))
    if gate_leader:
        seen = F.col("headway_obs") > 0
        df = df.withColumns({c: F.when(seen, F.col(c)) for c in select.LEADER_FEATURES})
    trips = large_groups(hw, roles.trip_group, limit)
    df = features.with_history(df, roles, limit, trips)
    df = features.with_targets(df, ks, same_pair, roles, limit, trips)
    df = features.with_rel_median(df.withColumn("is_bunched_now", F.col("is_bunched")), fit_split, roles)

    own = [roles.day, roles.line, roles.direction, roles.trip, "VehicleID", roles.stop, roles.seq, roles.dist,
           roles.arr_delay, roles.dep_delay]
    labels = [c for k in ks for c in (f"y_k{k}", f"target_valid_k{k}")]
    return df.select(*[c for c in own if c in df.columns], *select.check_leakage(BASE_FEATURES), *labels, "split")


def enrich_events(df: DataFrame, stops: DataFrame, transfers: DataFrame, alerts: DataFrame, weather: DataFrame,
                  counts: DataFrame, zone: str = TIME_ZONE, roles: Roles = DEFAULT,
                  alert_span: tuple[str, str] | None = None) -> DataFrame:
    """Stop attributes, weather and alerts; the rows stay the same."""
    df = enrich.with_stop_grid(df, stops, roles)
    df = enrich.with_weather(df, weather, zone)
    df = enrich.with_route_counts(df, counts, roles)
    df = enrich.flag_interchange(df, transfers, roles)
    return enrich.flag_active(df, alerts, on=roles.stop, span=alert_span)


def model_dataset(hw: DataFrame, stops: DataFrame, transfers: DataFrame, alerts: DataFrame, weather: DataFrame,
                  counts: DataFrame, zone: str = TIME_ZONE, roles: Roles = DEFAULT,
                  alert_span: tuple[str, str] | None = None, **options) -> DataFrame:
    """Features known at the stop, labels some stops ahead, enrichment and split.

    ``options`` go to :func:`trip_features`.
    """
    return enrich_events(trip_features(hw, roles=roles, **options), stops, transfers, alerts, weather, counts,
                         zone, roles, alert_span)


def extra_features(hw: DataFrame, transfers: DataFrame, roles: Roles = DEFAULT,
                   limit: int = GROUP_ROWS) -> DataFrame:
    """Long-horizon candidates, one row per event, keyed like the model table."""
    df = enrich.flag_interchange(hw, transfers, roles)  # a flag of the stop
    df = enrich.with_leader_state(df, roles, limit)
    df = features.with_long_features(df, roles=roles, limit=limit)
    return df.select(
        *roles.key, *select.EXTRA_GROUPS["long_lags"], F.col("headway_sched").cast("double").alias("headway_sched_s"),
        F.col("sched_run_5").cast("double").alias("sched_run_5"),
        F.col("sched_run_8").cast("double").alias("sched_run_8"),
        *select.EXTRA_GROUPS["leader"], *select.EXTRA_GROUPS["ahead"])


def sequence_dataset(hw: DataFrame, ds: DataFrame, ks=HORIZONS, roles: Roles = DEFAULT,
                     limit: int = GROUP_ROWS) -> DataFrame:
    """Six-step sequences of three signals with the labels and split of the model table."""
    labels = ds.select(*roles.key, "split", *[f"y_k{k}" for k in ks])
    return features.sequence_frame(hw, roles=roles, limit=limit).join(labels, roles.key)


def sequence_statistics(seq: DataFrame, fit_split: str = "train", steps: int = features.SEQUENCE_STEPS) -> DataFrame:
    """Mean and population deviation of each signal over all steps of the fitting rows; one row.

    The fitting rows are told by a condition of the aggregates. A filter would be pushed below the shuffles of a lazy
    ``seq``, and :func:`standardize_sequence` could not share them.
    """
    signals = list(features.SEQUENCE_SIGNALS)
    stacked = seq.select((F.col("split") == fit_split).alias("fit"), F.explode(F.array(
        *[F.struct(*[F.col(f"{s}_{i}").cast("double").alias(s) for s in signals]) for i in range(steps)])).alias("v"))
    value = lambda s: F.when(F.col("fit"), F.col(f"v.{s}"))
    aggs = [a for s in signals for a in (F.avg(value(s)).alias(f"{s}_mean"),
                                         (F.stddev_pop(value(s)) + 1e-6).alias(f"{s}_std"))]
    return stacked.agg(*aggs)


def standardize_sequence(seq: DataFrame, fit_split: str = "train", steps: int = features.SEQUENCE_STEPS,
                         stats: DataFrame | None = None) -> DataFrame:
    """Standardised signals (missing -> 0) and a fourth channel: 1 where the ratio was observed."""
    one = (stats if stats is not None else sequence_statistics(seq, fit_split, steps)).withColumn("__one", F.lit(1))
    new = {}
    for i in range(steps):
        new[f"observed_{i}"] = F.col(f"hr_{i}").isNotNull().cast("double")
        for s in features.SEQUENCE_SIGNALS:
            value = safe_div(F.col(f"{s}_{i}") - F.col(f"{s}_mean"), F.col(f"{s}_std"))
            new[f"{s}_{i}"] = F.coalesce(value, F.lit(0.0))
    # the statistics are one row
    joined = seq.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").withColumns(new)
    return joined.select(*seq.columns, *[c for c in new if c not in seq.columns])
