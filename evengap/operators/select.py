"""Projections, filters, splits and feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evengap.functions import safe_div
from evengap.roles import BUNCH_RATIO, DEFAULT, PEAK_HOURS, Roles

# Event columns kept from the raw files; the last two are renamed.
EVENT_COLUMNS = [
    "date", "LineNumber", "route_id", "TransportMode", "direction_id", "trip_id", "VehicleID", "shape_id",
    "stop_sequence", "dist_traveled", "previous_stop_id", "observed_stop_id",
    "scheduled_arrival_time_sfm", "observed_arrival_time_sfm", "observed_arrival_delay",
    "observed_arrival_uncertainty", "scheduled_departure_time_sfm", "observed_departure_time_sfm",
    "observed_departure_delay", "observed_departure_uncertainty",
]
EVENT_RENAMES = {
    "tripupdates_and_gtfs_not_merged_within_service_id": "merge_flag_1",
    "tripupdates_not_merged_with_stoptimes_or_trip": "merge_flag_2",
}

# Model inputs by kind, and the candidate groups for long horizons.
NUMERIC = [
    "headway_ratio", "observed_arrival_delay", "observed_departure_delay", "dwell", "dwell_rel_median", "speed_mps",
    "leader_dwell", "leader_arrival_delay", "leader_delay_growth", "stop_sequence", "route_frac", "dist_traveled",
    "hour_of_day", "day_of_week", "month_of_year", "n_routes_serving",
    "headway_ratio_lag1", "headway_ratio_lag2", "headway_ratio_lag3", "closing_speed_3", "cum_delay_growth_3",
    "speed_lag1", "speed_lag2", "temperature_2m", "temperature_2m_sq", "precipitation", "precip_3h", "wind_speed_10m",
]
BOOLEAN = ["has_parent_station", "is_interchange", "under_active_alert", "is_precip", "is_snowing", "ice_risk"]
CATEGORICAL = ["LineNumber", "direction_id", "wx_group"]
EXTRA_GROUPS = {
    "long_lags": ["headway_ratio_lag5", "headway_ratio_lag8", "closing_speed_8", "cum_delay_growth_8",
                  "dwell_sum_3", "dwell_sum_5"],
    "schedule": ["headway_sched_s", "sched_run_5", "sched_run_8"],
    "leader": ["leader_headway_ratio", "leader_speed"],
    "ahead": ["ahead_med_dwell_5", "ahead_med_dwell_8", "ahead_interchanges_5", "ahead_interchanges_8"],
}
DELAY_FEATURES = ["observed_arrival_delay", "observed_departure_delay", "leader_arrival_delay",
                  "leader_delay_growth", "cum_delay_growth_3"]
DWELL_FEATURES = ["dwell", "dwell_rel_median", "leader_dwell"]
LEADER_FEATURES = ["leader_dwell", "leader_arrival_delay", "leader_delay_growth"]
SIGNED_RATIOS = ["headway_ratio", "headway_ratio_lag1", "headway_ratio_lag2", "headway_ratio_lag3"]


def select_lines(df: DataFrame, mode: str | None, lines: list[str] | None, roles: Roles = DEFAULT,
                 mode_col: str = "TransportMode") -> DataFrame:
    """Rows of one transport mode and a list of lines; both predicates reach the Parquet scan."""
    if mode is not None:
        df = df.filter(F.col(mode_col) == mode)
    if lines is not None:
        df = df.filter(F.col(roles.line).isin(list(lines)))
    return df


def select_events(df: DataFrame) -> DataFrame:
    """Keep the event columns that are present and give the merge flags short names."""
    kept = [F.col(c) for c in EVENT_COLUMNS if c in df.columns]
    renamed = [F.col(c).alias(n) for c, n in EVENT_RENAMES.items() if c in df.columns]
    return df.select(*kept, *renamed)


def is_peak(hour="hour_of_day") -> Column:
    return F.col(hour).isin(list(PEAK_HOURS))


def with_split(df: DataFrame, mode: str = "month", train_to: int = 9, val_to: int = 10,
               roles: Roles = DEFAULT) -> DataFrame:
    """Train / val / test label.

    ``month``: months up to ``train_to`` train, up to ``val_to`` validate, the
    rest test. ``trip``: 75 / 10 / 15 per cent of the trips by hash. ``week``:
    in every eight weeks six train, one validates and one tests.
    """
    if mode == "month":
        part = F.floor(F.col(roles.day) / 100) % 100
        cut = (train_to, val_to)
    elif mode == "trip":
        digest = F.md5(F.concat_ws("-", F.col(roles.day).cast("string"), F.col(roles.trip).cast("string")))
        part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
        cut = (74, 84)
    elif mode == "week":
        day = F.to_date(F.col(roles.day).cast("string"), "yyyyMMdd")
        part = F.floor(F.datediff(day, F.trunc(day, "year")) / 7) % 8
        cut = (5, 6)
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    return df.withColumn("split", F.when(part <= cut[0], "train").when(part <= cut[1], "val").otherwise("test"))


def route_frac(roles: Roles = DEFAULT, first="first_seq", last="last_seq") -> Column:
    """Position on the trip: 0 at the first stop, 1 at the last, null for a one-stop trip."""
    return safe_div(F.col(roles.seq) - F.col(first), F.col(last) - F.col(first))


def with_route_frac(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return df.withColumn("route_frac", route_frac(roles))


def route_bin(n: int, roles: Roles = DEFAULT) -> Column:
    """Equal-width position bin 0 .. n-1; the last stop falls in the last bin."""
    position = safe_div(F.lit(float(n)) * (F.col(roles.seq) - F.col("first_seq")),
                        F.col("last_seq") - F.col("first_seq"))
    return F.when(position.isNotNull(), F.least(F.lit(n - 1), F.floor(position).cast("int")))


def training_frame(df: DataFrame, k: int, split: str | None = None, columns: list[str] | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Labelled rows of one horizon, typed for model fitting.

    Rows leave only when the label is null. Flags become doubles, categories
    strings, and the squared temperature is added.
    """
    columns = columns or NUMERIC + BOOLEAN + CATEGORICAL
    rows = df.filter(F.col(f"y_k{k}").isNotNull())
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    out = []
    for c in columns:
        if c == "temperature_2m_sq":
            out.append((F.col("temperature_2m") * F.col("temperature_2m")).alias(c))
        elif c in BOOLEAN:
            out.append(F.col(c).cast("double").alias(c))
        elif c in CATEGORICAL:
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c).cast("double").alias(c))
    extra = [F.col(c).alias(f"meta_{c}" if c in columns else c) for c in keep or []]
    return rows.select(*extra, *out, F.col(f"y_k{k}").cast("int").alias("y"))


def with_abs_features(df: DataFrame) -> DataFrame:
    """Magnitudes of the ratios, near-zero flags (null kept) and the absolute closing speed."""
    new = {}
    for c in SIGNED_RATIOS:
        new[f"abs_{c}"] = F.abs(F.col(c))
        new[f"near0_{c}"] = (F.abs(F.col(c)) < BUNCH_RATIO).cast("double")
    new["abs_closing_speed_3"] = F.abs(F.col("closing_speed_3"))
    return df.withColumns(new)


ABS_FEATURES = [f"abs_{c}" for c in SIGNED_RATIOS] + [f"near0_{c}" for c in SIGNED_RATIOS] + ["abs_closing_speed_3"]


def feature_set(name: str) -> list[str]:
    """Column names of a feature set.

    ``current``, ``engineered``, ``no_month``, ``no_month+<group>``,
    ``no_month+all``, ``delay_only``, ``dwell_only``, ``no_leader``.
    """
    every = NUMERIC + BOOLEAN + CATEGORICAL
    without = lambda drop: [c for c in every if c not in drop]
    sets = {
        "current": every,
        "engineered": NUMERIC + ABS_FEATURES + BOOLEAN + CATEGORICAL,
        "no_month": without(["month_of_year"]),
        "delay_only": without(DWELL_FEATURES),
        "dwell_only": without(DELAY_FEATURES),
        "no_leader": without(LEADER_FEATURES),
    }
    if name in sets:
        return sets[name]
    base, _, group = name.partition("+")
    if base not in sets or (group != "all" and group not in EXTRA_GROUPS):
        raise ValueError(f"unknown feature set {name!r}")
    added = [c for g in EXTRA_GROUPS.values() for c in g] if group == "all" else EXTRA_GROUPS[group]
    return sets[base] + added


def check_leakage(columns: list[str]) -> list[str]:
    """Return the columns unchanged, or raise when one is built from later stops."""
    bad = [c for c in columns if c == "y" or c.startswith(("y_k", "target_valid_k"))]
    if bad:
        raise ValueError(f"columns look ahead of the stop: {bad}")
    return columns
