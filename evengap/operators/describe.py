"""Descriptive aggregates of regularity. All of them combine on the map side; none sorts raw rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evengap.functions import bucket, clamp, grid_key, ratio, safe_div
from evengap.operators.select import is_peak, route_bin
from evengap.operators.skew import GROUP_ROWS, along
from evengap.roles import BUNCH_RATIO, DEFAULT, HEADWAY_BOUNDS, HORIZONS, Roles


def _pct(cond: Column, total: Column | None = None) -> Column:
    return ratio(F.count_if(cond), F.count("*") if total is None else total, 100.0)


def _cv(col: str = "headway_obs") -> Column:
    return safe_div(F.stddev(col), F.avg(col))


def _positive_headways(df: DataFrame) -> DataFrame:
    return df.filter((F.col("headway_obs") > 0) & (F.col("headway_obs") < 3600))


# --- inventory and quality -------------------------------------------------------------------------------------------

def inventory(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows, distinct trips and distinct days per line, from one pre-aggregation by (line, trip, day)."""
    cells = df.groupBy(roles.line, roles.trip, roles.day).agg(F.count("*").alias("__n"))
    return cells.groupBy(roles.line).agg(
        F.sum("__n").alias("n_rows"), F.countDistinct(roles.trip).alias("n_trips"),
        F.countDistinct(roles.day).alias("n_days"))


def headway_modes(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent scheduled headways."""
    counts = df.filter(F.col("headway_sched").isNotNull()).groupBy("headway_sched").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "headway_sched").limit(n)


def quality_profile(df: DataFrame, bounds: tuple[int, int] = HEADWAY_BOUNDS) -> DataFrame:
    """Shares of missing, negative and implausible observed headways; the negative tail is split at the lower bound."""
    obs = F.col("headway_obs")
    return df.agg(
        _pct(obs.isNull()).alias("pct_null"), _pct(obs < 0).alias("pct_negative"),
        _pct(obs > bounds[1]).alias("pct_over_3h"), _pct(obs < bounds[0]).alias("pct_below_bound"),
        _pct((obs < 0) & (obs >= bounds[0])).alias("pct_overtake"), F.count("*").alias("total"))


def base_rate(df: DataFrame, by: Sequence[str] = ("LineNumber",)) -> DataFrame:
    """Per cent bunched and per cent gap of the rows with a valid ratio."""
    valid = F.count("headway_ratio")
    return df.groupBy(*by).agg(_pct(F.col("is_bunched"), valid).alias("pct_bunched"),
                               _pct(F.col("is_gap"), valid).alias("pct_gap"), valid.alias("n_valid"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = (0.20, 0.25, 0.33, 0.50)) -> DataFrame:
    """Per cent of valid rows under each threshold of the absolute ratio; one pass."""
    size = F.abs(F.col("headway_ratio"))
    return df.filter(F.col("headway_ratio").isNotNull()).agg(
        *[_pct(size < t).alias(f"thr_{round(t * 100):03d}") for t in thresholds])


def definition_disagreement(df: DataFrame, threshold: float = BUNCH_RATIO) -> DataFrame:
    """How often the scheduled-pair and the observed-order definition disagree, overall and among bunched rows."""
    a, b = F.abs(F.col("headway_ratio")) < threshold, F.abs(F.col("headway_ratio_obsorder")) < threshold
    both = df.filter(F.col("headway_ratio").isNotNull() & F.col("headway_ratio_obsorder").isNotNull())
    return both.agg(_pct(a != b).alias("pct_disagree_overall"),
                    _pct(a & ~b, F.count_if(a)).alias("pct_bunched_missed_by_observed_order"))


def dwell_profile(df: DataFrame) -> DataFrame:
    return df.agg(_pct(F.col("dwell").isNull()).alias("pct_dwell_null"), F.avg("dwell").alias("mean_dwell"),
                  F.median("dwell").alias("median_dwell"),
                  _pct(F.col("dwell_negative_flag")).alias("pct_dwell_negative"))


def split_profile(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min(roles.day).alias("first_day"),
                                   F.max(roles.day).alias("last_day"))


def _stack(row: DataFrame, names: Sequence, label: str, columns: Sequence[str]) -> DataFrame:
    """Turn one wide aggregate row into one row per name."""
    structs = [F.struct(F.lit(n).alias(label), *[F.col(f"{c}__{n}").alias(c) for c in columns]) for n in names]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def target_profile(df: DataFrame, ks: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows whose trip reaches stop n+k, and the share of those that are bunched there; all horizons in one pass."""
    aggs = []
    for k in ks:
        valid = F.count_if(F.col(f"target_valid_k{k}"))
        aggs += [valid.alias(f"n_valid__{k}"), ratio(F.sum(f"y_k{k}"), valid, 100.0).alias(f"pct_positive__{k}")]
    return _stack(df.agg(*aggs), ks, "k", ["n_valid", "pct_positive"])


def coverage(df: DataFrame) -> DataFrame:
    """Missing weather, flag rates, and rows with a lag but no current ratio."""
    leak = F.col("headway_ratio_lag1").isNotNull() & F.col("headway_ratio").isNull()
    return df.agg(_pct(F.col("temperature_2m").isNull()).alias("pct_weather_missing"),
                  _pct(F.col("under_active_alert")).alias("pct_alert"),
                  _pct(F.col("is_interchange")).alias("pct_interchange"),
                  F.count_if(leak).alias("n_lag_without_current"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cent missing per column, as rows; one pass over the table."""
    row = df.agg(*[_pct(F.col(c).isNull()).alias(f"pct_null__{c}") for c in columns])
    return _stack(row, columns, "column_name", ["pct_null"])


def key_profile(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows and distinct row keys; equal when the key is unique."""
    per_key = df.groupBy(*roles.key).agg(F.count("*").alias("__n"))
    return per_key.agg(F.sum("__n").alias("n_rows"), F.count("*").alias("n_keys"))


def hourly_coverage(weather: DataFrame, first: str = "2024-01-01 00:00:00",
                    last: str = "2024-12-31 23:00:00") -> DataFrame:
    """Hours present and missing per grid cell of the period."""
    span = datetime.fromisoformat(last) - datetime.fromisoformat(first)
    expected = int(span.total_seconds()) // 3600 + 1
    ts = F.col("ts_utc")
    inside = ts.between(F.expr(f"TIMESTAMP_NTZ'{first}'"), F.expr(f"TIMESTAMP_NTZ'{last}'"))
    # hours count from the first one; a cell without any of them is missing all
    whole = F.expr(f"pmod(timestampdiff(SECOND, TIMESTAMP_NTZ'{first}', ts_utc), 3600) = 0")
    present = (weather.withColumns({"lat_key": grid_key("grid_lat"), "lon_key": grid_key("grid_lon")})
               .groupBy("lat_key", "lon_key").agg(F.countDistinct(F.when(inside & whole, ts)).alias("hours_present")))
    return present.withColumn("hours_missing", F.lit(expected) - F.col("hours_present"))


def stop_route_counts(df: DataFrame, month: int | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """Distinct lines calling at each stop, over one month or all rows."""
    rows = df if month is None else df.filter(F.floor(F.col(roles.day) / 100) % 100 == month)
    return (rows.select(roles.stop, roles.line).distinct().groupBy(roles.stop)
            .agg(F.count(roles.line).alias("n_routes_serving")))


def line_variants(df: DataFrame, roles: Roles = DEFAULT, variant: str = "shape_id") -> DataFrame:
    """The most frequent variant of each line and direction; ties go to the first name."""
    counts = df.groupBy(roles.line, roles.direction, variant).agg(F.count("*").alias("n"))
    # One row per variant is left, so the window sorts a handful of rows per line.
    w = W.partitionBy(roles.line, roles.direction).orderBy(F.desc("n"), F.col(variant).asc_nulls_last())
    return counts.withColumn("rk", F.row_number().over(w)).filter("rk = 1").drop("rk")


def line_paths(df: DataFrame, stops: DataFrame, roles: Roles = DEFAULT, variant: str = "shape_id") -> DataFrame:
    """Stops of the most frequent variant with their median place on the trip and coordinates.

    Rows without a variant count as a variant of their own.
    """
    keys = [roles.line, roles.direction, variant]
    top = line_variants(df, roles, variant).select(*[F.col(c).alias(f"__{c}") for c in keys])
    places = (df.join(top, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_semi")
              .groupBy(roles.line, roles.direction, roles.stop).agg(F.median(roles.seq).alias("place")))
    where = stops.select(F.col("stop_id").alias(roles.stop), "stop_lat", "stop_lon")
    return places.join(where, roles.stop).select(roles.line, roles.direction, roles.stop, "place",
                                                 "stop_lat", "stop_lon")


def screen_lines(df: DataFrame, max_headway: int = 600, roles: Roles = DEFAULT) -> DataFrame:
    """Candidate lines: median scheduled peak headway, trips, missing arrivals, and a rank by trips among the frequent.

    A frequent line has a median of at most ``max_headway`` seconds.
    """
    trips = (df.groupBy(roles.line, roles.day, roles.trip)
             .agg(F.count("*").alias("__n"), F.count(roles.obs_arr).alias("__seen"))
             .groupBy(roles.line).agg(F.count("*").alias("n_trips"), F.sum("__n").alias("n_rows"),
                                      F.sum("__seen").alias("__seen")))
    peak = (df.filter(is_peak() & F.col("headway_sched").isNotNull())
            .groupBy(roles.line).agg(F.median("headway_sched").alias("median_peak_headway")))
    out = (trips.join(peak, roles.line, "left")
           .withColumn("pct_missing", ratio(F.col("n_rows") - F.col("__seen"), "n_rows", 100.0))
           .withColumn("frequent", F.coalesce(F.col("median_peak_headway") <= max_headway, F.lit(False))).drop("__seen"))
    w = W.partitionBy("frequent").orderBy(F.desc("n_trips"), roles.line)  # one row per line
    return out.withColumn("rank", F.when(F.col("frequent"), F.row_number().over(w)))


def sfm_overflow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows past midnight and the largest value of each service-time column."""
    row = df.agg(*[a for c in columns for a in (F.count_if(F.col(c) > 86400).alias(f"n_over__{c}"),
                                                F.max(c).cast("long").alias(f"max_value__{c}"))])
    return _stack(row, columns, "column_name", ["n_over", "max_value"])


def outage_days(df: DataFrame, limit_pct: float = 50.0, by: Sequence[str] = (), roles: Roles = DEFAULT) -> DataFrame:
    """Days (and groups) on which more than ``limit_pct`` per cent of the arrivals are missing."""
    return (df.groupBy(roles.day, *by).agg(_pct(F.col(roles.obs_arr).isNull()).alias("pct_missing"),
                                           F.count("*").alias("n"))
            .filter(F.col("pct_missing") > limit_pct))


def trip_completeness(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Trips with any observed arrival against scheduled trips, per line and day."""
    trips = df.groupBy(roles.line, roles.day, roles.trip).agg(F.count(roles.obs_arr).alias("__seen"))
    return (trips.groupBy(roles.line, roles.day)
            .agg(F.count("*").alias("n_scheduled"), F.count_if(F.col("__seen") > 0).alias("n_observed"))
            .withColumn("completeness", ratio("n_observed", "n_scheduled")))


def sequence_gaps(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """Trips whose stop numbers are not consecutive.

    Stop numbers are unique on a trip, so a trip has a gap exactly when its span
    differs from its number of rows; no ordering is needed.
    """
    trips = df.groupBy(*roles.trip_group).agg(
        F.count("*").alias("__n"), (F.max(roles.seq) - F.min(roles.seq) + 1).alias("__span"))
    gap = F.col("__span") != F.col("__n")
    return trips.agg(F.count("*").alias("n_trips"), F.count_if(gap).alias("n_with_gap"), _pct(gap).alias("pct_gap"))


def split_coverage(df: DataFrame) -> DataFrame:
    """Weather seen by each split: lowest and mean temperature, share of snow and ice rows."""
    return df.groupBy("split").agg(F.min("temperature_2m").alias("min_temperature"),
                                   F.avg("temperature_2m").alias("mean_temperature"),
                                   _pct(F.col("is_snowing")).alias("pct_snow"),
                                   _pct(F.col("ice_risk")).alias("pct_ice"))


def label_difference(df: DataFrame, threshold: float = BUNCH_RATIO) -> DataFrame:
    """Rows that a signed threshold would label differently from the absolute one."""
    r = F.col("headway_ratio")
    return df.agg(F.count_if((r < threshold) != (F.abs(r) < threshold)).alias("n_changed"),
                  F.count(r).alias("n_valid"))


def lead_minutes(df: DataFrame, ks: Sequence[int] = HORIZONS) -> DataFrame:
    """Median running time between stops, and each horizon in minutes."""
    median = df.agg(F.median("run_time").alias("median_run_time"))
    return (median.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .withColumn("minutes", F.col("k") * F.col("median_run_time") / 60.0))


def grid_points(df: DataFrame, stops: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Distinct weather cells of the stops in use."""
    used = df.select(roles.stop).distinct()
    where = stops.select(F.col("stop_id").alias(roles.stop), F.round("stop_lat", 1).alias("grid_lat"),
                         F.round("stop_lon", 1).alias("grid_lon"))
    return used.join(where, roles.stop, "left").select("grid_lat", "grid_lon").distinct()


# --- rates and distributions -----------------------------------------------------------------------------------------

def rate_by(df: DataFrame, *by: str, state: str = "is_bunched_now") -> DataFrame:
    """Per cent bunched and rows per group, over rows with a valid ratio."""
    return (df.filter(F.col("headway_ratio").isNotNull()).groupBy(*by)
            .agg((100.0 * F.avg(F.col(state).cast("int"))).alias("pct_bunched"), F.count("*").alias("n")))


def rate_by_hour(df: DataFrame, first_hour: int = 4, last_hour: int = 26, roles: Roles = DEFAULT) -> DataFrame:
    return rate_by(df.filter(F.col("hour_of_day").between(first_hour, last_hour)), roles.line, "hour_of_day")


def rate_matrix(df: DataFrame, hours: Sequence[int] = range(4, 24), roles: Roles = DEFAULT) -> DataFrame:
    """Line x hour matrix of the bunching rate; the hours are named, so no pass looks for them."""
    cells = rate_by_hour(df, min(hours), max(hours), roles)
    wide = cells.groupBy(roles.line).pivot("hour_of_day", list(hours)).agg(F.first("pct_bunched"))
    return wide.select(roles.line, *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def hotspots(df: DataFrame, stops: DataFrame, min_n: int = 500, roles: Roles = DEFAULT) -> DataFrame:
    """Bunching rate of every stop with enough rows, with name and coordinates."""
    rates = rate_by(df, roles.stop).filter(F.col("n") >= min_n)
    where = stops.filter(F.col("stop_lat").isNotNull()).select(
        F.col("stop_id").alias(roles.stop), "stop_lat", "stop_lon", "stop_name")
    return rates.join(where, roles.stop)


def top_hotspots(df: DataFrame, stops: DataFrame, min_n: int = 2000, top: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    return hotspots(df, stops, min_n, roles).orderBy(F.desc("pct_bunched"), roles.stop).limit(top)


def _with_density(counts: DataFrame, group: str, width: float) -> DataFrame:
    totals = counts.groupBy(group).agg(F.sum("n").alias("__total"))
    return (counts.join(totals, group)
            .withColumn("density", safe_div("n", F.col("__total") * F.lit(width))).drop("__total"))


def ratio_histogram(df: DataFrame, width: float = 0.05) -> DataFrame:
    """Histogram of the headway ratio clamped to [-1, 3], peak against off-peak, with density."""
    counts = (df.filter(F.col("headway_ratio").isNotNull())
              .groupBy(bucket(clamp("headway_ratio", -1.0, 3.0), width).alias("bucket"),
                       F.when(is_peak(), "peak").otherwise("off-peak").alias("period"))
              .agg(F.count("*").alias("n")))
    return _with_density(counts, "period", width)


def _standing(df: DataFrame) -> DataFrame:
    return df.filter(F.col("dwell") >= 0)


def dwell_histogram(df: DataFrame, width: float = 2.0) -> DataFrame:
    """Histogram of the dwell clamped to 120 s, interchanges against ordinary stops, with density."""
    counts = (_standing(df).groupBy(bucket(clamp("dwell", hi=120), width).alias("bucket"), "is_interchange")
              .agg(F.count("*").alias("n")))
    return _with_density(counts, "is_interchange", width)


def dwell_by_stop_type(df: DataFrame) -> DataFrame:
    return _standing(df).groupBy("is_interchange").agg(
        F.avg("dwell").alias("mean_dwell"), F.median("dwell").alias("median_dwell"), F.count("*").alias("n"))


def _feedback_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("headway_ratio").between(-1, 3) & F.col("delay_growth").isNotNull())


def histogram_2d(df: DataFrame) -> DataFrame:
    """Counts by headway ratio (0.05) and delay growth (5 s, clamped to [-60, 120])."""
    return (_feedback_rows(df)
            .groupBy(bucket(clamp("headway_ratio", hi=3.0), 0.05).alias("hr_bucket"),
                     bucket(clamp("delay_growth", -60, 120), 5).alias("dg_bucket"))
            .agg(F.count("*").alias("n")))


def histogram_matrix(df: DataFrame, dg_buckets: Sequence[int] = range(-60, 125, 5)) -> DataFrame:
    """Wide form of :func:`histogram_2d`: one row per ratio bucket, one column per delay bucket, empty cells 0."""
    wide = (histogram_2d(df).withColumn("__dg", F.col("dg_bucket").cast("int"))
            .groupBy("hr_bucket").pivot("__dg", list(dg_buckets)).agg(F.sum("n")).na.fill(0))
    return wide.select("hr_bucket", *[F.col(f"`{b}`").alias(f"dg_{'m' if b < 0 else 'p'}{abs(b)}") for b in dg_buckets])


def feedback_corr(df: DataFrame) -> DataFrame:
    """Pearson correlation of headway ratio and delay growth."""
    return _feedback_rows(df).agg(F.corr("headway_ratio", "delay_growth").alias("pearson_r"))


def rate_along_route(df: DataFrame, n: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    """Bunching rate by part of the route, per line and for all lines (line null), in one pass."""
    rows = (df.filter(F.col("headway_ratio").isNotNull() & (F.col("last_seq") > F.col("first_seq")))
            .select(roles.line, route_bin(n, roles).alias("seg"), F.col("is_bunched").cast("int").alias("__b")))
    return (rows.groupingSets([[F.col(roles.line), F.col("seg")], [F.col("seg")]], F.col(roles.line), F.col("seg"))
            .agg((100.0 * F.avg("__b")).alias("pct_bunched"), F.count("*").alias("n")))


# --- variation of headways -------------------------------------------------------------------------------------------

def cv_by_stop(df: DataFrame, min_n: int = 30, roles: Roles = DEFAULT) -> DataFrame:
    """Coefficient of variation of the observed headway per line and stop number."""
    return (_positive_headways(df).groupBy(roles.line, roles.seq)
            .agg(_cv().alias("cv"), F.count("*").alias("n")).filter(F.col("n") >= min_n))


def smooth_cv(cv: DataFrame, n: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    """Centred rolling mean over ``n`` stops of a line; input is one row per line and stop number."""
    half = n // 2
    return along(cv, [roles.line], [F.col(roles.seq)],
                 lambda w: {"cv_smooth": F.avg("cv").over(w.rowsBetween(-half, half))}, back=half, ahead=half)


def cv_along_route(df: DataFrame, n: int = 10, exclude: Sequence[str] = (), roles: Roles = DEFAULT) -> DataFrame:
    """CV per line and tenth of the route, averaged over lines with equal weight: all lines, and without ``exclude``."""
    rows = _positive_headways(df).filter(F.col("last_seq") > F.col("first_seq"))
    cells = (rows.groupBy(roles.line, route_bin(n, roles).alias("bin")).agg(_cv().alias("cv")))
    kept = ~F.col(roles.line).isin(list(exclude)) if exclude else F.lit(True)
    return cells.groupBy("bin").agg(F.avg("cv").alias("mean_cv"), F.avg(F.when(kept, F.col("cv"))).alias("mean_cv_without"))


def cv_with_sample_flag(df: DataFrame, min_n: int = 30, share: float = 0.2, roles: Roles = DEFAULT) -> DataFrame:
    """Stops whose sample is under ``share`` of the line's median sample are marked."""
    cv = cv_by_stop(df, min_n, roles)
    medians = cv.groupBy(roles.line).agg(F.median("n").alias("median_n"))
    return cv.join(medians, roles.line).withColumn("low_sample", F.col("n") < share * F.col("median_n"))


def cv_trend(df: DataFrame, ends: int = 3, min_n: int = 30, share: float = 0.2, roles: Roles = DEFAULT) -> DataFrame:
    """Mean CV over the first and the last reliable stops of every line."""
    ok = cv_with_sample_flag(df, min_n, share, roles).filter(~F.col("low_sample"))
    w = W.partitionBy(roles.line)  # one row per stop number of a line
    ranked = ok.withColumns({"__a": F.row_number().over(w.orderBy(F.asc(roles.seq))),
                             "__z": F.row_number().over(w.orderBy(F.desc(roles.seq)))})
    return ranked.groupBy(roles.line).agg(F.avg(F.when(F.col("__a") <= ends, F.col("cv"))).alias("cv_start"),
                                          F.avg(F.when(F.col("__z") <= ends, F.col("cv"))).alias("cv_end"))


def excess_wait(df: DataFrame, by: Sequence[str] = ("LineNumber",)) -> DataFrame:
    """Expected wait of a random arrival, E[h]/2 (1 + CV^2), against an even timetable, in minutes."""
    per = (_positive_headways(df).groupBy(*by)
           .agg(F.avg("headway_obs").alias("mean_headway"), _cv().alias("cv")))
    even = F.col("mean_headway") / 120.0
    return per.withColumns({"wait_timetable": even, "wait_observed": even * (1 + F.col("cv") * F.col("cv")),
                            "wait_excess": even * F.col("cv") * F.col("cv")})


def cv_cells(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """CV per line, direction, stop, hour and month."""
    return (_positive_headways(df).groupBy(roles.line, roles.direction, roles.stop, "hour_of_day", "month_of_year")
            .agg(_cv().alias("cv"), F.count("*").alias("n")))


# --- order and samples -----------------------------------------------------------------------------------------------

def ordered(df: DataFrame, keys: Sequence[str] | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """Total order by the row key, for display and export only."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in keys or roles.key])


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def best_by(df: DataFrame, group: Sequence[str], metric: str, name: str = "name") -> DataFrame:
    """Best row of every group; equal metrics go to the first name. Meant for ledgers: a few rows per group."""
    w = W.partitionBy(*group).orderBy(F.col(metric).desc_nulls_last(), name)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def hash_order(key: Sequence[str], seed: int) -> Column:
    """Deterministic pseudo-random text to sort rows by."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))


def with_hash_rank(df: DataFrame, key: Sequence[str], seed: int, name: str = "rank",
                   first: int | None = None) -> DataFrame:
    """Number the rows 1..N in pseudo-random order.

    Hash prefixes are uniform, so 65,536 prefix buckets hold about equal numbers
    of rows. Only the bucket counts are summed up in one place. ``first`` keeps
    the rows numbered up to it: other buckets are left out before rows move.
    """
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__b", F.substring("__h", 1, 4))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(W.partitionBy("__b").orderBy("__h", *key))
    needed = offsets if first is None else offsets.filter(F.col("__before") < first)
    numbered = (rows.join(F.broadcast(needed), "__b")  # 65,536 rows at most
                .withColumn("__local", local).withColumn(name, F.col("__before") + F.col("__local")).select(*df.columns, name))
    return numbered if first is None else numbered.filter(F.col(name) <= first)


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same on every run; all rows when there are fewer."""
    return with_hash_rank(df, key, seed, "__rank", n).drop("__rank")

