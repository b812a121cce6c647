"""Row-level operators: sources, projections, joins, windows, stage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import KEY, check, scratch
from evengap import HORIZONS
from evengap import functions as fx
from evengap.operators import describe, enrich, features, headway, select
from evengap.operators.skew import durable
from evengap.plans import bus_subset, sequence_statistics, standardize_sequence
from evengap.sources import (append_results, compact_results, pending, read_events, read_results, read_static, read_table,
                             write_clustered, write_table)

K = " ".join
TARGETS = K(f"y_k{k}:i target_valid_k{k}:b" for k in HORIZONS)

EVENT_SPEC = KEY + ("LineNumber:s TransportMode:s direction_id:i VehicleID:i shape_id:s dist_traveled:f "
                    "observed_stop_id:i scheduled_arrival_time_sfm:i observed_arrival_time_sfm:i "
                    "observed_arrival_delay:i observed_departure_time_sfm:i observed_departure_delay:i")


# --- sources and sinks -----------------------------------------------------------------------------------------------

@check("s01_read_events", EVENT_SPEC, "SELECT * FROM trip_stop")
def _(t):
    """Monthly gzip CSV files: one set with another column order and without shape_id for the first two lines."""
    path = scratch(t.spark)
    early = F.col("LineNumber").isin("4", "117")
    ev = t.events
    ev.filter(early).select(*reversed(ev.columns)).write.csv(f"{path}/a", header=True, compression="gzip")
    ev.filter(~early).write.csv(f"{path}/b", header=True, compression="gzip")
    return read_events(t.spark, f"{path}/*/*.csv.gz", partitions=8)


@check("s02_read_table", KEY + "headway_ratio:f is_bunched:b", "SELECT * FROM hw")
def _(t):
    path = f"{scratch(t.spark)}/headways"
    write_table(t.hw, path)
    return read_table(t.spark, path)


@check("s03_read_static", "stop_id:i stop_name:s stop_lat:f stop_lon:f parent_station:i", "SELECT * FROM stops")
def _(t):
    path = f"{scratch(t.spark)}/stops"
    t.stops.write.csv(path, header=True, sep=";")
    return read_static(t.spark, path, sep=";", schema="stop_id bigint, stop_name string, stop_lat double, "
                                                      "stop_lon double, parent_station bigint")


@check("s04_write_table", KEY + "split:s y_k3:i", "SELECT * FROM trips WHERE split = 'val'")
def _(t):
    path = f"{scratch(t.spark)}/model"
    write_table(t.trips, path, partition_by=["split"])
    return read_table(t.spark, path).filter("split = 'val'")


LEDGER_SQL = """SELECT LineNumber AS model, month_of_year AS k, CAST(hour_of_day AS VARCHAR) AS name,
    avg(CAST(is_bunched AS INT)) AS value FROM hw WHERE headway_ratio IS NOT NULL GROUP BY ALL"""


def _trials(t):
    """A result table with many configurations: bunching rate by line, month and hour."""
    return (t.hw.filter("headway_ratio IS NOT NULL")
            .groupBy(F.col("LineNumber").alias("model"), F.col("month_of_year").alias("k"),
                     F.col("hour_of_day").cast("string").alias("name"))
            .agg(F.avg(F.col("is_bunched").cast("int")).alias("value")))


@check("s05_pending", "model:s k:i name:s", "SELECT model, k, name FROM ledger WHERE k > 8 OR model = '4'",
       ledger=LEDGER_SQL)
def _(t):
    path = f"{scratch(t.spark)}/ledger"
    trials = _trials(t)
    append_results(trials.filter("k <= 4 AND model <> '4'"), path)
    append_results(trials.filter("k BETWEEN 5 AND 8 AND model <> '4'"), path)
    return pending(trials.select("model", "k", "name"), path)


@check("s05_ledger", "model:s k:i name:s value:f", "SELECT model, k, name, value FROM ledger", ledger=LEDGER_SQL)
def _(t):
    """A ledger in which one line's trials were stored twice, the first time with another result, and then compacted."""
    path, trials, keys = f"{scratch(t.spark)}/ledger", durable(_trials(t)), ("model", "k", "name")
    append_results(trials.filter("model = '4'").withColumn("value", F.lit(-1.0)), path)
    append_results(trials, path)
    compact_results(t.spark, path, f"{path}-whole", keys)
    return read_results(t.spark, f"{path}-whole", keys)


@check("u01_union_by_name", KEY + "LineNumber:s shape_id:s",
       "SELECT date, trip_id, stop_sequence, LineNumber, CASE WHEN direction_id = 1 THEN shape_id END AS shape_id "
       "FROM trip_stop")
def _(t):
    one = t.events.filter("direction_id = 0").select("LineNumber", "stop_sequence", "date", "trip_id")
    two = t.events.filter("direction_id = 1").select("date", "trip_id", "stop_sequence", "shape_id", "LineNumber")
    return enrich.union_all(one, two)


@check("u02_union_cells", "grid_lat:f grid_lon:f ts_utc:t temperature_2m:f", "SELECT * FROM hourly")
def _(t):
    return enrich.union_all(*[t.hourly.filter(fx.grid_key("grid_lat") % 3 == r) for r in range(3)])


@check("u04_finished_or_pending", "model:s k:i name:s", "SELECT model, k, name FROM ledger WHERE value < 0.1",
       ledger=LEDGER_SQL)
def _(t):
    trials = _trials(t)
    return pending(trials.select("model", "k", "name"), trials.filter("value >= 0.1"))


# --- projections and filters -----------------------------------------------------------------------------------------

@check("p01_select_lines", KEY + "LineNumber:s TransportMode:s",
       "SELECT * FROM trip_stop WHERE TransportMode = 'BUS' AND LineNumber IN ('4', '185H')")
def _(t):
    return select.select_lines(t.events, "BUS", ["4", "185H"])


@check("p02_select_events", KEY + "LineNumber:s merge_flag_1:i merge_flag_2:i",
       "SELECT *, trip_id % 2 AS merge_flag_1, trip_id % 3 AS merge_flag_2 FROM trip_stop")
def _(t):
    raw = t.events.withColumns({"tripupdates_and_gtfs_not_merged_within_service_id": F.col("trip_id") % 2,
                                "tripupdates_not_merged_with_stoptimes_or_trip": F.col("trip_id") % 3})
    return select.select_events(raw)


@check("p03_event_ts", KEY + "event_ts_arr:t event_ts_dep:t sched_event_ts_arr:t", "SELECT * FROM stamped")
def _(t):
    return headway.with_event_ts(t.events)


@check("p04_raw_dwell", KEY + "dwell_raw:i delay_growth:i", "SELECT * FROM moved")
def _(t):
    return headway.with_dwell(headway.with_trip_bounds(t.events))


@check("p05_clean_dwell", KEY + "dwell:i dwell_negative_flag:b", "SELECT * FROM moved")
def _(t):
    return headway.with_dwell(headway.with_trip_bounds(t.events))


@check("p06_speed", KEY + "speed_mps:f", "SELECT * FROM moved")
def _(t):
    return headway.with_speed(headway.with_run_time(t.events))


@check("p07_headway_ratio", KEY + "headway_obs_invalid:b headway_ratio:f headway_ratio_obsorder:f", "SELECT * FROM hw")
def _(t):
    return t.hw


@check("p08_labels", KEY + "is_bunched:b is_gap:b", "SELECT * FROM hw")
def _(t):
    return t.hw


@check("p09_calendar", KEY + "hour_of_day:i day_of_week:i month_of_year:i", "SELECT * FROM hw")
def _(t):
    return headway.with_calendar(headway.with_event_ts(t.events))


@check("p10_split_by_month", KEY + "split:s", "SELECT * FROM trips")
def _(t):
    return select.with_split(t.events)


@check("p11_peak", KEY + "peak:b", "SELECT *, hour_of_day IN (7, 8, 16, 17) AS peak FROM hw")
def _(t):
    return headway.with_calendar(headway.with_event_ts(t.events)).withColumn("peak", select.is_peak())


@check("p12_route_position", KEY + "route_frac:f fifth:i tenth:i",
       """SELECT *, CAST(stop_sequence - first_seq AS DOUBLE) / nullif(last_seq - first_seq, 0) AS route_frac,
          CASE WHEN last_seq > first_seq THEN least(4, (5 * (stop_sequence - first_seq)) // (last_seq - first_seq)) END
              AS fifth,
          CASE WHEN last_seq > first_seq THEN least(9, (10 * (stop_sequence - first_seq)) // (last_seq - first_seq)) END
              AS tenth FROM timed""")
def _(t):
    df = select.with_route_frac(headway.with_trip_bounds(t.events))
    return df.withColumns({"fifth": select.route_bin(5), "tenth": select.route_bin(10)})


@check("p13_training_frame",
       KEY + "headway_ratio:f temperature_2m_sq:f is_interchange:f under_active_alert:f LineNumber:s direction_id:s y:i",
       """SELECT date, trip_id, stop_sequence, headway_ratio, temperature_2m * temperature_2m AS temperature_2m_sq,
          is_interchange::INT AS is_interchange, under_active_alert::INT AS under_active_alert, LineNumber,
          direction_id, y_k3 AS y FROM ds WHERE split = 'train' AND y_k3 IS NOT NULL""")
def _(t):
    df = select.training_frame(t.ds, 3, "train", keep=["date", "trip_id", "stop_sequence"])
    return df.withColumn("stop_sequence", F.col("meta_stop_sequence"))


@check("p14_abs_features",
       KEY + "abs_headway_ratio:f near0_headway_ratio:f abs_headway_ratio_lag1:f near0_headway_ratio_lag1:f "
             "abs_headway_ratio_lag3:f near0_headway_ratio_lag3:f abs_closing_speed_3:f",
       "SELECT date, trip_id, stop_sequence, " + ", ".join(
           f"abs({c}) AS abs_{c}, CAST(abs({c}) < 0.25 AS INT) AS near0_{c}"
           for c in ("headway_ratio", "headway_ratio_lag1", "headway_ratio_lag3")) +
       ", abs(closing_speed_3) AS abs_closing_speed_3 FROM trips")
def _(t):
    return select.with_abs_features(t.trips)


@check("p15_feature_set", K(f"{c}:f" for c in select.EXTRA_GROUPS["long_lags"] + select.EXTRA_GROUPS["leader"]) + " y:i",
       "SELECT e.*, y_k5 AS y FROM trips JOIN extra e USING (date, trip_id, stop_sequence) WHERE y_k5 IS NOT NULL")
def _(t):
    wanted = [c for c in select.feature_set("no_month+all")
              if c in select.EXTRA_GROUPS["long_lags"] + select.EXTRA_GROUPS["leader"]]
    return select.training_frame(enrich.join_features(t.trips, t.extra), 5, columns=wanted)


@check("p16_split_by_trip", KEY + "split:s",
       """SELECT *, CASE WHEN part <= 74 THEN 'train' WHEN part <= 84 THEN 'val' ELSE 'test' END AS split FROM (
          SELECT *, CAST('0x' || substr(md5(date || '-' || trip_id), 1, 8) AS BIGINT) % 100 AS part FROM trip_stop)""")
def _(t):
    return select.with_split(t.events, "trip")


@check("p16_split_by_week", KEY + "split:s",
       """SELECT *, CASE WHEN part <= 5 THEN 'train' WHEN part <= 6 THEN 'val' ELSE 'test' END AS split FROM (
          SELECT *, ((dayofyear(midnight) - 1) // 7) % 8 AS part FROM stamped)""")
def _(t):
    return select.with_split(t.events, "week")


# --- functions -------------------------------------------------------------------------------------------------------

@check("f01_service_midnight", KEY + "midnight:t", "SELECT * FROM stamped")
def _(t):
    return t.events.withColumn("midnight", fx.service_midnight("date"))


@check("f02_add_seconds", KEY + "later:t",
       "SELECT *, midnight + to_seconds(scheduled_arrival_time_sfm * 3) AS later FROM stamped")
def _(t):
    return t.events.withColumn("later", fx.add_seconds(fx.service_midnight("date"),
                                                       F.col("scheduled_arrival_time_sfm") * 3))


@check("f03_local_to_utc", "event_id:i utc:t",
       """SELECT event_id, ((ts + to_days(CAST(event_id % 366 AS INTEGER))) AT TIME ZONE 'Europe/Stockholm')
          AT TIME ZONE 'UTC' AS utc FROM events""")
def _(t):
    shifted = t.raw("events").selectExpr(
        "event_id", "cast(ts AS timestamp_ntz) + make_dt_interval(cast(event_id % 366 AS int)) AS ts")
    return shifted.withColumn("utc", fx.local_to_utc("ts", "Europe/Stockholm"))


@check("f03_local_to_utc_clock_change", "event_id:i utc:t",
       """SELECT event_id, ((TIMESTAMP '2024-10-27 00:00:00' + to_seconds(event_id * 7 % 14400))
          AT TIME ZONE 'Europe/Stockholm') AT TIME ZONE 'UTC' AS utc FROM events""")
def _(t):
    """Every instant of the night on which the clocks go back."""
    night = t.raw("events").select("event_id", fx.add_seconds(
        F.expr("TIMESTAMP_NTZ'2024-10-27 00:00:00'"), F.col("event_id") * 7 % 14400).alias("ts"))
    return night.withColumn("utc", fx.local_to_utc("ts", "Europe/Stockholm"))


@check("f04_calendar_parts", "event_id:i hour_start:t dow:i",
       "SELECT event_id, date_trunc('hour', ts) AS hour_start, dayofweek(ts) AS dow FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp_ntz")
    return t.raw("events").select("event_id", fx.hour_floor(ts).alias("hour_start"), fx.dow0(ts).alias("dow"))


@check("f05_bucket", KEY + "fine:f coarse:f tenth:f",
       """SELECT *, round(headway_ratio * 20) / 20 AS fine, round(delay_growth / 5.0::DOUBLE) * 5 AS coarse,
          round(speed_mps * 10) / 10 AS tenth FROM hw""")
def _(t):
    return t.hw.withColumns({"fine": fx.bucket("headway_ratio", 0.05), "coarse": fx.bucket("delay_growth", 5),
                             "tenth": fx.bucket("speed_mps", 0.1)})


@check("f06_clamp", KEY + "clamped:f",
       "SELECT *, CASE WHEN headway_ratio IS NOT NULL THEN greatest(-1, least(3, headway_ratio)) END AS clamped FROM hw")
def _(t):
    return t.hw.withColumn("clamped", fx.clamp("headway_ratio", -1.0, 3.0))


@check("f07_safe_div", KEY + "q:f", "SELECT *, CAST(headway_obs AS DOUBLE) / nullif(delay_growth, 0) AS q FROM hw")
def _(t):
    return t.hw.withColumn("q", fx.safe_div("headway_obs", "delay_growth"))


@check("f08_temp_bin", "grid_lat:f grid_lon:f ts_utc:t temp_bin:s", "SELECT * FROM weather")
def _(t):
    return t.hourly.withColumn("temp_bin", fx.temp_bin("temperature_2m"))


@check("f09_wx_group", "grid_lat:f grid_lon:f ts_utc:t wx_group:s", "SELECT * FROM weather")
def _(t):
    return t.hourly.withColumn("wx_group", fx.wx_group("weather_code"))


@check("f10_weather_flags", "grid_lat:f grid_lon:f ts_utc:t is_precip:b is_snowing:b ice_risk:b",
       "SELECT * FROM weather")
def _(t):
    return t.weather


@check("f11_grid_key", "stop_id:i lat_key:i lon_key:i",
       "SELECT stop_id, round(stop_lat * 10) AS lat_key, round(stop_lon * 10) AS lon_key FROM stops")
def _(t):
    return t.stops.select("stop_id", fx.grid_key("stop_lat").alias("lat_key"), fx.grid_key("stop_lon").alias("lon_key"))


@check("f12_mercator", "stop_id:i x:g y:g tx:g ty:g",
       """SELECT stop_id, radians(stop_lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(stop_lat) / 2)) * 6378137 AS y,
          (stop_lon + 180) / 360 * 8192 AS tx,
          (1 - asinh(tan(radians(stop_lat))) / pi()) / 2 * 8192 AS ty FROM stops""")
def _(t):
    return t.stops.select("stop_id", fx.web_mercator_x("stop_lon").alias("x"), fx.web_mercator_y("stop_lat").alias("y"),
                          fx.tile_x("stop_lon", 13).alias("tx"), fx.tile_y("stop_lat", 13).alias("ty"))


# --- joins -----------------------------------------------------------------------------------------------------------

@check("j01_two_headway_orders", KEY + "headway_obs:i headway_obs_orderdef:i", "SELECT * FROM hw")
def _(t):
    return t.hw


@check("j02_stop_grid", KEY + "grid_lat:f grid_lon:f has_parent_station:b", "SELECT * FROM placed")
def _(t):
    return enrich.with_stop_grid(t.events, t.stops)


@check("j03_weather", KEY + "temperature_2m:f precipitation:f precip_3h:f wx_group:s temp_bin:s wind_speed_10m:f",
       "SELECT * FROM ds")
def _(t):
    placed = enrich.with_stop_grid(headway.with_event_ts(t.events), t.stops)
    return enrich.with_weather(placed, t.weather)


@check("j04_route_counts", KEY + "n_routes_serving:i", "SELECT * FROM ds")
def _(t):
    return enrich.with_route_counts(t.events, t.counts)


@check("j05_interchange", KEY + "is_interchange:b", "SELECT * FROM ds")
def _(t):
    return enrich.flag_interchange(t.events, t.transfers)


@check("j06_active_alert", KEY + "under_active_alert:b", "SELECT * FROM ds")
def _(t):
    return enrich.flag_active(headway.with_event_ts(t.events), t.alerts)


@check("j07_train_medians", "observed_stop_id:i typical_train:f", "SELECT * FROM train_median")
def _(t):
    return features.stop_medians(t.hw.filter("month_of_year <= 9"), "dwell", "typical_train")


@check("j08_leader_state", KEY + "leader_headway_ratio:f leader_speed:f", "SELECT * FROM xbase")
def _(t):
    return enrich.with_leader_state(t.hw)


@check("j08_leader_state_by_join", KEY + "leader_headway_ratio:f leader_speed:f", "SELECT * FROM xbase")
def _(t):
    return enrich.leader_state_by_join(t.hw)


@check("j09_join_features", KEY + "headway_ratio:f y_k5:i headway_ratio_lag5:f dwell_sum_3:i",
       "SELECT * FROM trips JOIN extra USING (date, trip_id, stop_sequence)")
def _(t):
    return enrich.join_features(t.trips, t.extra)


LINE_PATH_CTES = {
    "variants": "SELECT LineNumber, direction_id, shape_id, count(*) AS n FROM trip_stop GROUP BY ALL",
    "favourite": """SELECT * FROM variants QUALIFY row_number() OVER (
        PARTITION BY LineNumber, direction_id ORDER BY n DESC, shape_id) = 1""",
}
LINE_PATH_SQL = """SELECT LineNumber, direction_id, observed_stop_id, median(stop_sequence) AS place,
    any_value(stop_lat) AS stop_lat, any_value(stop_lon) AS stop_lon
    FROM trip_stop SEMI JOIN favourite USING (LineNumber, direction_id, shape_id)
    JOIN stops ON observed_stop_id = stop_id GROUP BY LineNumber, direction_id, observed_stop_id"""
LINE_PATH = "LineNumber:s direction_id:i observed_stop_id:i place:f stop_lat:f stop_lon:f"


@check("j11_line_paths", LINE_PATH, LINE_PATH_SQL, **LINE_PATH_CTES)
def _(t):
    return describe.line_paths(t.events, t.stops)


# --- windows ---------------------------------------------------------------------------------------------------------

@check("w01_trip_bounds", KEY + "first_seq:i last_seq:i", "SELECT * FROM timed")
def _(t):
    return headway.with_trip_bounds(t.events)


@check("w02_run_time", KEY + "run_time:i", "SELECT * FROM timed")
def _(t):
    return headway.with_run_time(t.events)


@check("w03_scheduled_headway", KEY + "leader_trip_id:i headway_sched:i headway_obs:i", "SELECT * FROM paired")
def _(t):
    bare = t.events.withColumns({"dwell": F.lit(None).cast("long"), "delay_growth": F.lit(None).cast("long")})
    return headway.scheduled_headway(bare)


@check("w04_leader_columns", KEY + "leader_arrival_delay:i leader_dwell:i leader_delay_growth:i",
       "SELECT * FROM paired")
def _(t):
    return headway.scheduled_headway(headway.with_dwell(headway.with_trip_bounds(t.events)))


@check("w05_observed_headway", KEY + "headway_obs_orderdef:i", "SELECT * FROM paired")
def _(t):
    return headway.observed_headway(t.events)


@check("w06_rel_median", KEY + "dwell_rel_median:f", "SELECT * FROM trips")
def _(t):
    return features.with_rel_median(t.hw)


@check("w07_lags", KEY + "headway_ratio_lag1:f headway_ratio_lag2:f headway_ratio_lag3:f speed_lag1:f speed_lag2:f",
       "SELECT * FROM trips")
def _(t):
    return features.with_lags(features.with_lags(t.hw, "headway_ratio", (1, 2, 3)), "speed_mps", (1, 2), "speed")


@check("w08_closing_speed", KEY + "closing_speed_3:f", "SELECT * FROM trips")
def _(t):
    return features.with_closing(t.hw, 3)


@check("w09_rolling_sum", KEY + "cum_delay_growth_3:i", "SELECT * FROM trips")
def _(t):
    return features.rolling_sum(t.hw, "delay_growth", 3, "cum_delay_growth_3")


@check("w10_targets", KEY + TARGETS, "SELECT * FROM trips")
def _(t):
    return features.with_targets(t.hw)


@check("w10_targets_same_pair", KEY + "y_k3:i",
       """SELECT date, trip_id, stop_sequence, CASE WHEN lead(leader_trip_id, 3) OVER t = leader_trip_id
          THEN y_k3 END AS y_k3 FROM trips WINDOW t AS (PARTITION BY date, trip_id ORDER BY stop_sequence)""")
def _(t):
    return features.with_targets(t.hw, same_pair=True)


@check("w11_long_lags", KEY + "headway_ratio_lag5:f headway_ratio_lag8:f closing_speed_8:f cum_delay_growth_8:i "
                              "dwell_sum_3:i dwell_sum_5:i", "SELECT * FROM extra")
def _(t):
    return features.with_long_lags(t.hw)


@check("w12_sched_run", KEY + "sched_run_5:i sched_run_8:i", "SELECT * FROM extra")
def _(t):
    return features.with_sched_run(t.events)


@check("w13_ahead", KEY + "ahead_med_dwell_5:f ahead_med_dwell_8:f ahead_interchanges_5:i ahead_interchanges_8:i",
       "SELECT * FROM extra")
def _(t):
    return features.with_ahead(enrich.flag_interchange(t.hw, t.transfers))


SEQUENCE = K(f"hr_{i}:f dw_{i}:i dg_{i}:i" for i in range(6))


@check("w14_sequence", KEY + SEQUENCE, "SELECT * FROM seq")
def _(t):
    return features.sequence_frame(t.hw)


@check("w14_sequence_clustered", KEY + SEQUENCE, "SELECT * FROM seq")
def _(t):
    """From headways that are stored in buckets of the trip."""
    path = scratch(t.spark)
    stage = write_clustered(t.hw, f"{path}/headways", "stage_" + path.rsplit("-", 1)[-1].replace("_", "0"),
                            ["date", "trip_id"], ["stop_sequence"], buckets=64)
    return features.sequence_frame(stage)


@check("w14_sequence_packed", KEY + "steps:i first_dwell:f last_ratio:f",
       "SELECT *, 6 AS steps, dw_0 AS first_dwell, hr_5 AS last_ratio FROM seq")
def _(t):
    packed = features.pack_sequence(features.sequence_frame(t.hw), ["hr", "dw", "dg"])
    return packed.withColumns({"steps": F.size("sequence"), "first_dwell": F.col("sequence")[0][1],
                               "last_ratio": F.col("sequence")[5][0]})


@check("w15_precip_3h", "grid_lat:f grid_lon:f ts_utc:t precip_3h:f", "SELECT * FROM weather")
def _(t):
    return t.weather


@check("w18_top_variant", "LineNumber:s direction_id:i shape_id:s n:i", "SELECT * FROM favourite", **LINE_PATH_CTES)
def _(t):
    return describe.line_variants(t.events)


# --- order and samples -----------------------------------------------------------------------------------------------

@check("l01_ordered", KEY + "headway_ratio:f", "SELECT * FROM hw ORDER BY date, trip_id, stop_sequence")
def _(t):
    return describe.ordered(t.hw)


@check("l02_top_n", KEY + "headway_obs:i",
       "SELECT * FROM hw ORDER BY headway_obs DESC NULLS LAST, date, trip_id, stop_sequence LIMIT 25")
def _(t):
    return describe.top_n(t.hw, "headway_obs", 25, ["date", "trip_id", "stop_sequence"])


@check("l03_best_by", "model:s k:i name:s value:f",
       "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY model, k ORDER BY value DESC, name) = 1",
       ledger=LEDGER_SQL)
def _(t):
    return describe.best_by(_trials(t), ["model", "k"], "value")


@check("l04_sample_n", KEY + "LineNumber:s",
       """SELECT * FROM trip_stop ORDER BY md5(concat_ws('|', date, trip_id, stop_sequence, '7')),
          date, trip_id, stop_sequence LIMIT 5000""")
def _(t):
    return describe.sample_n(t.events, ["date", "trip_id", "stop_sequence"], 5000, seed=7)


# --- stage tables ----------------------------------------------------------------------------------------------------

@check("d01_bus_subset", KEY + "LineNumber:s headway_key:s",
       """SELECT *, LineNumber || '/' || direction_id AS headway_key FROM trip_stop
          WHERE LineNumber IN ('4', '117', '541')""")
def _(t):
    return bus_subset(t.events).withColumn("headway_key", F.concat_ws("/", "LineNumber", "direction_id"))


HEADWAYS = KEY + ("event_ts_arr:t event_ts_dep:t sched_event_ts_arr:t first_seq:i last_seq:i run_time:i dwell_raw:i "
                  "delay_growth:i dwell:i dwell_negative_flag:b speed_mps:f leader_trip_id:i headway_sched:i "
                  "headway_obs:i leader_arrival_delay:i leader_dwell:i leader_delay_growth:i headway_obs_orderdef:i "
                  "headway_obs_invalid:b headway_ratio:f headway_ratio_obsorder:f hour_of_day:i day_of_week:i "
                  "month_of_year:i is_bunched:b is_gap:b")


@check("d02_headways", HEADWAYS, "SELECT * FROM hw")
def _(t):
    return t.hw


@check("d03_weather_features", "grid_lat:f grid_lon:f ts_utc:t is_precip:b precip_3h:f is_snowing:b ice_risk:b "
                               "temp_bin:s wx_group:s", "SELECT * FROM weather")
def _(t):
    return t.weather


MODEL = KEY + ("LineNumber:s direction_id:i observed_stop_id:i event_ts_arr:t hour_of_day:i headway_ratio:f "
               "is_bunched_now:b dwell:i dwell_rel_median:f speed_mps:f leader_trip_id:i route_frac:f "
               "headway_ratio_lag1:f headway_ratio_lag2:f headway_ratio_lag3:f closing_speed_3:f cum_delay_growth_3:i "
               "speed_lag1:f speed_lag2:f grid_lat:f grid_lon:f has_parent_station:b temperature_2m:f precipitation:f "
               "is_precip:b precip_3h:f is_snowing:b ice_risk:b temp_bin:s wx_group:s wind_speed_10m:f "
               "n_routes_serving:i is_interchange:b under_active_alert:b split:s ") + TARGETS


@check("d04_model_dataset", MODEL, "SELECT * FROM ds")
def _(t):
    return t.ds


@check("d05_extra_features", KEY + K(f"{c}:f" for g in select.EXTRA_GROUPS.values() for c in g), "SELECT * FROM extra")
def _(t):
    return t.extra


@check("d06_sequence_dataset", KEY + SEQUENCE + " split:s " + K(f"y_k{k}:i" for k in HORIZONS), "SELECT * FROM seq")
def _(t):
    return t.sequences


SEQ_STATS = {
    "steps": "SELECT split, unnest([" + ", ".join(
        f"{{'hr': hr_{i}, 'dw': dw_{i}, 'dg': dg_{i}}}" for i in range(6)) + "]) AS v FROM seq WHERE split = 'train'",
    "moments": "SELECT " + ", ".join(
        f"avg(v.{s}) AS {s}_mean, stddev_pop(v.{s}) + 1e-6::DOUBLE AS {s}_std" for s in ("hr", "dw", "dg")) + " FROM steps",
}


@check("d07_sequence_statistics", "hr_mean:f hr_std:f dw_mean:f dw_std:f dg_mean:f dg_std:f", "SELECT * FROM moments",
       **SEQ_STATS)
def _(t):
    return sequence_statistics(t.sequences)


@check("d07_standardize_sequence", KEY + "hr_0:h hr_5:h dw_2:h dg_5:h observed_0:f observed_5:f",
       """SELECT date, trip_id, stop_sequence, coalesce((hr_0 - hr_mean) / hr_std, 0) AS hr_0,
          coalesce((hr_5 - hr_mean) / hr_std, 0) AS hr_5, coalesce((dw_2 - dw_mean) / dw_std, 0) AS dw_2,
          coalesce((dg_5 - dg_mean) / dg_std, 0) AS dg_5, CAST(hr_0 IS NOT NULL AS INT) AS observed_0,
          CAST(hr_5 IS NOT NULL AS INT) AS observed_5 FROM seq CROSS JOIN (SELECT * FROM moments)""", **SEQ_STATS)
def _(t):
    return standardize_sequence(t.sequences)


@check("d08_line_paths", LINE_PATH, LINE_PATH_SQL, **LINE_PATH_CTES)
def _(t):
    return describe.line_paths(t.events, t.stops)
