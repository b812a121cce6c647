"""Descriptive aggregates."""

from __future__ import annotations

from checks.base import check
from evengap import HORIZONS
from evengap.operators import describe, enrich
from evengap.roles import PEAK_HOURS

VALID = "headway_ratio IS NOT NULL"
POSITIVE = "headway_obs > 0 AND headway_obs < 3600"
CV = "stddev(headway_obs) / avg(headway_obs)"
PEAK = f"hour_of_day IN {PEAK_HOURS}"


def pct(cond: str, total: str = "count(*)") -> str:
    return f"100.0::DOUBLE * count(*) FILTER ({cond}) / nullif({total}, 0)"


@check("a01_inventory", "LineNumber:s n_rows:i n_trips:i n_days:i",
       """SELECT LineNumber, count(*) AS n_rows, count(DISTINCT trip_id) AS n_trips, count(DISTINCT date) AS n_days
          FROM trip_stop GROUP BY LineNumber""")
def _(t):
    return describe.inventory(t.events)


@check("a02_headway_modes", "headway_sched:i n:i",
       """SELECT headway_sched, count(*) AS n FROM hw WHERE headway_sched IS NOT NULL GROUP BY headway_sched
          ORDER BY n DESC, headway_sched LIMIT 10""")
def _(t):
    return describe.headway_modes(t.hw)


@check("a03_quality_profile", "pct_null:f pct_negative:f pct_over_3h:f pct_below_bound:f pct_overtake:f total:i",
       f"""SELECT {pct('headway_obs IS NULL')} AS pct_null, {pct('headway_obs < 0')} AS pct_negative,
           {pct('headway_obs > 10800')} AS pct_over_3h, {pct('headway_obs < -1800')} AS pct_below_bound,
           {pct('headway_obs BETWEEN -1800 AND -1')} AS pct_overtake, count(*) AS total FROM hw""")
def _(t):
    return describe.quality_profile(t.hw)


@check("a04_base_rate", "LineNumber:s pct_bunched:f pct_gap:f n_valid:i",
       f"""SELECT LineNumber, {pct('is_bunched', 'count(headway_ratio)')} AS pct_bunched,
           {pct('is_gap', 'count(headway_ratio)')} AS pct_gap, count(headway_ratio) AS n_valid
           FROM hw GROUP BY LineNumber""")
def _(t):
    return describe.base_rate(t.hw)


@check("a05_threshold_sweep", "thr_020:f thr_025:f thr_033:f thr_050:f",
       "SELECT " + ", ".join(f"{pct(f'abs(headway_ratio) < {x}', 'count(headway_ratio)')} AS thr_{round(x * 100):03d}"
                             for x in (0.2, 0.25, 0.33, 0.5)) + " FROM hw")
def _(t):
    return describe.threshold_sweep(t.hw)


@check("a06_definition_disagreement", "pct_disagree_overall:f pct_bunched_missed_by_observed_order:f",
       f"""SELECT {pct('a <> b')} AS pct_disagree_overall,
           {pct('a AND NOT b', 'count(*) FILTER (a)')} AS pct_bunched_missed_by_observed_order
           FROM (SELECT abs(headway_ratio) < 0.25 AS a, abs(headway_ratio_obsorder) < 0.25 AS b FROM hw)
           WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    return describe.definition_disagreement(t.hw)


@check("a07_dwell_profile", "pct_dwell_null:f mean_dwell:f median_dwell:f pct_dwell_negative:f",
       f"""SELECT {pct('dwell IS NULL')} AS pct_dwell_null, avg(dwell) AS mean_dwell, median(dwell) AS median_dwell,
           {pct('dwell_negative_flag')} AS pct_dwell_negative FROM hw""")
def _(t):
    return describe.dwell_profile(t.hw)


@check("a08_split_profile", "split:s n:i first_day:i last_day:i",
       "SELECT split, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM trips GROUP BY split")
def _(t):
    return describe.split_profile(t.trips)


@check("a09_target_profile", "k:i n_valid:i pct_positive:f", " UNION ALL ".join(
    f"SELECT {k} AS k, count(*) FILTER (target_valid_k{k}) AS n_valid, "
    f"100.0::DOUBLE * sum(y_k{k}) / nullif(count(*) FILTER (target_valid_k{k}), 0) AS pct_positive FROM trips"
    for k in HORIZONS))
def _(t):
    return describe.target_profile(t.trips)


@check("a10_coverage", "pct_weather_missing:f pct_alert:f pct_interchange:f n_lag_without_current:i",
       f"""SELECT {pct('temperature_2m IS NULL')} AS pct_weather_missing, {pct('under_active_alert')} AS pct_alert,
           {pct('is_interchange')} AS pct_interchange,
           count(*) FILTER (headway_ratio_lag1 IS NOT NULL AND headway_ratio IS NULL) AS n_lag_without_current
           FROM ds""")
def _(t):
    return describe.coverage(t.ds)


PROFILED = ["headway_ratio", "dwell", "speed_mps", "leader_trip_id", "closing_speed_3", "temperature_2m", "wx_group"]


@check("a11_null_profile", "column_name:s pct_null:f", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {pct(f'{c} IS NULL')} AS pct_null FROM ds" for c in PROFILED))
def _(t):
    return describe.null_profile(t.ds, PROFILED)


@check("a11_key_profile", "n_rows:i n_keys:i",
       "SELECT count(*) AS n_rows, count(DISTINCT (date, trip_id, stop_sequence)) AS n_keys FROM trips")
def _(t):
    return describe.key_profile(t.trips)


@check("a12_hourly_coverage", "lat_key:i lon_key:i hours_present:i hours_missing:i",
       """SELECT glat AS lat_key, glon AS lon_key, count(DISTINCT ts_utc) AS hours_present,
          366 * 24 - count(DISTINCT ts_utc) AS hours_missing FROM hourly GROUP BY glat, glon""")
def _(t):
    return describe.hourly_coverage(t.hourly)


@check("a13_stop_route_counts", "observed_stop_id:i n_routes_serving:i", "SELECT * FROM counts")
def _(t):
    return describe.stop_route_counts(t.events, 1)


@check("a14_line_variants", "LineNumber:s direction_id:i shape_id:s n:i",
       """SELECT LineNumber, direction_id, shape_id, count(*) AS n FROM trip_stop
          GROUP BY LineNumber, direction_id, shape_id QUALIFY row_number() OVER (PARTITION BY LineNumber, direction_id ORDER BY count(*) DESC, shape_id) = 1""")
def _(t):
    return describe.line_variants(t.events)


CV_SQL = f"""SELECT LineNumber, stop_sequence, {CV} AS cv, count(*) AS n FROM hw WHERE {POSITIVE}
    GROUP BY LineNumber, stop_sequence HAVING count(*) >= 30"""


@check("a15_cv_by_stop", "LineNumber:s stop_sequence:i cv:f n:i", CV_SQL)
def _(t):
    return describe.cv_by_stop(t.hw)


RATE = f"100 * avg(is_bunched_now::INT) AS pct_bunched, count(*) AS n FROM trips WHERE {VALID}"


@check("a16_rate_by_hour", "LineNumber:s hour_of_day:i pct_bunched:f n:i",
       f"SELECT LineNumber, hour_of_day, {RATE} AND hour_of_day >= 4 GROUP BY LineNumber, hour_of_day")
def _(t):
    return describe.rate_by_hour(t.trips)


@check("a16_rate_matrix", "LineNumber:s " + " ".join(f"h{h:02d}:f" for h in range(4, 24)),
       "SELECT LineNumber, " + ", ".join(
           f"100 * avg(is_bunched_now::INT) FILTER (hour_of_day = {h}) AS h{h:02d}" for h in range(4, 24)) +
       f" FROM trips WHERE {VALID} AND hour_of_day >= 4 GROUP BY LineNumber")
def _(t):
    return describe.rate_matrix(t.trips)


@check("a17_rate_by_month", "month_of_year:i pct_bunched:f n:i",
       f"SELECT month_of_year, {RATE} GROUP BY month_of_year")
def _(t):
    return describe.rate_by(t.trips, "month_of_year")


HOT = f"""SELECT observed_stop_id, pct_bunched, n, stop_lat, stop_lon, stop_name FROM (
    SELECT observed_stop_id, {RATE} GROUP BY observed_stop_id) JOIN stops ON observed_stop_id = stop_id
    WHERE stop_lat IS NOT NULL"""
HOT_SPEC = "observed_stop_id:i pct_bunched:f n:i stop_lat:f stop_lon:f stop_name:s"


@check("a18_hotspots", HOT_SPEC, f"{HOT} AND n >= 50")
def _(t):
    return describe.hotspots(t.trips, t.stops, min_n=50)


@check("a18_top_hotspots", HOT_SPEC, f"{HOT} AND n >= 200 ORDER BY pct_bunched DESC, observed_stop_id LIMIT 5")
def _(t):
    return describe.top_hotspots(t.trips, t.stops, min_n=200)


@check("a19_ratio_histogram", "bucket:f period:s n:i density:f",
       f"""SELECT bucket, period, n, n / (sum(n) OVER (PARTITION BY period) * 0.05::DOUBLE) AS density FROM (
           SELECT round(greatest(least(headway_ratio, 3), -1) * 20) / 20 + 0.0 AS bucket,
               CASE WHEN {PEAK} THEN 'peak' ELSE 'off-peak' END AS period, count(*) AS n
           FROM trips WHERE {VALID} GROUP BY ALL)""")
def _(t):
    return describe.ratio_histogram(t.trips)


@check("a20_dwell_histogram", "bucket:f is_interchange:b n:i density:f",
       """SELECT bucket, is_interchange, n, n / (sum(n) OVER (PARTITION BY is_interchange) * 2.0::DOUBLE) AS density FROM (
          SELECT round(least(dwell, 120) / 2.0::DOUBLE) * 2 AS bucket, is_interchange, count(*) AS n
          FROM ds WHERE dwell >= 0 GROUP BY ALL)""")
def _(t):
    return describe.dwell_histogram(enrich.flag_interchange(t.trips, t.transfers))


@check("a20_dwell_by_stop_type", "is_interchange:b mean_dwell:f median_dwell:f n:i",
       """SELECT is_interchange, avg(dwell) AS mean_dwell, median(dwell) AS median_dwell, count(*) AS n
          FROM ds WHERE dwell >= 0 GROUP BY is_interchange""")
def _(t):
    return describe.dwell_by_stop_type(enrich.flag_interchange(t.trips, t.transfers))


FEEDBACK = "headway_ratio BETWEEN -1 AND 3 AND delay_growth IS NOT NULL"
HIST_2D = f"""SELECT round(least(headway_ratio, 3) * 20) / 20 + 0.0 AS hr_bucket,
    round(greatest(least(delay_growth, 120), -60) / 5.0::DOUBLE) * 5 + 0.0 AS dg_bucket, count(*) AS n
    FROM hw WHERE {FEEDBACK} GROUP BY ALL"""


@check("a21_histogram_2d", "hr_bucket:f dg_bucket:f n:i", HIST_2D)
def _(t):
    return describe.histogram_2d(t.hw)


def _dg(b: int) -> str:
    return f"dg_{'m' if b < 0 else 'p'}{abs(b)}"


@check("a21_histogram_matrix", "hr_bucket:f " + " ".join(f"{_dg(b)}:i" for b in range(-60, 125, 5)),
       "SELECT hr_bucket, " + ", ".join(f"coalesce(sum(n) FILTER (dg_bucket = {b}), 0) AS {_dg(b)}"
                                        for b in range(-60, 125, 5)) + f" FROM ({HIST_2D}) GROUP BY hr_bucket")
def _(t):
    return describe.histogram_matrix(t.hw)


@check("a22_feedback_corr", "pearson_r:f",
       f"SELECT corr(headway_ratio, delay_growth) AS pearson_r FROM hw WHERE {FEEDBACK}")
def _(t):
    return describe.feedback_corr(t.hw)


@check("a23_rate_along_route", "LineNumber:s seg:i pct_bunched:f n:i",
       f"""SELECT LineNumber, seg, 100 * avg(is_bunched::INT) AS pct_bunched, count(*) AS n FROM (
           SELECT *, least(4, (5 * (stop_sequence - first_seq)) // (last_seq - first_seq)) AS seg
           FROM hw WHERE {VALID} AND last_seq > first_seq) GROUP BY GROUPING SETS ((LineNumber, seg), (seg))""")
def _(t):
    return describe.rate_along_route(t.hw)


@check("a24_cv_along_route", "bin:i mean_cv:f mean_cv_without:f",
       f"""SELECT bin, avg(cv) AS mean_cv, avg(cv) FILTER (LineNumber NOT IN ('4', '541')) AS mean_cv_without FROM (
           SELECT LineNumber, least(9, (10 * (stop_sequence - first_seq)) // (last_seq - first_seq)) AS bin, {CV} AS cv
           FROM hw WHERE {POSITIVE} AND last_seq > first_seq GROUP BY ALL) GROUP BY bin""")
def _(t):
    return describe.cv_along_route(t.hw, exclude=["4", "541"])


CV_FLAG = {
    "cv_cells": CV_SQL,
    "cv_flagged": """SELECT *, n < 0.2 * median(n) OVER (PARTITION BY LineNumber) AS low_sample,
        median(n) OVER (PARTITION BY LineNumber) AS median_n FROM cv_cells""",
}


@check("a25_low_sample_stops", "LineNumber:s stop_sequence:i cv:f n:i median_n:f low_sample:b",
       "SELECT * FROM cv_flagged", **CV_FLAG)
def _(t):
    return describe.cv_with_sample_flag(t.hw)


@check("a25_cv_trend", "LineNumber:s cv_start:f cv_end:f",
       """SELECT LineNumber, avg(cv) FILTER (a <= 3) AS cv_start, avg(cv) FILTER (z <= 3) AS cv_end FROM (
          SELECT *, row_number() OVER (PARTITION BY LineNumber ORDER BY stop_sequence) AS a,
              row_number() OVER (PARTITION BY LineNumber ORDER BY stop_sequence DESC) AS z
          FROM cv_flagged WHERE NOT low_sample) GROUP BY LineNumber""", **CV_FLAG)
def _(t):
    return describe.cv_trend(t.hw)


@check("a26_excess_wait", "LineNumber:s mean_headway:f cv:f wait_timetable:f wait_observed:f wait_excess:f",
       f"""SELECT *, mean_headway / 120 AS wait_timetable, mean_headway / 120 * (1 + cv * cv) AS wait_observed,
           mean_headway / 120 * cv * cv AS wait_excess FROM (
           SELECT LineNumber, avg(headway_obs) AS mean_headway, {CV} AS cv FROM hw WHERE {POSITIVE}
           GROUP BY LineNumber)""")
def _(t):
    return describe.excess_wait(t.hw)


@check("a27_cv_cells", "LineNumber:s direction_id:i observed_stop_id:i hour_of_day:i month_of_year:i cv:f n:i",
       f"""SELECT LineNumber, direction_id, observed_stop_id, hour_of_day, month_of_year, {CV} AS cv, count(*) AS n
           FROM hw WHERE {POSITIVE} GROUP BY ALL""")
def _(t):
    return describe.cv_cells(t.hw)


@check("a28_screen_lines", "LineNumber:s n_trips:i n_rows:i median_peak_headway:f pct_missing:f frequent:b rank:i",
       f"""SELECT *, CASE WHEN frequent THEN row_number() OVER (PARTITION BY frequent ORDER BY n_trips DESC, LineNumber)
               END AS rank FROM (
           SELECT LineNumber, count(DISTINCT (date, trip_id)) AS n_trips, count(*) AS n_rows,
               median(headway_sched) FILTER ({PEAK}) AS median_peak_headway,
               {pct('observed_arrival_time_sfm IS NULL')} AS pct_missing,
               coalesce(median(headway_sched) FILTER ({PEAK}) <= 4800, FALSE) AS frequent
           FROM hw GROUP BY LineNumber)""")
def _(t):
    return describe.screen_lines(t.hw, max_headway=4800)


SFM = ["scheduled_arrival_time_sfm", "observed_arrival_time_sfm", "observed_departure_time_sfm"]


@check("a29_sfm_overflow", "column_name:s n_over:i max_value:i", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} > 86400) AS n_over, max({c}) AS max_value FROM trip_stop"
    for c in SFM))
def _(t):
    return describe.sfm_overflow(t.events, SFM)


@check("a30_outage_days", "date:i LineNumber:s pct_missing:f n:i",
       f"""SELECT * FROM (SELECT date, LineNumber, {pct('observed_arrival_time_sfm IS NULL')} AS pct_missing,
           count(*) AS n FROM trip_stop GROUP BY date, LineNumber) WHERE pct_missing > 9""")
def _(t):
    return describe.outage_days(t.events, 9.0, ["LineNumber"])


@check("a31_trip_completeness", "LineNumber:s date:i n_scheduled:i n_observed:i completeness:f",
       """SELECT LineNumber, date, count(*) AS n_scheduled, count(*) FILTER (seen > 0) AS n_observed,
          count(*) FILTER (seen > 0) / count(*) AS completeness FROM (
          SELECT LineNumber, date, trip_id, count(observed_arrival_time_sfm) AS seen FROM trip_stop GROUP BY ALL)
          GROUP BY LineNumber, date""")
def _(t):
    return describe.trip_completeness(t.events)


@check("a32_lead_minutes", "k:i median_run_time:f minutes:f",
       """SELECT unnest([1, 2, 3, 5, 8]) AS k, m AS median_run_time, unnest([1, 2, 3, 5, 8]) * m / 60 AS minutes
          FROM (SELECT median(run_time) AS m FROM hw)""")
def _(t):
    return describe.lead_minutes(t.hw)


@check("a33_grid_points", "grid_lat:f grid_lon:f",
       """SELECT DISTINCT round(stop_lat, 1) AS grid_lat, round(stop_lon, 1) AS grid_lon
          FROM trip_stop LEFT JOIN stops ON observed_stop_id = stop_id""")
def _(t):
    return describe.grid_points(t.events, t.stops)


@check("a34_sequence_gaps", "n_trips:i n_with_gap:i pct_gap:f",
       f"""SELECT count(*) AS n_trips, count(*) FILTER (gap) AS n_with_gap, {pct('gap')} AS pct_gap FROM (
           SELECT date, trip_id, coalesce(bool_or(step <> 1), FALSE) AS gap FROM (
               SELECT date, trip_id, lead(stop_sequence) OVER (PARTITION BY date, trip_id ORDER BY stop_sequence)
                   - stop_sequence AS step FROM trip_stop)
           GROUP BY date, trip_id)""")
def _(t):
    return describe.sequence_gaps(t.events)


@check("a35_split_coverage", "split:s min_temperature:f mean_temperature:f pct_snow:f pct_ice:f",
       f"""SELECT split, min(temperature_2m) AS min_temperature, avg(temperature_2m) AS mean_temperature,
           {pct('is_snowing')} AS pct_snow, {pct('ice_risk')} AS pct_ice FROM ds GROUP BY split""")
def _(t):
    return describe.split_coverage(t.ds)


@check("a36_label_difference", "n_changed:i n_valid:i",
       """SELECT count(*) FILTER ((headway_ratio < 0.25) <> (abs(headway_ratio) < 0.25)) AS n_changed,
          count(headway_ratio) AS n_valid FROM hw""")
def _(t):
    return describe.label_difference(t.hw)


@check("w19_smooth_cv", "LineNumber:s stop_sequence:i cv_smooth:f",
       """SELECT LineNumber, stop_sequence, avg(cv) OVER (PARTITION BY LineNumber ORDER BY stop_sequence
          ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cv_smooth FROM cv_cells""", cv_cells=CV_SQL)
def _(t):
    return describe.smooth_cv(describe.cv_by_stop(t.hw))
