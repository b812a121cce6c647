"""The same tables in DuckDB SQL, as named common table expressions.

``with_tables(sql)`` puts in front of a statement whatever tables it names.
"""

from __future__ import annotations

import re

from evengap.functions.weather import TEMP_BINS, WX_CODES
from evengap.roles import HORIZONS

_ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_TRIP = "PARTITION BY date, trip_id ORDER BY stop_sequence"
_PAIR = ("PARTITION BY date, LineNumber, direction_id, observed_stop_id "
         "ORDER BY scheduled_arrival_time_sfm NULLS LAST, trip_id")

_targets = ", ".join(
    f"CASE WHEN lead(headway_ratio, {k}) OVER t IS NOT NULL THEN CAST(lead(is_bunched, {k}) OVER t AS BIGINT) END "
    f"AS y_k{k}, lead(stop_sequence, {k}) OVER t IS NOT NULL AS target_valid_k{k}" for k in HORIZONS)
_groups = " ".join(f"WHEN weather_code IN ({', '.join(map(str, codes))}) THEN '{name}'"
                   for name, codes in WX_CODES.items())
_bins = " ".join(f"WHEN temperature_2m <= {upper} THEN '{label}'" for upper, label in TEMP_BINS)
_scored = " UNION ALL ".join(
    f"SELECT date, trip_id, stop_sequence, LineNumber, hour_of_day, month_of_year, split, {{keep}}"
    f"1 / (1 + abs(headway_ratio)) AS score, 1 / (1 + abs(headway_ratio_lag1)) AS score_b, "
    f"CAST({k} AS BIGINT) AS k, y_k{k} AS y FROM {{src}} WHERE headway_ratio IS NOT NULL AND y_k{k} IS NOT NULL"
    for k in HORIZONS)


def _score(src: str, keep: str = "") -> str:
    return _scored.format(src=src, keep=keep)


def cuts_sql(src: str, by: str = "k", score: str = "score", weight: str = "1") -> str:
    """Cumulative true and false positives at every distinct score of each group."""
    return f"""SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision,
        CAST(tp AS DOUBLE) / nullif(n_pos, 0) AS recall FROM (
        SELECT *, sum(pos) OVER (PARTITION BY {by}) AS n_pos,
            sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
            sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
        FROM (SELECT {by}, {score} AS score, sum({weight} * y) AS pos, sum({weight} * (1 - y)) AS neg
              FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL))"""


def ap_sql(src: str, by: str = "k", score: str = "score", weight: str = "1") -> str:
    return (f"SELECT {by}, sum(pos * precision) / nullif(max(n_pos), 0) AS pr_auc "
            f"FROM ({cuts_sql(src, by, score, weight)}) GROUP BY {by}")


CTES = {
    "li": f"""SELECT *, l_orderkey // 4 AS trip_id,
        row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY {_ROW_ORDER}) AS stop_sequence,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 361 - 175) OVER (
            PARTITION BY l_orderkey // 4 ORDER BY {_ROW_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drift
        FROM lineitem""",
    "li2": """SELECT *, trip_id % 4 AS ln, (trip_id // 4) % 2 AS direction_id, (trip_id // 8) % 40 AS slot,
        trip_id // 320 AS dslot, l_partkey % 11 = 0 AS missing,
        CASE WHEN l_suppkey % 50 = 1 THEN -3 ELSE CAST(l_quantity AS BIGINT) END AS dw FROM li""",
    "li3": """SELECT *, 16000 + slot * 600 + stop_sequence * 90 + CASE WHEN slot >= 30 THEN 50000 ELSE 0 END AS sched,
        ['4', '117', '185H', '541'][ln + 1] AS line FROM li2""",
    "trip_stop": """SELECT 20240000 + (dslot % 12 + 1) * 100 + 1 + (dslot // 12) % 28 AS date, line AS LineNumber,
        'BUS' AS TransportMode, direction_id, trip_id, trip_id % 997 AS VehicleID,
        line || '-' || CAST(trip_id % 3 AS VARCHAR) AS shape_id, stop_sequence,
        CAST(300 + (l_suppkey % 7) * 50 AS DOUBLE) AS dist_traveled,
        ln * 1000 + direction_id * 100 + stop_sequence AS observed_stop_id, sched AS scheduled_arrival_time_sfm,
        CASE WHEN NOT missing THEN sched + drift END AS observed_arrival_time_sfm,
        CASE WHEN NOT missing THEN drift END AS observed_arrival_delay,
        CASE WHEN NOT missing THEN sched + drift + dw END AS observed_departure_time_sfm,
        CASE WHEN NOT missing THEN drift + dw - 20 END AS observed_departure_delay FROM li3""",
    "stops": """SELECT stop_id, 'stop_' || CAST(stop_id AS VARCHAR) AS stop_name,
        CAST(59.203 AS DOUBLE) + (stop_id % 11) / CAST(50 AS DOUBLE) AS stop_lat,
        CAST(17.803 AS DOUBLE) + (stop_id % 13) / CAST(50 AS DOUBLE) AS stop_lon,
        CASE WHEN stop_id % 3 = 0 THEN stop_id * 10 END AS parent_station
        FROM (SELECT DISTINCT observed_stop_id AS stop_id FROM trip_stop)""",
    "transfers": """SELECT (p_partkey % 4) * 1000 + (p_partkey % 2) * 100 + 1 + p_partkey % 20 AS from_stop_id,
        (p_partkey % 3) * 1000 + 1 + p_size % 20 AS to_stop_id FROM part""",
    "alerts": """SELECT stop_id, start_ts, start_ts + to_hours(CAST(1 + event_id % 48 AS INTEGER)) AS end_ts FROM (
        SELECT event_id, (user_id % 4) * 1000 + (user_id % 2) * 100 + 1 + event_id % 20 AS stop_id,
               ts + to_days(CAST(30 * (event_id % 11) AS INTEGER)) AS start_ts
        FROM events WHERE event_type = 'error')""",
    "cells": """SELECT DISTINCT CAST(round(stop_lat * 10) AS BIGINT) AS glat,
        CAST(round(stop_lon * 10) AS BIGINT) AS glon FROM stops""",
    "hours": """SELECT glat, glon, h, (h * 7919 + glat * 104729 + glon * 1299709) % 1000003 AS a
        FROM cells, range(0, 8784) AS r(h)""",
    "hourly": """SELECT *, CASE WHEN temperature_2m < 1 THEN CAST(0.7 AS DOUBLE) * precipitation ELSE 0 END AS snowfall
        FROM (SELECT glat, glon, glat / CAST(10 AS DOUBLE) AS grid_lat, glon / CAST(10 AS DOUBLE) AS grid_lon,
            TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(h AS INTEGER)) AS ts_utc,
            (a % 450) / CAST(10 AS DOUBLE) - 15 AS temperature_2m,
            CASE WHEN (a // 450) % 5 = 0 THEN (a % 37) / CAST(10 AS DOUBLE) ELSE 0 END AS precipitation,
            [0, 2, 45, 53, 63, 71, 80, 86, 95, 77][a % 10 + 1] AS weather_code,
            (a % 120) / CAST(10 AS DOUBLE) AS wind_speed_10m FROM hours)""",
    "weather": f"""SELECT *, coalesce(precipitation > 0.1, FALSE) AS is_precip,
        coalesce(snowfall > 0, FALSE) AS is_snowing,
        coalesce(temperature_2m < 1 AND precipitation > 0, FALSE) AS ice_risk,
        sum(precipitation) OVER (PARTITION BY glat, glon ORDER BY ts_utc ROWS 2 PRECEDING) AS precip_3h,
        CASE WHEN temperature_2m <= -100 THEN NULL {_bins} END AS temp_bin,
        CASE {_groups} ELSE 'other' END AS wx_group FROM hourly""",
    "counts": """SELECT observed_stop_id, count(DISTINCT LineNumber) AS n_routes_serving
        FROM trip_stop WHERE (date // 100) % 100 = 1 GROUP BY observed_stop_id""",
    "stamped": """SELECT *, midnight + to_seconds(observed_arrival_time_sfm) AS event_ts_arr,
        midnight + to_seconds(observed_departure_time_sfm) AS event_ts_dep,
        midnight + to_seconds(scheduled_arrival_time_sfm) AS sched_event_ts_arr
        FROM (SELECT *, make_timestamp(date // 10000, (date // 100) % 100, date % 100, 0, 0, 0) AS midnight
              FROM trip_stop)""",
    "timed": f"""SELECT *, min(stop_sequence) OVER g AS first_seq, max(stop_sequence) OVER g AS last_seq,
        observed_arrival_time_sfm - lag(observed_departure_time_sfm) OVER ({_TRIP}) AS run_time,
        observed_departure_time_sfm - observed_arrival_time_sfm AS dwell_raw,
        observed_departure_delay - observed_arrival_delay AS delay_growth
        FROM stamped WINDOW g AS (PARTITION BY date, trip_id)""",
    "moved": """SELECT *, CASE WHEN first_seq < stop_sequence AND stop_sequence < last_seq AND dwell_raw >= 0
            THEN dwell_raw END AS dwell, dwell_raw < 0 AS dwell_negative_flag,
        CASE WHEN run_time > 0 THEN dist_traveled / run_time END AS speed_mps FROM timed""",
    "paired": f"""SELECT *, lag(trip_id) OVER p AS leader_trip_id,
        scheduled_arrival_time_sfm - lag(scheduled_arrival_time_sfm) OVER p AS headway_sched,
        observed_arrival_time_sfm - lag(observed_arrival_time_sfm) OVER p AS headway_obs,
        lag(observed_arrival_delay) OVER p AS leader_arrival_delay, lag(dwell) OVER p AS leader_dwell,
        lag(delay_growth) OVER p AS leader_delay_growth,
        observed_arrival_time_sfm - lag(observed_arrival_time_sfm) OVER (
            PARTITION BY date, LineNumber, direction_id, observed_stop_id
            ORDER BY observed_arrival_time_sfm NULLS LAST, trip_id) AS headway_obs_orderdef
        FROM moved WINDOW p AS ({_PAIR})""",
    "hw": """SELECT *, abs(headway_ratio) < 0.25 AS is_bunched, headway_ratio > 1.75 AS is_gap FROM (
        SELECT *, NOT (headway_obs BETWEEN -1800 AND 10800) AS headway_obs_invalid,
            CASE WHEN headway_sched > 0 AND headway_obs BETWEEN -1800 AND 10800
                 THEN CAST(headway_obs AS DOUBLE) / headway_sched END AS headway_ratio,
            CASE WHEN headway_sched > 0 AND headway_obs_orderdef BETWEEN -1800 AND 10800
                 THEN CAST(headway_obs_orderdef AS DOUBLE) / headway_sched END AS headway_ratio_obsorder,
            hour(sched_event_ts_arr) AS hour_of_day, dayofweek(sched_event_ts_arr) AS day_of_week,
            month(sched_event_ts_arr) AS month_of_year FROM paired)""",
    "stop_median": "SELECT observed_stop_id, median(dwell) AS typical FROM hw GROUP BY observed_stop_id",
    "trips": f"""SELECT hw.*, is_bunched AS is_bunched_now, dwell - typical AS dwell_rel_median,
        CAST(stop_sequence - first_seq AS DOUBLE) / nullif(last_seq - first_seq, 0) AS route_frac,
        lag(headway_ratio, 1) OVER t AS headway_ratio_lag1, lag(headway_ratio, 2) OVER t AS headway_ratio_lag2,
        lag(headway_ratio, 3) OVER t AS headway_ratio_lag3,
        (headway_ratio - lag(headway_ratio, 3) OVER t) / 3 AS closing_speed_3,
        sum(delay_growth) OVER ({_TRIP} ROWS 2 PRECEDING) AS cum_delay_growth_3,
        lag(speed_mps, 1) OVER t AS speed_lag1, lag(speed_mps, 2) OVER t AS speed_lag2, {_targets},
        CASE WHEN (date // 100) % 100 <= 9 THEN 'train' WHEN (date // 100) % 100 = 10 THEN 'val'
             ELSE 'test' END AS split
        FROM hw LEFT JOIN stop_median USING (observed_stop_id) WINDOW t AS ({_TRIP})""",
    "placed": """SELECT trips.*, round(stop_lat, 1) AS grid_lat, round(stop_lon, 1) AS grid_lon,
        CAST(round(stop_lat * 10) AS BIGINT) AS glat, CAST(round(stop_lon * 10) AS BIGINT) AS glon,
        parent_station IS NOT NULL AS has_parent_station,
        date_trunc('hour', (event_ts_arr AT TIME ZONE 'Europe/Stockholm') AT TIME ZONE 'UTC') AS ts_utc
        FROM trips LEFT JOIN stops ON observed_stop_id = stop_id""",
    "ds": """SELECT p.*, w.temperature_2m, w.precipitation, w.is_precip, w.precip_3h, w.is_snowing, w.ice_risk,
        w.temp_bin, w.wx_group, w.wind_speed_10m, coalesce(c.n_routes_serving, 1) AS n_routes_serving,
        p.observed_stop_id IN (SELECT from_stop_id FROM transfers UNION SELECT to_stop_id FROM transfers)
            AS is_interchange,
        EXISTS (SELECT 1 FROM alerts a WHERE a.stop_id = p.observed_stop_id
                AND p.event_ts_arr BETWEEN a.start_ts AND a.end_ts) AS under_active_alert
        FROM placed p LEFT JOIN weather w ON p.glat = w.glat AND p.glon = w.glon AND p.ts_utc = w.ts_utc
        LEFT JOIN counts c ON p.observed_stop_id = c.observed_stop_id""",
    "train_median": """SELECT observed_stop_id, median(dwell) AS typical_train FROM hw
        WHERE month_of_year <= 9 GROUP BY observed_stop_id""",
    "xbase": f"""SELECT hw.*, typical_train, CASE WHEN hw.observed_stop_id IN (
            SELECT from_stop_id FROM transfers UNION SELECT to_stop_id FROM transfers) THEN 1 ELSE 0 END AS ic,
        CASE WHEN headway_obs > 0 THEN lag(headway_ratio) OVER p END AS leader_headway_ratio,
        CASE WHEN headway_obs > 0 THEN lag(speed_mps) OVER p END AS leader_speed
        FROM hw LEFT JOIN train_median USING (observed_stop_id) WINDOW p AS ({_PAIR})""",
    "extra": f"""SELECT date, trip_id, stop_sequence, lag(headway_ratio, 5) OVER t AS headway_ratio_lag5,
        lag(headway_ratio, 8) OVER t AS headway_ratio_lag8,
        (headway_ratio - lag(headway_ratio, 8) OVER t) / 8 AS closing_speed_8,
        sum(delay_growth) OVER ({_TRIP} ROWS 7 PRECEDING) AS cum_delay_growth_8,
        sum(dwell) OVER ({_TRIP} ROWS 2 PRECEDING) AS dwell_sum_3,
        sum(dwell) OVER ({_TRIP} ROWS 4 PRECEDING) AS dwell_sum_5, headway_sched AS headway_sched_s,
        lead(scheduled_arrival_time_sfm, 5) OVER t - scheduled_arrival_time_sfm AS sched_run_5,
        lead(scheduled_arrival_time_sfm, 8) OVER t - scheduled_arrival_time_sfm AS sched_run_8,
        leader_headway_ratio, leader_speed,
        sum(typical_train) OVER ({_TRIP} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead_med_dwell_5,
        sum(typical_train) OVER ({_TRIP} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ahead_med_dwell_8,
        sum(ic) OVER ({_TRIP} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead_interchanges_5,
        sum(ic) OVER ({_TRIP} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ahead_interchanges_8
        FROM xbase WINDOW t AS ({_TRIP})""",
    "seq": "SELECT date, trip_id, stop_sequence, split, " + ", ".join(f"y_k{k}" for k in HORIZONS) + ", " + ", ".join(
        f"lag({c}, {5 - i}) OVER t AS {s}_{i}" for i in range(6)
        for s, c in (("hr", "headway_ratio"), ("dw", "dwell"), ("dg", "delay_growth"))) +
        f" FROM trips WINDOW t AS ({_TRIP})",
    "scored": _score("trips"),
    "test": "SELECT * FROM scored WHERE split = 'test'",
    "test_weather": "SELECT * FROM (" + _score("ds", "wx_group, ") + ") WHERE split = 'test'",
    "chain_rows": f"""SELECT *, row_number() OVER t AS rn, lag(is_bunched_now) OVER t AS prev_bunched
        FROM trips WHERE split = 'test' WINDOW t AS ({_TRIP})""",
    "onsets": "SELECT *, coalesce(is_bunched_now AND NOT prev_bunched, FALSE) AS onset FROM chain_rows",
    "test_numbered": _score("onsets", "rn, "),
    # ranking metrics of the test scores, by horizon
    "cuts": cuts_sql("test"),
    "days": "SELECT k, count(DISTINCT date) AS n_days FROM test GROUP BY k",
    "ap": "SELECT k, sum(pos * precision) / max(n_pos) AS pr_auc FROM cuts GROUP BY k",
    "levels": "SELECT unnest([0.9, 0.8, 0.7]) AS level",
    "reached": """SELECT k, CAST(level AS DOUBLE) AS level, min(score) FILTER (precision >= level) AS threshold,
        max(recall) FILTER (precision >= level) AS recall, max(fp) FILTER (precision >= level) AS fp
        FROM cuts, levels GROUP BY k, level""",
    "steady": " UNION ALL ".join(
        f"SELECT {k} AS k, avg(y_k{k}) AS base_rate, count(*) FILTER (is_bunched_now AND y_k{k} = 1) AS tp, "
        f"count(*) FILTER (is_bunched_now AND y_k{k} = 0) AS fp, "
        f"count(*) FILTER (NOT is_bunched_now AND y_k{k} = 1) AS fn, "
        f"count(*) FILTER (NOT is_bunched_now AND y_k{k} = 0) AS tn "
        f"FROM trips WHERE split = 'test' AND is_bunched_now IS NOT NULL" for k in HORIZONS),
}
_NAMES = re.compile(r"\b(" + "|".join(sorted(CTES, key=len, reverse=True)) + r")\b")

_LITERAL = re.compile(r"'[^']*'")


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in _NAMES.findall(_LITERAL.sub("''", sql)):
        if name not in found:
            _needed(CTES[name], found)
            found[name] = None


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement behind the tables it names, each defined once and before its use."""
    found: dict[str, None] = {}
    for text in [*(extra or {}).values(), sql]:
        _needed(text, found)
    parts = [f"{n} AS MATERIALIZED ({q})" for n, q in [*((n, CTES[n]) for n in found), *(extra or {}).items()]]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
