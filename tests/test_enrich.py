import datetime as dt

import pytest
from pyspark.sql import functions as F

from evengap import functions as fx
from evengap.operators import enrich

TS = dt.datetime


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("local,utc", [
    (TS(2024, 3, 31, 2, 30), TS(2024, 3, 31, 1, 30)),    # skipped hour
    (TS(2024, 10, 27, 2, 30), TS(2024, 10, 27, 1, 30)),  # repeated hour: the later one
    (TS(2024, 10, 27, 1, 59), TS(2024, 10, 26, 23, 59)),
    (TS(2024, 10, 27, 3, 0), TS(2024, 10, 27, 2, 0)),
    (TS(2024, 7, 1, 12, 0), TS(2024, 7, 1, 10, 0)),
    (TS(2024, 1, 1, 0, 0), TS(2023, 12, 31, 23, 0)),
])
def test_local_to_utc(spark, local, utc):
    df = frame(spark, [(local,)], "ts timestamp_ntz")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.select(fx.local_to_utc("ts", "Europe/Stockholm").alias("u")).first()["u"] == utc
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_temperature_bins_are_right_closed(spark):
    values = [-5.0, 0.0, 25.0, 100.0, 100.5, -100.0, 4.9, 5.1, None]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i int, t double").select("i", fx.temp_bin("t").alias("b"))
    assert [r["b"] for r in df.orderBy("i").collect()] == ["<-5", "-5_0", "15_25", ">25", None, None, "0_5", "5_15", None]


def test_weather_categories(spark):
    df = frame(spark, [(0.0,), (3.2,), (77.0,), (86.0,), (4.0,), (None,)], "c double").select(fx.wx_group("c").alias("g"))
    assert [r["g"] for r in df.collect()] == ["clear", "cloudy", "snow", "snow_showers", "other", "other"]


def test_missing_weather_gives_false_flags(spark):
    hourly = frame(spark, [(59.3, 18.0, TS(2024, 1, 1, h), t, p, s, 71.0) for h, t, p, s in [
        (0, -1.0, 0.2, 0.1), (1, None, None, None), (2, 0.5, 0.1, 0.0), (3, 2.0, 0.4, None)]],
        "grid_lat double, grid_lon double, ts_utc timestamp_ntz, temperature_2m double, precipitation double, "
        "snowfall double, weather_code double")
    got = {r["ts_utc"].hour: r for r in enrich.weather_features(hourly).collect()}
    assert [got[1][c] for c in ("is_precip", "is_snowing", "ice_risk")] == [False] * 3
    assert [got[0][c] for c in ("is_precip", "is_snowing", "ice_risk")] == [True] * 3
    assert got[2]["is_precip"] is False and got[2]["ice_risk"] is True
    assert [got[h]["precip_3h"] for h in range(4)] == pytest.approx([0.2, 0.2, 0.3, 0.5])


def test_interchange_from_either_end(spark):
    ev = frame(spark, [(1,), (2,), (3,), (None,)], "observed_stop_id long")
    tr = frame(spark, [(1, 2), (1, None), (9, 2)], "from_stop_id long, to_stop_id long")
    got = {r[0]: r[1] for r in enrich.flag_interchange(ev, tr).collect()}
    assert got == {1: True, 2: True, 3: False, None: False}


def alerts(spark, *rows):
    return frame(spark, list(rows), "stop_id long, start timestamp_ntz, end timestamp_ntz")


def at(spark, *rows):
    return frame(spark, [(i, s, t) for i, (s, t) in enumerate(rows)],
                 "i int, observed_stop_id long, event_ts_arr timestamp_ntz")


def test_alerts_cover_ends_overlaps_and_nights(spark):
    al = alerts(spark, (1, TS(2024, 1, 1, 8), TS(2024, 1, 1, 10)), (1, TS(2024, 1, 1, 9), TS(2024, 1, 1, 12)),
                (1, TS(2024, 1, 5, 22), TS(2024, 1, 8, 6)), (2, TS(2024, 1, 1, 8), TS(2024, 1, 1, 8)),
                (1, TS(2024, 1, 20, 5), TS(2024, 1, 20, 4)))
    ev = at(spark, (1, TS(2024, 1, 1, 8)), (1, TS(2024, 1, 1, 9, 30)), (1, TS(2024, 1, 1, 12)),
            (1, TS(2024, 1, 1, 12, 0, 1)), (2, TS(2024, 1, 1, 8)), (2, TS(2024, 1, 1, 9)),
            (1, TS(2024, 1, 6, 0)), (1, TS(2024, 1, 7, 13)), (1, TS(2024, 1, 8, 6)), (1, TS(2024, 1, 8, 7)),
            (1, TS(2024, 1, 20, 5)), (1, None), (None, TS(2024, 1, 1, 9)))
    out = enrich.flag_active(ev, al).orderBy("i").collect()
    assert [r["under_active_alert"] for r in out] == [
        True, True, True, False, True, False, True, True, True, False, False, False, False]


def test_many_copies_of_an_alert_match_once(spark):
    al = alerts(spark, *[(1, TS(2024, 1, 1, 8, i % 60), TS(2024, 1, 1, 12)) for i in range(300)])
    assert enrich.merged_intervals(al, "stop_id", "start", "end").count() == 1
    assert enrich.flag_active(at(spark, (1, TS(2024, 1, 1, 9))), al).count() == 1


def test_open_ended_alerts_stop_at_the_span(spark):
    al = alerts(spark, (1, TS(2023, 12, 1), TS(2999, 1, 1)), (1, TS(2030, 1, 1), TS(2031, 1, 1)))
    span = ("2024-01-01", "2024-01-03")
    assert enrich.merged_intervals(al, "stop_id", "start", "end", span).count() == 3
    ev = at(spark, (1, TS(2024, 1, 1)), (1, TS(2024, 1, 3, 23)), (1, TS(2023, 11, 1)))
    flags = [r["under_active_alert"] for r in enrich.flag_active(ev, al, span=span).orderBy("i").collect()]
    assert flags == [True, True, False]


def test_weather_joins_on_the_utc_hour(spark):
    wx = enrich.weather_features(frame(spark, [(59.3, 18.1, TS(2024, 6, 1, h), float(h), 0.0, 0.0, 0.0, 1.0)
                                               for h in range(24)],
        "grid_lat double, grid_lon double, ts_utc timestamp_ntz, temperature_2m double, precipitation double, "
        "snowfall double, weather_code double, wind_speed_10m double"))
    ev = at(spark, (1, TS(2024, 6, 1, 12, 59)), (1, None), (2, TS(2024, 6, 1, 12)))
    stops = frame(spark, [(1, 59.31, 18.12, None), (2, 58.0, 18.12, 5)],
                  "stop_id long, stop_lat double, stop_lon double, parent_station long")
    out = enrich.with_weather(enrich.with_stop_grid(ev, stops), wx).orderBy("i").collect()
    assert [r["temperature_2m"] for r in out] == [10.0, None, None]
    assert [r["has_parent_station"] for r in out] == [False, False, True]


def test_unknown_route_count_is_one(spark):
    ev = frame(spark, [(1,), (2,)], "observed_stop_id long")
    counts = frame(spark, [(1, 4)], "observed_stop_id long, n_routes_serving long")
    assert {r[0]: r[1] for r in enrich.with_route_counts(ev, counts).collect()} == {1: 4, 2: 1}


def test_grid_key_and_mercator(spark):
    row = frame(spark, [(59.3293, 18.0686)], "lat double, lon double").select(
        fx.grid_key("lat").alias("k"), fx.web_mercator_x("lon").alias("x"), fx.web_mercator_y("lat").alias("y"),
        fx.tile_x("lon", 13).alias("tx"), fx.tile_y("lat", 13).alias("ty")).first()
    assert row["k"] == 593
    assert row["x"] == pytest.approx(2011387.4, abs=1) and row["y"] == pytest.approx(8250870.0, abs=1500)
    # both descriptions of the point agree: the tile index is the scaled Mercator position
    half = 20037508.342789244
    assert row["tx"] == pytest.approx((row["x"] + half) / (2 * half) * 8192)
    assert row["ty"] == pytest.approx((half - row["y"]) / (2 * half) * 8192)


def test_safe_div_and_bucket(spark):
    df = frame(spark, [(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(fx.safe_div("a", "b")).collect()] == [None, 0.25, None]
    got = df.select(fx.bucket(F.lit(0.224), 0.05), fx.bucket(F.lit(-7.5), 5), fx.clamp(F.lit(9), 0, 3)).first()
    assert tuple(got) == (0.2, -10.0, 3)
