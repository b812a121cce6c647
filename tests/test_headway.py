import datetime as dt

import pytest
from events import by_key, events, trip

from evengap.operators import headway
from evengap.plans import headways


def pair(spark, gap_sched, gap_obs):
    """Two trips over three stops; the middle stop is the one looked at."""
    one = trip(1, 30000, [30000, 30060, 30120])
    two = trip(2, 30000 + gap_sched, [30000 + gap_obs, 30060 + gap_obs, 30120 + gap_obs])
    return by_key(headways(events(spark, one, two)), "headway_obs", "headway_ratio", "is_bunched",
                  "headway_obs_invalid", "is_gap")[(2, 2)]


def test_follower_overtakes_by_seconds_is_bunched(spark):
    obs, ratio, bunched, invalid, gap = pair(spark, 600, -10)
    assert (obs, bunched, invalid, gap) == (-10, True, False, False)
    assert ratio == pytest.approx(-10 / 600)


def test_large_overtake_is_valid_but_not_bunched(spark):
    _, ratio, bunched, invalid, _ = pair(spark, 600, -1200)
    assert (ratio, bunched, invalid) == (-2.0, False, False)


@pytest.mark.parametrize("gap,invalid", [(-1801, True), (-1800, False), (10800, False), (10801, True)])
def test_bounds(spark, gap, invalid):
    _, ratio, bunched, flag, _ = pair(spark, 600, gap)
    assert flag is invalid
    assert (ratio is None) is invalid and (bunched is None) is invalid


def test_equal_schedule_gives_no_ratio(spark):
    _, ratio, bunched, _, _ = pair(spark, 0, 30)
    assert ratio is None and bunched is None


def test_time_past_midnight(spark):
    df = headways(events(spark, trip(1, 90000, [90000, 90060])))
    row = df.filter("stop_sequence = 1").first()
    assert row["event_ts_arr"] == dt.datetime(2024, 1, 6, 1, 0)
    assert row["hour_of_day"] == 1 and row["day_of_week"] == 6  # a Saturday


def test_dwell_at_ends_and_negative(spark):
    df = headways(events(spark, trip(1, 30000, [30000, 30060, 30120, 30180], dwell=[5, -3, 7, 9])))
    got = by_key(df, "dwell", "dwell_negative_flag", "dwell_raw")
    assert got[(1, 1)] == (None, False, 5) and got[(1, 4)] == (None, False, 9)
    assert got[(1, 2)] == (None, True, -3) and got[(1, 3)] == (7, False, 7)


def test_missing_observation_also_hides_the_next_headway(spark):
    trips = [trip(1, 30000, [30000, 30060]), trip(2, 30600, [30600, None]), trip(3, 31200, [31200, 31260])]
    got = by_key(headways(events(spark, *trips)), "headway_ratio", "leader_trip_id")
    assert got[(2, 2)] == (None, 1) and got[(3, 2)] == (None, 2)
    assert got[(2, 1)] == (1.0, 1)


def test_ties_in_the_timetable_go_by_trip(spark):
    got = by_key(headways(events(spark, trip(7, 30000, [30000]), trip(3, 30000, [30050]), trip(5, 30000, [30020]))),
                 "leader_trip_id")
    assert got == {(3, 1): None, (5, 1): 3, (7, 1): 5}


def test_observed_order_gap_is_never_negative(spark):
    trips = [trip(1, 30000, [30500]), trip(2, 30600, [30400]), trip(3, 31200, [None]), trip(4, 31800, [31000])]
    got = by_key(headways(events(spark, *trips)), "headway_obs_orderdef")
    assert got == {(2, 1): None, (1, 1): 100, (4, 1): 500, (3, 1): None}


def test_speed_needs_positive_running_time(spark):
    df = headway.with_speed(headway.with_run_time(events(spark, trip(1, 30000, [30000, 30010, 30080]))))
    got = by_key(df, "run_time", "speed_mps")
    assert got[(1, 1)] == (None, None) and got[(1, 2)] == (0, None) and got[(1, 3)] == (60, 5.0)


def test_keys_and_rows_are_kept(spark):
    ev = events(spark, trip(1, 30000, [30000, None, 30120]), trip(2, 30600, [30600, 30660, 30720]))
    out = headways(ev)
    assert out.count() == ev.count() == out.select("date", "trip_id", "stop_sequence").distinct().count()
