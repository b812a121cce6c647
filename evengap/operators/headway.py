"""Leader / follower headways at a stop, dwell, running time and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.functions import add_seconds, dow0, safe_div, service_midnight
from evengap.operators.skew import GROUP_ROWS, LOOK, along
from evengap.roles import BUNCH_RATIO, DEFAULT, GAP_RATIO, HEADWAY_BOUNDS, Roles


def with_event_ts(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Local timestamps of arrival, departure and scheduled arrival, from service-day seconds."""
    midnight = service_midnight(roles.day)
    return df.withColumns({
        "event_ts_arr": add_seconds(midnight, roles.obs_arr),
        "event_ts_dep": add_seconds(midnight, roles.obs_dep),
        "sched_event_ts_arr": add_seconds(midnight, roles.sched_arr),
    })


def with_trip_bounds(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    return along(df, roles.trip_group, [F.col(roles.seq)], whole=_bounds(roles), limit=limit)


def with_run_time(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    return along(df, roles.trip_group, [F.col(roles.seq)], _run_time(roles), back=1, limit=limit)


def _bounds(roles: Roles) -> dict:
    return {"first_seq": F.min(roles.seq), "last_seq": F.max(roles.seq)}


def _run_time(roles: Roles):
    return lambda w: {"run_time": F.col(roles.obs_arr) - F.lag(roles.obs_dep).over(w)}


def with_trip_context(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Trip bounds and running time in one pass over the trip."""
    return along(df, roles.trip_group, [F.col(roles.seq)], _run_time(roles), _bounds(roles), back=1, limit=limit,
                 hot=hot)


def with_dwell(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Raw and cleaned dwell, its negative flag, and delay growth while standing.

    Cleaned dwell is null at the first and last stop (layover) and when negative.
    """
    raw = F.col(roles.obs_dep) - F.col(roles.obs_arr)
    inside = (F.col(roles.seq) > F.col("first_seq")) & (F.col(roles.seq) < F.col("last_seq"))
    return (df.withColumns({"dwell_raw": raw, "delay_growth": F.col(roles.dep_delay) - F.col(roles.arr_delay)})
            .withColumns({"dwell": F.when(inside & (F.col("dwell_raw") >= 0), F.col("dwell_raw")),
                          "dwell_negative_flag": F.col("dwell_raw") < 0}))


def with_speed(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Metres per second from the previous stop; null unless the running time is positive."""
    return df.withColumn("speed_mps", F.when(F.col("run_time") > 0, safe_div(roles.dist, "run_time")))


def scheduled_headway(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Pair every row with the trip scheduled before it at the same stop.

    Adds the leader's id, the scheduled and observed headway to it, and the
    leader's delay, dwell and delay growth. Equal scheduled times are ordered by
    trip id.
    """
    def columns(w):
        back = lambda c: F.lag(c).over(w)
        return {
            "leader_trip_id": back(roles.trip),
            "headway_sched": F.col(roles.sched_arr) - back(roles.sched_arr),
            "headway_obs": F.col(roles.obs_arr) - back(roles.obs_arr),
            "leader_arrival_delay": back(roles.arr_delay),
            "leader_dwell": back("dwell"),
            "leader_delay_growth": back("delay_growth"),
        }

    order = [F.col(roles.sched_arr).asc_nulls_last(), F.col(roles.trip).asc_nulls_last()]
    return along(df, roles.headway_group, order, columns, back=1, limit=limit, hot=hot)


def observed_headway(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Gap to the vehicle that actually arrived before, whatever the timetable says."""
    order = [F.col(roles.obs_arr).asc_nulls_last(), F.col(roles.trip).asc_nulls_last()]
    return along(df, roles.headway_group, order,
                 lambda w: {"headway_obs_orderdef": F.col(roles.obs_arr) - F.lag(roles.obs_arr).over(w)},
                 back=1, limit=limit, hot=hot)


def with_headway_ratio(df: DataFrame, bounds: tuple[int, int] = HEADWAY_BOUNDS) -> DataFrame:
    """Observed over scheduled headway, for both definitions; null outside the plausible bounds."""
    def valid_ratio(observed: str):
        return F.when((F.col("headway_sched") > 0) & F.col(observed).between(*bounds),
                      safe_div(observed, "headway_sched"))

    return df.withColumns({
        "headway_obs_invalid": ~F.col("headway_obs").between(*bounds),
        "headway_ratio": valid_ratio("headway_obs"),
        "headway_ratio_obsorder": valid_ratio("headway_obs_orderdef"),
    })


def with_calendar(df: DataFrame) -> DataFrame:
    """Hour, day of week (Sunday 0) and month of the scheduled arrival."""
    ts = "sched_event_ts_arr"
    return df.withColumns({"hour_of_day": F.hour(ts), "day_of_week": dow0(ts), "month_of_year": F.month(ts)})


def with_labels(df: DataFrame, bunch: float = BUNCH_RATIO, gap: float = GAP_RATIO) -> DataFrame:
    """Bunched: the vehicles are close, on either side of each other. Gap: a long wait. Null ratio, null label."""
    return df.withColumns({
        "is_bunched": F.abs(F.col("headway_ratio")) < bunch,
        "is_gap": F.col("headway_ratio") > gap,
    })
