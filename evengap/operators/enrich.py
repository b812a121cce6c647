"""Joins that add columns without changing the number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evengap.functions import grid_key, hour_floor, local_to_utc, temp_bin, wx_group
from evengap.operators.skew import GROUP_ROWS, along
from evengap.roles import DEFAULT, TIME_ZONE, Roles

WEATHER_COLUMNS = ["temperature_2m", "precipitation", "is_precip", "precip_3h", "is_snowing", "ice_risk",
                   "temp_bin", "wx_group", "wind_speed_10m"]


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_stop_grid(df: DataFrame, stops: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Weather grid cell (0.1 degree) of the stop, and whether it belongs to a station."""
    dim = stops.select(F.col("stop_id").alias(roles.stop), F.round("stop_lat", 1).alias("grid_lat"),
                       F.round("stop_lon", 1).alias("grid_lon"), F.col("parent_station").alias("__station"))
    return (df.join(dim, roles.stop, "left")
            .withColumn("has_parent_station", F.col("__station").isNotNull()).drop("__station"))


def weather_features(hourly: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Flags, three-hour precipitation and categories of an hourly weather table.

    A missing measurement makes a flag false, and the rolling sum skips it.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    rolled = along(hourly, ["grid_lat", "grid_lon"], [F.col("ts_utc")],
                   lambda w: {"precip_3h": F.sum("precipitation").over(w.rowsBetween(-2, 0))}, back=2, limit=limit)
    return rolled.withColumns({
        "is_precip": flag(F.col("precipitation") > 0.1),
        "is_snowing": flag(F.col("snowfall") > 0),
        "ice_risk": flag((F.col("temperature_2m") < 1) & (F.col("precipitation") > 0)),
        "temp_bin": temp_bin("temperature_2m"),
        "wx_group": wx_group("weather_code"),
    })


def with_weather(df: DataFrame, weather: DataFrame, zone: str = TIME_ZONE, ts: str = "event_ts_arr") -> DataFrame:
    """Weather of the stop's grid cell in the UTC hour of the event."""
    wx = weather.select(grid_key("grid_lat").alias("__lat"), grid_key("grid_lon").alias("__lon"),
                        F.col("ts_utc").alias("__hour"), *WEATHER_COLUMNS)
    return (df.withColumns({"__lat": grid_key("grid_lat"), "__lon": grid_key("grid_lon"),
                            "__hour": hour_floor(local_to_utc(ts, zone))})
            .join(wx, ["__lat", "__lon", "__hour"], "left").drop("__lat", "__lon", "__hour"))


def with_route_counts(df: DataFrame, counts: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Number of lines serving the stop; 1 where unknown."""
    return (df.join(counts.select(roles.stop, "n_routes_serving"), roles.stop, "left")
            .withColumn("n_routes_serving", F.coalesce("n_routes_serving", F.lit(1).cast("long"))))


def flag_interchange(df: DataFrame, transfers: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Whether the stop is the origin or destination of any transfer."""
    ends = (transfers.select(F.col("from_stop_id").alias(roles.stop))
            .union(transfers.select(F.col("to_stop_id"))).filter(F.col(roles.stop).isNotNull()).distinct()
            .withColumn("__hit", F.lit(True)))
    return (df.join(ends, roles.stop, "left")
            .withColumn("is_interchange", F.col("__hit").isNotNull()).drop("__hit"))


def merged_intervals(intervals: DataFrame, on: str, start: str, end: str,
                     span: tuple[str, str] | None = None) -> DataFrame:
    """Disjoint intervals per key and calendar day covering the same instants.

    Copies and equal starts are merged before the shuffle, so a key with very
    many intervals leaves at most one row per distinct start in a day. ``span``
    (first and last day) keeps open-ended intervals from being spelled out
    beyond the days of the events.
    """
    first, last = F.to_date(start), F.to_date(end)
    if span is not None:
        first, last = F.greatest(first, F.lit(span[0]).cast("date")), F.least(last, F.lit(span[1]).cast("date"))
    day = (intervals.filter((F.col(start) <= F.col(end)) & (first <= last))
           .select(on, start, end, F.explode(F.sequence(first, last)).alias("__day")))
    midnight = F.col("__day").cast("timestamp_ntz")
    clipped = day.select(
        on, "__day", F.greatest(F.col(start).cast("timestamp_ntz"), midnight).alias("__s"),
        F.least(F.col(end).cast("timestamp_ntz"), midnight + F.expr("INTERVAL 1 DAY")).alias("__e"))
    unique = clipped.groupBy(on, "__day", "__s").agg(F.max("__e").alias("__e"))
    w = W.partitionBy(on, "__day").orderBy("__s")
    reached = F.max("__e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = unique.withColumn("__new", (reached.isNull() | (F.col("__s") > reached)).cast("int"))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(on, "__day", "__island").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))


def flag_active(df: DataFrame, intervals: DataFrame, on: str = "observed_stop_id", ts: str = "event_ts_arr",
                start: str = "start", end: str = "end", interval_key: str = "stop_id",
                name: str = "under_active_alert", span: tuple[str, str] | None = None) -> DataFrame:
    """Whether any interval of the key covers the instant, both ends included.

    The range condition runs inside an equi-join on (key, calendar day). The
    intervals are disjoint, so a row meets at most one of them and the left
    join keeps the row count.
    """
    spans = (merged_intervals(intervals, interval_key, start, end, span)
             .select(F.col(interval_key).alias("__key"), F.col("__day").alias("__span_day"), "__s", "__e"))
    rows = df.withColumn("__day", F.to_date(ts))
    cond = ((F.col(on) == F.col("__key")) & (F.col("__day") == F.col("__span_day"))
            & F.col(ts).between(F.col("__s"), F.col("__e")))
    return (rows.join(spans, cond, "left")
            .withColumn(name, F.col("__s").isNotNull())
            .drop("__day", "__key", "__span_day", "__s", "__e"))


def with_leader_state(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """The leader's own ratio and speed at this stop, known only when it came first."""
    order = [F.col(roles.sched_arr).asc_nulls_last(), F.col(roles.trip).asc_nulls_last()]
    first = F.col("headway_obs") > 0
    return along(df, roles.headway_group, order, lambda w: {
        "leader_headway_ratio": F.when(first, F.lag("headway_ratio").over(w)),
        "leader_speed": F.when(first, F.lag("speed_mps").over(w)),
    }, back=1, limit=limit)


def leader_state_by_join(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Same as :func:`with_leader_state`, by a self-join on the leader's id; a cross-check."""
    pair = [roles.day, roles.line, roles.direction, roles.stop]
    leaders = df.select(*pair, F.col(roles.trip).alias("leader_trip_id"),
                        F.col("headway_ratio").alias("__r"), F.col("speed_mps").alias("__v"))
    first = F.col("headway_obs") > 0
    return (df.join(leaders, [*pair, "leader_trip_id"], "left")
            .withColumns({"leader_headway_ratio": F.when(first, F.col("__r")),
                          "leader_speed": F.when(first, F.col("__v"))})
            .drop("__r", "__v"))


def join_features(a: DataFrame, b: DataFrame, how: str = "inner", roles: Roles = DEFAULT) -> DataFrame:
    """Join two feature tables on the row key; columns both have are taken from the first."""
    new = [c for c in b.columns if c not in a.columns]
    return a.join(b.select(*roles.key, *new), roles.key, how)
