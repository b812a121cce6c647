"""Small hand-made stop events."""

COLUMNS = ("date int, LineNumber string, direction_id int, trip_id bigint, VehicleID bigint, stop_sequence int, "
           "observed_stop_id bigint, dist_traveled double, scheduled_arrival_time_sfm bigint, "
           "observed_arrival_time_sfm bigint, observed_departure_time_sfm bigint, observed_arrival_delay bigint, "
           "observed_departure_delay bigint")


def trip(trip_id, sched, observed, dwell=10, date=20240105, line="4", first_stop=100, step=60, dist=300.0):
    """One trip; ``observed`` holds an arrival per stop or None; every stop is ``step`` seconds apart by timetable."""
    rows = []
    for i, obs in enumerate(observed):
        planned = sched + i * step
        d = dwell[i] if isinstance(dwell, list) else dwell
        seen = obs is not None
        rows.append((date, line, 0, trip_id, trip_id, i + 1, first_stop + i, dist, planned, obs,
                     obs + d if seen else None, obs - planned if seen else None,
                     obs + d - planned if seen else None))
    return rows


def events(spark, *trips):
    return spark.createDataFrame([r for t in trips for r in t], COLUMNS)


def by_key(df, *columns):
    return {(r["trip_id"], r["stop_sequence"]): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.collect()}
