"""Column roles and the fixed parameter values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

# Prediction horizons (stops ahead) and label thresholds.
HORIZONS = (1, 2, 3, 5, 8)
BUNCH_RATIO = 0.25
GAP_RATIO = 1.75
HEADWAY_BOUNDS = (-1800, 10800)
PEAK_HOURS = (7, 8, 16, 17)
TIME_ZONE = "Europe/Stockholm"


@dataclass(frozen=True)
class Roles:
    """Names of the columns that describe one stop event."""

    day: str = "date"
    line: str = "LineNumber"
    direction: str = "direction_id"
    trip: str = "trip_id"
    seq: str = "stop_sequence"
    stop: str = "observed_stop_id"
    sched_arr: str = "scheduled_arrival_time_sfm"
    obs_arr: str = "observed_arrival_time_sfm"
    obs_dep: str = "observed_departure_time_sfm"
    arr_delay: str = "observed_arrival_delay"
    dep_delay: str = "observed_departure_delay"
    dist: str = "dist_traveled"

    @property
    def trip_group(self) -> list[str]:
        return [self.day, self.trip]

    @property
    def key(self) -> list[str]:
        return [self.day, self.trip, self.seq]

    @property
    def headway_group(self) -> list[str]:
        return [self.day, self.line, self.direction, self.stop]


DEFAULT = Roles()
