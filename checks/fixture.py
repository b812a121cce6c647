"""Stop events and their side tables, derived from the driver's tables (formulas: FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evengap import HORIZONS
from evengap.operators import chains, describe, enrich
from evengap.operators.skew import durable, running
from evengap.plans import enrich_events, extra_features, headways, sequence_dataset, trip_features

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


class Tables:
    """Lazy frames of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        # dealt by trip before anything is derived: the shuffle carries no derived column, and tables built from other
        # columns of the events read the same one
        rows = self.raw("lineitem").select(*ORDER).repartition(F.expr("l_orderkey div 4")).selectExpr(
            *ORDER, "l_orderkey div 4 AS trip_id",
            "cast(round(l_extendedprice * 100) AS bigint) % 361 - 175 AS step")
        rows = running(rows, ["trip_id"], [F.col(c) for c in ORDER],
                       {"stop_sequence": F.lit(1), "drift": F.col("step")})
        rows = rows.selectExpr(
            "*", "trip_id % 4 AS ln", "(trip_id div 4) % 2 AS direction_id", "(trip_id div 8) % 40 AS slot",
            "trip_id div 320 AS dslot", "l_partkey % 11 = 0 AS missing",
            "if(l_suppkey % 50 = 1, -3, cast(l_quantity AS bigint)) AS dw")
        rows = rows.selectExpr(
            "*", "16000 + slot * 600 + stop_sequence * 90 + if(slot >= 30, 50000, 0) AS sched",
            "element_at(array('4', '117', '185H', '541'), cast(ln + 1 AS int)) AS LineNumber")
        return rows.selectExpr(
            "20240000 + (dslot % 12 + 1) * 100 + 1 + (dslot div 12) % 28 AS date", "LineNumber",
            "'BUS' AS TransportMode", "direction_id", "trip_id", "trip_id % 997 AS VehicleID",
            "concat(LineNumber, '-', trip_id % 3) AS shape_id", "stop_sequence",
            "cast(300 + (l_suppkey % 7) * 50 AS double) AS dist_traveled",
            "ln * 1000 + direction_id * 100 + stop_sequence AS observed_stop_id",
            "sched AS scheduled_arrival_time_sfm",
            "if(missing, null, sched + drift) AS observed_arrival_time_sfm",
            "if(missing, null, drift) AS observed_arrival_delay",
            "if(missing, null, sched + drift + dw) AS observed_departure_time_sfm",
            "if(missing, null, drift + dw - 20) AS observed_departure_delay")

    @cached_property
    def stops(self) -> DataFrame:
        return self.events.select(F.col("observed_stop_id").alias("stop_id")).distinct().selectExpr(
            "stop_id", "concat('stop_', stop_id) AS stop_name",
            "cast(59.203 AS double) + (stop_id % 11) / 50D AS stop_lat",
            "cast(17.803 AS double) + (stop_id % 13) / 50D AS stop_lon",
            "if(stop_id % 3 = 0, stop_id * 10, null) AS parent_station")

    @cached_property
    def transfers(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "(p_partkey % 4) * 1000 + (p_partkey % 2) * 100 + 1 + p_partkey % 20 AS from_stop_id",
            "(p_partkey % 3) * 1000 + 1 + p_size % 20 AS to_stop_id")

    @cached_property
    def alerts(self) -> DataFrame:
        hit = self.raw("events").filter("event_type = 'error'").selectExpr(
            "event_id", "(user_id % 4) * 1000 + (user_id % 2) * 100 + 1 + event_id % 20 AS stop_id",
            "cast(ts AS timestamp_ntz) + make_dt_interval(cast(30 * (event_id % 11) AS int)) AS start")
        return hit.selectExpr("stop_id", "start", "start + make_dt_interval(0, cast(1 + event_id % 48 AS int)) AS end")

    @cached_property
    def hourly(self) -> DataFrame:
        cells = self.stops.selectExpr("cast(round(stop_lat * 10) AS bigint) AS glat",
                                      "cast(round(stop_lon * 10) AS bigint) AS glon").distinct()
        rows = cells.selectExpr("glat", "glon", "explode(sequence(0, 8783)) AS h").selectExpr(
            "*", "(h * 7919L + glat * 104729L + glon * 1299709L) % 1000003 AS a")
        rows = rows.selectExpr("*", "(a % 450) / 10D - 15D AS temperature_2m",
                               "if((a div 450) % 5 = 0, (a % 37) / 10D, 0D) AS precipitation")
        return rows.selectExpr(
            "glat / 10D AS grid_lat", "glon / 10D AS grid_lon",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts_utc", "temperature_2m", "precipitation",
            "if(temperature_2m < 1, cast(0.7 AS double) * precipitation, 0D) AS snowfall",
            "element_at(array(0, 2, 45, 53, 63, 71, 80, 86, 95, 77), cast(a % 10 + 1 AS int)) AS weather_code",
            "(a % 120) / 10D AS wind_speed_10m")

    @cached_property
    def weather(self) -> DataFrame:
        return enrich.weather_features(self.hourly)

    @cached_property
    def counts(self) -> DataFrame:
        return describe.stop_route_counts(self.events, 1)

    @cached_property
    def hw(self) -> DataFrame:
        return headways(self.events)

    @cached_property
    def trips(self) -> DataFrame:
        """The model table before enrichment."""
        return trip_features(self.hw)

    @cached_property
    def ds(self) -> DataFrame:
        return enrich_events(self.trips, self.stops, self.transfers, self.alerts, self.weather, self.counts)

    @cached_property
    def extra(self) -> DataFrame:
        return extra_features(self.hw, self.transfers)

    @cached_property
    def sequences(self) -> DataFrame:
        return sequence_dataset(self.hw, self.trips)

    def score(self, ds: DataFrame, keep: list[str]) -> DataFrame:
        """Stand-in for a model: closeness of the two vehicles now, and one stop earlier."""
        labels = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"y_k{k}").alias("y"))
                                     for k in HORIZONS])).alias("t")
        closeness = lambda c: 1 / (1 + F.abs(F.col(c)))
        rows = ds.filter(F.col("headway_ratio").isNotNull()).select(
            "date", "trip_id", "stop_sequence", "LineNumber", "hour_of_day", "month_of_year", "split", *keep,
            closeness("headway_ratio").alias("score"), closeness("headway_ratio_lag1").alias("score_b"), labels)
        return (rows.select(*[c for c in rows.columns if c != "t"], "t.k", "t.y")
                .filter(F.col("y").isNotNull()))

    @cached_property
    def scored(self) -> DataFrame:
        return self.score(self.trips, [])

    @cached_property
    def test(self) -> DataFrame:
        return self.scored.filter("split = 'test'")

    @cached_property
    def test_weather(self) -> DataFrame:
        return self.score(self.ds, ["wx_group"]).filter("split = 'test'")

    @cached_property
    def onsets(self) -> DataFrame:
        return chains.chain_onsets(self.trips.filter("split = 'test'"))

    @cached_property
    def test_numbered(self) -> DataFrame:
        """Test scores with the row number of the stop on its trip."""
        return self.score(self.onsets, ["rn"])


class StoredTables(Tables):
    """The same tables with every stage written once and read back, as the stages of a production run are."""

    STAGES = ("events", "hw", "trips", "ds", "extra")

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        for stage in self.STAGES:
            self.__dict__[stage] = durable(getattr(super(), stage))
