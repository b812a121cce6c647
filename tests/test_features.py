import pytest
from events import by_key, events, trip
from pyspark.sql import functions as F

from evengap.operators import features, select
from evengap.plans import headways, sequence_dataset, standardize_sequence, trip_features


@pytest.fixture(scope="module")
def hw(spark):
    lead = trip(1, 30000, [30000 + 60 * i for i in range(10)])
    # the follower closes in, is bunched from stop 4 on, and is not seen at stop 6
    gaps = [600, 500, 300, 100, 60, None, 30, 20, 200, 400]
    follow = trip(2, 30600, [None if g is None else 30000 + 60 * i + g for i, g in enumerate(gaps)])
    short = trip(3, 31200, [31200, 31260])
    return headways(events(spark, lead, follow, short))


def test_targets_look_ahead_on_the_same_trip(hw):
    got = by_key(features.with_targets(hw), "y_k1", "y_k3", "target_valid_k3", "y_k8", "target_valid_k8")
    assert got[(2, 1)] == (0, 1, True, 0, True)
    assert got[(2, 3)] == (1, None, True, None, False)  # stop 6 is missing, stop 11 does not exist
    assert got[(2, 9)][0] == 0 and got[(2, 10)][0] is None
    assert got[(3, 2)] == (None, None, False, None, False)


def test_target_is_the_label_moved_back(hw):
    df = features.with_targets(hw)
    later = df.select("trip_id", (F.col("stop_sequence") - 2).alias("stop_sequence"), F.col("is_bunched").alias("later"))
    joined = df.join(later, ["trip_id", "stop_sequence"])
    assert joined.filter(~F.col("y_k2").eqNullSafe(F.col("later").cast("int"))).count() == 0


def test_same_pair_needs_the_same_leader(spark):
    # at the second stop trip 9 runs between 1 and 2, so the pair (2, 1) is broken there
    ev = events(spark, trip(1, 30000, [30000, 30060]), trip(2, 30600, [30600, 30660]),
                [r for r in trip(9, 30300, [30300, 30360]) if r[5] == 2])
    hw = headways(ev)
    assert by_key(features.with_targets(hw, (1,)), "y_k1")[(2, 1)] == 0
    assert by_key(features.with_targets(hw, (1,), same_pair=True), "y_k1")[(2, 1)] is None


def test_lags_closing_and_rolling(hw):
    got = by_key(features.with_history(hw), "headway_ratio_lag1", "headway_ratio_lag3", "closing_speed_3",
                 "cum_delay_growth_3")
    assert got[(2, 1)][:3] == (None, None, None)
    assert got[(2, 4)] == (0.5, 1.0, pytest.approx((100 / 600 - 1) / 3), 30)
    assert got[(2, 6)][3] == 20  # the missing stop is skipped


def test_one_stop_trip_has_no_position(spark):
    df = select.with_route_frac(headways(events(spark, trip(1, 30000, [30000]))))
    row = df.withColumn("bin", select.route_bin(5)).first()
    assert row["route_frac"] is None and row["bin"] is None


def test_last_stop_is_in_the_last_bin(hw):
    got = by_key(hw.withColumn("bin", select.route_bin(5)), "bin")
    assert got[(2, 10)] == 4 and got[(2, 1)] == 0


def test_forward_sums_are_null_without_stops_ahead(hw):
    df = features.with_ahead(hw.withColumn("is_interchange", F.col("stop_sequence") % 2 == 0))
    got = by_key(df, "ahead_interchanges_5", "ahead_med_dwell_5")
    assert got[(2, 10)] == (None, None) and got[(2, 1)][0] == 3


def test_leader_gate_and_fit_split(hw):
    gated = by_key(trip_features(hw, gate_leader=True, fit_split="train"), "leader_dwell")
    plain = by_key(trip_features(hw), "leader_dwell")
    assert plain[(2, 3)] == gated[(2, 3)] == 10
    assert plain[(2, 6)] == 10 and gated[(2, 6)] is None  # the follower was not seen, so nor was its gap


def test_feature_sets_hold_no_labels():
    for name in ("current", "engineered", "no_month+all", "delay_only", "dwell_only", "no_leader"):
        assert select.check_leakage(select.feature_set(name))
    with pytest.raises(ValueError):
        select.check_leakage(["dwell", "y_k3"])
    with pytest.raises(ValueError):
        select.feature_set("no_month+nothing")
    assert "month_of_year" not in select.feature_set("no_month+ahead")
    assert not set(select.DWELL_FEATURES) & set(select.feature_set("delay_only"))


def test_near_zero_flag_keeps_null(hw):
    df = select.with_abs_features(features.with_history(hw))
    got = by_key(df, "near0_headway_ratio", "abs_headway_ratio")
    assert got[(2, 6)] == (None, None) and got[(2, 5)][0] == 1.0 and got[(2, 1)][0] == 0.0


def test_sequence_is_oldest_first_and_standardised(hw):
    ds = trip_features(hw)
    seq = sequence_dataset(hw, ds)
    assert by_key(seq, "hr_5", "hr_4", "hr_0")[(2, 5)] == (0.1, pytest.approx(1 / 6), None)
    done = standardize_sequence(seq)
    values = [v for r in done.collect() for i in range(6) for v in (r[f"dg_{i}"],)]
    assert all(v is not None for v in values)
    assert by_key(done, "observed_5", "hr_5")[(2, 6)] == (0.0, 0.0)
    packed = features.pack_sequence(done, ["hr", "dw", "dg", "observed"]).first()["sequence"]
    assert len(packed) == 6 and len(packed[0]) == 4


def test_splits(spark):
    days = spark.createDataFrame([(20240930, 1), (20241001, 1), (20241101, 1), (20240101, 2)], "date int, trip_id long")
    got = {r["date"]: r["split"] for r in select.with_split(days).collect()}
    assert got == {20240930: "train", 20241001: "val", 20241101: "test", 20240101: "train"}
    assert {r["split"] for r in select.with_split(days, "week").collect()} <= {"train", "val", "test"}
    many = spark.range(4000).selectExpr("20240105 AS date", "id AS trip_id")
    shares = {r["split"]: r["n"] / 4000 for r in
              select.with_split(many, "trip").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert shares["train"] == pytest.approx(0.75, abs=0.03) and shares["val"] == pytest.approx(0.10, abs=0.03)
