import numpy as np
import pytest
from pyspark.sql import functions as F

from evengap.operators import chains, evaluate, resample


def scored(spark, rows):
    return spark.createDataFrame([(1, 20241100 + d, int(y), float(s)) for d, y, s in rows],
                                 "k int, date int, y int, score double")


def brute(y, s, w=None):
    """Average precision and cuts by definition, one threshold at a time."""
    y, s = np.asarray(y), np.asarray(s)
    w = np.ones(len(y)) if w is None else np.asarray(w, dtype=float)
    area, before, cuts = 0.0, 0.0, []
    for t in sorted(set(s), reverse=True):
        flag = s >= t
        tp, fp = (w * y)[flag].sum(), (w * (1 - y))[flag].sum()
        precision, recall = (tp / (tp + fp) if tp + fp else 0.0), tp / (w * y).sum()
        area += (recall - before) * precision
        before = recall
        cuts.append((t, precision, recall, tp, fp))
    return area, cuts


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    y = rng.random(600) < 0.2
    s = np.round(np.clip(0.3 * y + rng.random(600) * 0.7, 0, 1), 2)
    return [(int(d), int(a), float(b)) for d, a, b in zip(rng.integers(1, 12, 600), y, s)]


def test_average_precision_with_ties(spark, sample):
    want, cuts = brute([r[1] for r in sample], [r[2] for r in sample])
    df = scored(spark, sample)
    assert evaluate.average_precision(df).first()["pr_auc"] == pytest.approx(want, abs=1e-12)
    got = evaluate.recall_at_precision(df, (0.5,)).first()
    t, p, r = max((c[:3] for c in cuts if c[1] >= 0.5), key=lambda c: (c[2], -c[0]))
    assert (got["threshold"], got["precision"], got["recall"]) == pytest.approx((t, p, r))
    first = next(c for c in cuts if c[3] >= np.ceil(0.7 * sum(x[1] for x in sample)))
    row = evaluate.at_recall(df, (0.7,)).first()
    assert (row["threshold"], row["true_alarms"], row["false_alarms"]) == (first[0], first[3], first[4])
    assert row["false_alarms_per_day"] == pytest.approx(first[4] / len({x[0] for x in sample}))


def test_weighted_average_precision(spark, sample):
    w = [1 + (i % 3) for i in range(len(sample))]
    want, _ = brute([r[1] for r in sample], [r[2] for r in sample], w)
    rows = [(1, 20241101, y, s, float(v)) for (_, y, s), v in zip(sample, w)]
    df = spark.createDataFrame(rows, "k int, date int, y int, score double, w double")
    assert evaluate.average_precision(df, weight="w").first()["pr_auc"] == pytest.approx(want, abs=1e-12)


def test_all_scores_tied(spark):
    df = scored(spark, [(1, i % 4 == 0, 0.5) for i in range(20)])
    assert evaluate.score_cuts(df).count() == 1
    assert evaluate.average_precision(df).first()["pr_auc"] == 0.25


def test_precision_never_reached_is_null(spark):
    df = scored(spark, [(1, 0, 0.9), (1, 1, 0.5), (2, 0, 0.4)])
    row = evaluate.recall_at_precision(df, (0.8,)).first()
    assert row["recall"] is None and row["threshold"] is None and row["level"] == 0.8
    assert evaluate.at_precision(df, (0.8,)).first()["false_alarms_per_day"] is None


def test_no_positives(spark):
    df = scored(spark, [(1, 0, 0.9), (1, 0, 0.5)])
    assert evaluate.average_precision(df).first()["pr_auc"] is None
    assert evaluate.summary(df).first()["n"] == 2
    assert evaluate.pr_curve(df).count() == 0


def test_small_groups_are_left_out(spark):
    rows = [(1, 1, 0.5 + i / 100) for i in range(19)] + [(1, 0, 0.1)] * 5
    df = scored(spark, rows).withColumn("line", F.lit("a"))
    df = df.unionByName(scored(spark, rows + [(1, 1, 0.3)]).withColumn("line", F.lit("b")))
    assert [r["line"] for r in evaluate.by_group(df, "line").collect()] == ["b"]


def test_score_one_is_in_the_last_bin(spark):
    df = scored(spark, [(1, 1, 1.0), (1, 0, 0.95), (1, 0, 0.0)])
    assert {r["bin"]: r["n"] for r in evaluate.reliability(df).collect()} == {9: 2, 0: 1}


def test_pr_curve_is_the_best_reachable_precision(spark, sample):
    _, cuts = brute([r[1] for r in sample], [r[2] for r in sample])
    got = {round(r["recall"] * 100): r["precision"] for r in evaluate.pr_curve(scored(spark, sample)).collect()}
    assert len(got) == 101 and got[0] == 1.0
    for j in range(1, 101):
        assert got[j] == pytest.approx(max(p for _, p, r, *_ in cuts if r >= j / 100))


def test_unit_weights_give_the_plain_metric(spark, sample):
    df = scored(spark, sample)
    want, cuts = brute([r[1] for r in sample], [r[2] for r in sample])
    for size in (7, 20_000):
        got = resample.bootstrap_metrics(df, 3, level=0.5, slice_cells=size, weigh=resample.unit_weights).collect()
        assert len(got) == 3
        for r in got:
            assert r["pr_auc"] == pytest.approx(want, abs=1e-12)
            assert r["recall"] == pytest.approx(max(c[2] for c in cuts if c[1] >= 0.5))


def test_replicates_equal_reweighted_rows(spark, sample):
    days = sorted({r[0] for r in sample})
    weights = resample.draw_weights(len(days), 4, seed=5)
    assert (weights.sum(axis=1) == len(days)).all()
    got = {r["replicate"]: r["pr_auc"] for r in
           resample.bootstrap_metrics(scored(spark, sample), 4, seed=5, slice_cells=10).collect()}
    for i in range(4):
        w = [weights[i][days.index(r[0])] for r in sample]
        assert got[i] == pytest.approx(brute([r[1] for r in sample], [r[2] for r in sample], w)[0], abs=1e-12)


def test_paired_bootstrap_of_equal_scores_is_zero(spark, sample):
    df = scored(spark, sample).withColumn("score_b", F.col("score"))
    row = resample.paired_bootstrap(df, replicates=5).first()
    assert row["auc_low"] == row["auc_high"] == 0.0 and row["auc_share_positive"] == 0.0


def states(spark, *values, trip=1):
    return spark.createDataFrame([(20241101, trip, i + 1, v) for i, v in enumerate(values)],
                                 "date int, trip_id long, stop_sequence int, is_bunched_now boolean")


def test_onsets_and_chains(spark):
    ds = states(spark, True, True, False, True, None, True, False, None, True)
    onsets = [r["stop_sequence"] for r in chains.chain_onsets(ds).filter("onset").collect()]
    assert onsets == [4]
    lengths = sorted(r["length"] for r in chains.chain_lengths(ds).collect())
    assert lengths == [1, 1, 1, 2]


def test_earliest_warning_takes_the_largest_horizon(spark):
    ds = states(spark, *[False] * 9, True)
    onsets = chains.chain_onsets(ds).filter("onset").select("date", "trip_id", "rn")
    scores = spark.createDataFrame([(20241101, 1, 10 - k, k, s) for k, s in [(1, 0.9), (3, 0.8), (8, 0.2)]],
                                   "date int, trip_id long, rn long, k int, score double")
    limits = spark.createDataFrame([(k, 0.8, 0.5) for k in (1, 2, 3, 5, 8)], "k int, level double, threshold double")
    hits = chains.all_onset_hits(onsets, scores)
    assert [(r["earliest_k"], r["share"]) for r in chains.earliest_warning(hits, limits).collect()] == [(3, 1.0)]
    caught = {r["k"]: (r["with_prediction"], r["caught"]) for r in chains.onsets_caught(hits, limits).collect()}
    assert caught == {1: (1, 1), 2: (0, 0), 3: (1, 1), 5: (0, 0), 8: (1, 0)}
    assert chains.onset_hits(onsets, scores, 3).first()["score_k3"] == 0.8


def test_persistence_counts(spark):
    ds = spark.createDataFrame([("test", True, 1), ("test", True, 0), ("test", False, 1), ("test", None, 1),
                                ("test", True, None), ("train", True, 1)],
                               "split string, is_bunched_now boolean, y_k1 int")
    row = evaluate.persistence(ds, (1,)).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 0)
    assert row["base_rate"] == pytest.approx(2 / 3) and row["precision"] == row["recall"] == 0.5


def test_blend_marks_one_best_weight(spark, sample):
    df = scored(spark, sample).withColumn("score_b", 1 - F.col("score"))
    out = evaluate.blend_sweep(df, [0.0, 0.5, 1.0]).collect()
    assert [r["weight"] for r in out if r["best"]] == [1.0]
