import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evengap.models import fit, prepare, search
from evengap.operators import skew

COLUMNS = ["dwell", "headway_ratio", "is_precip", "LineNumber"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 900
    ratio = rng.normal(1, 0.5, n)
    y = (np.abs(ratio) + rng.normal(0, 0.2, n) < 0.6).astype(int)
    data = [(int(i), None if i % 9 == 0 else float(i % 40), float(ratio[i]), float(i % 2), str(i % 3), int(y[i]))
            for i in range(n)]
    return spark.createDataFrame(data, "id long, dwell double, headway_ratio double, is_precip double, "
                                       "LineNumber string, y int").cache()


def test_weights_are_balanced(rows):
    w = prepare.class_weights(rows)
    sums = [r[1] for r in w.groupBy("y").agg(F.sum("w")).collect()]
    assert sums == pytest.approx([450.0, 450.0])


@pytest.mark.parametrize("limit", [10, 10**6])
def test_medians_are_exact(rows, limit):
    pdf = rows.toPandas()
    got = {r["column_name"]: r["median"] for r in prepare.column_medians(rows, ["dwell", "headway_ratio"], limit).collect()}
    assert got["dwell"] == pdf["dwell"].median()
    assert got["headway_ratio"] == pytest.approx(pdf["headway_ratio"].median(), abs=1e-15)


@pytest.mark.parametrize("limit, sketch", [(2, 10_000), (2, 40), (10_000, 10_000)])
def test_medians_of_odd_columns(spark, limit, sketch, monkeypatch):
    """Ties on both sides of the middle, infinities, a wide range, one value, none, and a sketch that is far off."""
    monkeypatch.setattr(prepare, "SKETCH", sketch)
    rng = np.random.default_rng(5)
    n = 600
    columns = {
        "ties": [1.0] * 300 + [2.0] * 300, "three": list(rng.integers(0, 3, n).astype(float)), "same": [4.0] * n,
        "wide": list(10.0 ** rng.uniform(-300, 300, n)), "sparse": [float(i) if i % 50 == 0 else None for i in range(n)],
        "none": [None] * n, "ends": [float("-inf")] * 200 + [5.0] + [7.0] * 199 + [float("inf")] * 200,
        "whole": list(range(n)), "one": [3.5] + [None] * (n - 1)}
    pdf = pd.DataFrame(columns)
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in zip(*columns.values())],
                               ", ".join(f"{c} double" for c in columns)).repartition(5)
    want = {c: None if pdf[c].count() == 0 else float(pdf[c].median()) for c in columns}
    got = {r["column_name"]: r["median"] for r in prepare.column_medians(df, list(columns), limit).collect()}
    assert got == {c: pytest.approx(v, rel=1e-15) if v is not None else None for c, v in want.items()}


def test_medians_take_three_scans(spark):
    df = spark.range(200_000).selectExpr("cast(hash(id) AS double) AS a", "id % 3 AS b", "null AS c")
    spark.sparkContext.setJobGroup("medians", "")
    got = prepare.column_medians(df, ["a", "b", "c"])
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians")) <= 6  # an aggregate is at most two jobs
    want = df.agg(F.median("a"), F.median("b")).first()
    assert [r["median"] for r in got.collect()] == [*want, None]


def test_preparation(rows):
    model = prepare.fit_preprocess(rows, COLUMNS)
    unseen = rows.limit(1).withColumn("LineNumber", F.lit("new"))
    out = model.transform(rows)
    names = prepare.feature_names(out)
    assert names[:4] == ["dwell", "headway_ratio", "is_precip", "dwell_missing"] and len(names) == 7
    stats = out.agg(F.avg("z_dwell"), F.stddev_pop("z_dwell"), F.avg("z_dwell_missing")).first()
    assert tuple(stats) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)
    assert list(model.transform(unseen).first()["features"].toArray()[4:]) == [0.0, 0.0, 0.0]


def test_logreg_and_coefficients(spark, rows, tmp_path):
    rows = rows.withColumn("abs_headway_ratio", F.abs("headway_ratio"))
    columns = [*COLUMNS, "abs_headway_ratio"]
    model = fit.fit_logreg(rows, columns)
    table = {r["feature"]: (r["kind"], r["coefficient"]) for r in fit.coefficient_table(model, rows).collect()}
    assert table["abs_headway_ratio"][1] < -1 and table["dwell_missing"][0] == "missing"
    assert {k for k, _ in table.values()} == {"numeric", "flag", "missing", "category"}
    assert fit.pr_auc(model, rows) > 0.8
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert fit.pr_auc(again, rows) == pytest.approx(fit.pr_auc(model, rows))
    _, explained = fit.fit_pca_logreg(rows, columns, n=100)
    assert explained == pytest.approx(1.0)


def test_boosting_and_permutation(rows):
    params = {"max_iter": 5, "max_leaf_nodes": 8, "learning_rate": 0.3}
    model = fit.fit_gbt(rows.filter("id % 3 > 0"), COLUMNS, params, rows.filter("id % 3 = 0"))
    assert fit.pr_auc(model, rows) > 0.7
    imp = {r["feature"]: r["mean"] for r in
           fit.permutation_importance(model, rows, COLUMNS, ["id"], n=500, repeats=2).collect()}
    assert max(imp, key=imp.get) == "headway_ratio" and imp["headway_ratio"] > 0.2
    assert abs(imp["LineNumber"]) < 0.1


def test_neighbours_are_one_step_away_and_untried(spark):
    space = {"a": [1, 2, 3], "b": [None, 6]}
    best = {"a": 2, "b": None, "max_iter": 9}
    tried = spark.createDataFrame([(search.canonical(best),), (search.canonical({**best, "a": 1}),)], "params string")
    got = search.neighbours(spark, best, space, tried).orderBy("parameter", "place").collect()
    assert [r["params"] for r in got] == [search.canonical({**best, "a": 3}), search.canonical({**best, "b": 6})]
    assert search.draw_configs(space, 3, 1) == search.draw_configs(space, 3, 1) != search.draw_configs(space, 3, 2)


def test_changed_parameters_are_fitted_again(spark, rows, tmp_path):
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    path = f"{tmp_path}/ledger"
    for rate in (0.1, 0.3, 0.3):
        config = {"name": "rs0", "params": {"learning_rate": rate, "max_iter": 2, "max_leaf_nodes": 4}}
        got = search.run_trials(train, val, [config], COLUMNS, 3, path)
    assert got.count() == 2
    assert search.run_trials(train, val, [config], COLUMNS[:2], 3, path).count() == 3


def test_boosting_keeps_rounds_of_small_gain(rows):
    params = {"max_iter": 25, "max_leaf_nodes": 4, "learning_rate": 0.05}
    model = fit.fit_gbt(rows.filter("id % 3 > 0"), COLUMNS, params, rows.filter("id % 3 = 0"))
    assert model.stages[-1].numTrees > 10


def test_refits_are_saved_and_taken_up_again(rows, tmp_path, monkeypatch):
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    configs = search.draw_configs({"learning_rate": [0.1, 0.3]}, 2, 1, {"max_iter": 2, "max_leaf_nodes": 4})
    ledger, path = f"{tmp_path}/ledger", f"{tmp_path}/models"
    trials = search.run_trials(train, val, configs, COLUMNS, 3, ledger)
    first, model = search.refit_top(trials, train, val, COLUMNS, 3, 2, ledger, path)
    want = sorted(map(tuple, first.collect()))
    monkeypatch.setattr(search, "fit_gbt", None)  # nothing is left to fit
    again, loaded = search.refit_top(trials, train, val, COLUMNS, 3, 2, ledger, path)
    assert sorted(map(tuple, again.collect())) == want and len(want) == 2
    assert fit.pr_auc(loaded, val) == pytest.approx(fit.pr_auc(model, val))
    with pytest.raises(ValueError):
        search.refit_top(trials, train, val, COLUMNS, 3, 2, ledger)


def test_logistic_search_records_what_components_explain(rows, tmp_path):
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    for columns in (COLUMNS, COLUMNS[:2]):
        got = search.search_logreg(train, val, columns, 3, (1.0,), (1, 2), (1.0,), 10, f"{tmp_path}/ledger")
    explained = got.filter("metric = 'explained_variance'").collect()
    assert got.count() == 10 and len(explained) == 4 and all(0 < r["value"] <= 1 + 1e-9 for r in explained)


def test_transfer_compares_with_the_model_of_all_lines(rows):
    rows = rows.withColumn("date", F.col("id") % 20)
    train, val, test = (rows.filter(f"id % 4 = {i}") for i in (0, 1, 2))
    got = {r["model"]: r for r in search.transfer(train, val, test, ["0"], 3, {"max_iter": 3, "max_leaf_nodes": 4},
                                                  COLUMNS, replicates=50).collect()}
    assert set(got) == {"own_lines", "heldout_lines", "full_on_heldout"}
    assert all(r["ci_low"] <= r["ci_high"] for r in got.values())
    limited, full = got["heldout_lines"], got["full_on_heldout"]["pr_auc"]
    assert limited["loss_pct"] == pytest.approx(100 * (full - limited["pr_auc"]) / full)


def test_feature_set_needs_a_gain(spark):
    screen = spark.createDataFrame([(5, "current", 0.70), (5, "no_month", 0.704), (8, "current", 0.60),
                                    (8, "no_month+all", 0.616)], "k int, name string, value double")
    assert {r["k"]: r["name"] for r in search.pick_feature_set(screen).collect()} == {5: "current", 8: "no_month+all"}


def test_search_is_resumed(spark, rows, tmp_path):
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    configs = search.draw_configs({"learning_rate": [0.1, 0.3]}, 2, 1, {"max_iter": 2, "max_leaf_nodes": 4})
    path = f"{tmp_path}/ledger"
    first = search.run_trials(train, val, configs[:1], COLUMNS, 3, path)
    assert first.count() == 1
    both = search.run_trials(train, val, configs, COLUMNS, 3, path)
    assert both.count() == 2 and both.filter("value > 0.3").count() == 2
    assert search.best_model(both).count() == 1


def test_trials_run_side_by_side(spark, rows, tmp_path, monkeypatch):
    """Four trials wait for each other, so they have to run at once; the ledger is as in sequence."""
    import threading

    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    configs = search.draw_configs({"learning_rate": [0.1, 0.2, 0.3, 0.4]}, 4, 1, {"max_iter": 2, "max_leaf_nodes": 4})
    sequence = search.run_trials(train, val, configs, COLUMNS, 3)
    meet, boost = threading.Barrier(4, timeout=120), search.boost

    def together(*args):
        meet.wait()
        return boost(*args)

    monkeypatch.setattr(search, "boost", together)
    ledger = search.run_trials(train, val, configs, COLUMNS, 3, f"{tmp_path}/ledger")
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, sequence.collect())) and ledger.count() == 4


def test_a_failed_trial_leaves_the_others_recorded(spark, rows, tmp_path):
    def run(c):
        if c["name"] == "bad":
            raise ValueError("no trial")
        return {"val_pr_auc": 0.5}

    configs = [{"name": n, "params": {}} for n in ("a", "bad", "b")]
    with pytest.raises(ValueError, match="no trial"):
        search._recorded(spark, configs, run, 3, "gbt", f"{tmp_path}/ledger", at_once=1)
    assert [r["name"] for r in spark.read.parquet(f"{tmp_path}/ledger").collect()] == ["a"]


def test_feature_sets_share_bins(rows, monkeypatch):
    """Every set scores as a model of its own does, though the rows are binned once."""
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    sets = {"all": COLUMNS, "some": ["LineNumber", "headway_ratio"]}
    params = {"max_iter": 3, "max_depth": 2, "min_samples_leaf": 5}
    want = {s: fit.pr_auc(fit.fit_gbt(train, c, params, val), val) for s, c in sets.items()}
    binned, original = [], fit.fit_bins
    monkeypatch.setattr(fit, "fit_bins", lambda *a: binned.append(a) or original(*a))
    monkeypatch.setattr(search, "feature_set", sets.get)
    found = search.screen_features(train, val, 3, params, list(sets)).collect()
    assert {r["name"]: r["value"] for r in found} == pytest.approx(want) and len(binned) == 1


@pytest.mark.parametrize("run", [
    lambda train, val, path: fit.fit_pca_logreg(train, COLUMNS, n=2, max_iter=5),
    lambda train, val, path: search.search_logreg(train, val, COLUMNS, 3, (1.0,), (1,), (1.0,), 5, f"{path}/ledger")])
def test_features_are_prepared_once_and_read_by_all_fits(rows, tmp_path, monkeypatch, run):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA

    plans = []
    for kind in (PCA, LogisticRegression):
        was = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, data, was=was: (
            plans.append(data._jdf.queryExecution().optimizedPlan().toString()), was(self, data))[1])
    run(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"), tmp_path)
    assert len(plans) >= 2
    # all evaluate stored features; what made them (indexed lines, scaled columns) is not evaluated again
    assert all("parquet" in p and "dwell" not in p and "LineNumber" not in p for p in plans)


def test_scaling_is_one_aggregate(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(prepare.F, "stddev_pop", lambda c: asked.append(c), raising=False)
    got = {o["name"]: o for o in prepare.scaling(rows, ["dwell", "headway_ratio", "is_precip"])}
    assert not asked and set(got) == {"dwell", "headway_ratio", "is_precip", "dwell_missing"}
    table = rows.toPandas()
    dwell = table["dwell"].fillna(table["dwell"].median())
    for name, x in {"dwell": dwell, "headway_ratio": table["headway_ratio"], "dwell_missing": table["dwell"].isna()}.items():
        assert (got[name]["mean"], got[name]["std"]) == pytest.approx((x.mean(), x.std(ddof=0)))
    one = prepare.scaling(rows.limit(1), ["headway_ratio", "is_precip"])
    assert [o["std"] for o in one] == [1.0, 1.0]
    none = prepare.scaling(rows.withColumn("e", F.lit(None).cast("double")), ["e"])
    assert [(o["mean"], o["std"]) for o in none] == [(0.0, 1.0), (1.0, 1.0)]


def test_screens_and_horizons_leave_no_tables(rows, tmp_path, monkeypatch):
    """Bins, scores and counts of every set and horizon are gone when the models are there."""
    names = iter(range(1000))
    monkeypatch.setattr(skew, "shared_folder", lambda spark: f"{tmp_path}/{next(names)}")
    monkeypatch.setattr(search, "feature_set", lambda name: COLUMNS if name == "all" else COLUMNS[:2])
    params = {"max_iter": 9, "max_leaf_nodes": 3}
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    got = search.screen_features(train, val, 3, params, ["all", "two"])
    assert {r["name"]: r["value"] > 0.5 for r in got.collect()} == {"all": True, "two": True}
    ds = rows.selectExpr("*", "y AS y_k1", "y AS y_k2", "if(id % 3 = 0, 'val', 'train') AS split").drop("y")
    models = search.fit_horizons(ds, (1, 2), params, COLUMNS)
    assert [models[k].stages[-1].numTrees > 0 for k in (1, 2)] == [True, True]
    assert next(names) > 6 and not list(tmp_path.iterdir())
