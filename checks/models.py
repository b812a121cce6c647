"""Fitting and selection on the fixture, over whole tables. Trees are small, and boosting runs to its own stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import KEY, check, scratch
from checks.metrics import TWO_MODELS, _two_models
from evengap import HORIZONS
from evengap.models import fit, prepare, search
from evengap.operators import describe, evaluate
from evengap.operators.enrich import join_features, union_all
from evengap.operators.select import ABS_FEATURES, NUMERIC, feature_set, training_frame, with_abs_features
from evengap.operators.skew import durable

ROW = ["date", "trip_id"]
K = 3
SMALL = {"max_iter": 200, "max_leaf_nodes": 8, "max_depth": 3, "learning_rate": 0.3, "min_samples_leaf": 20, "patience": 5}


def _frames(t, k: int = K, columns: list[str] | None = None, source=None):
    """Train, validation and test rows of a horizon, written once."""
    ds = t.ds if source is None else source
    keep = [c for c in ("date", "trip_id", "stop_sequence", "split", "LineNumber", "hour_of_day") if c in ds.columns]
    rows = durable(training_frame(ds, k, None, columns, keep=keep))
    return [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]


def _summary(scored, k: int = K):
    return evaluate.summary(scored.withColumn("k", F.lit(k)), level=0.3).select("k", "n", "pr_auc", "brier", "f1")


SUMMARY = "k:i n:i pr_auc:f brier:f f1:f"


@check("m01_class_weights", KEY + "y:i w:f",
       """SELECT date, trip_id, stop_sequence, y_k3 AS y, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y_k3)) AS w
          FROM trips WHERE split = 'train' AND y_k3 IS NOT NULL""")
def _(t):
    return prepare.class_weights(t.trips.filter("split = 'train' AND y_k3 IS NOT NULL").withColumnRenamed("y_k3", "y"))


MEDIANS = ["headway_ratio", "dwell", "speed_mps", "closing_speed_3", "temperature_2m", "leader_arrival_delay"]


@check("m02_column_medians", "column_name:s median:f", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, median({c}) AS median FROM ds WHERE split = 'train' AND y_k3 IS NOT NULL"
    for c in MEDIANS))
def _(t):
    return prepare.column_medians(durable(t.ds.filter("split = 'train' AND y_k3 IS NOT NULL").select(*MEDIANS)), MEDIANS)


SCALED = ["headway_ratio", "dwell", "speed_mps"]


@check("m02_preprocess", KEY + " ".join(f"z_{c}:h z_{c}_missing:h" for c in SCALED),
       "SELECT date, trip_id, stop_sequence, " + ", ".join(
           f"(coalesce({c}, m_{c}) - avg(coalesce({c}, m_{c})) OVER ()) / stddev_pop(coalesce({c}, m_{c})) OVER () AS z_{c}, "
           f"(({c} IS NULL)::INT - avg(({c} IS NULL)::INT) OVER ()) / stddev_pop(({c} IS NULL)::INT) OVER () AS z_{c}_missing"
           for c in SCALED) + " FROM fitrows, medians",
       fitrows="SELECT * FROM trips WHERE split = 'train' AND y_k3 IS NOT NULL",
       medians="SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in SCALED) + " FROM fitrows")
def _(t):
    train, _, _ = _frames(t, columns=SCALED, source=t.trips)
    return prepare.fit_preprocess(train, SCALED).transform(train)


@check("m03_logreg", SUMMARY)
def _(t):
    train, _, test = _frames(t)
    return _summary(fit.score(fit.fit_logreg(train, feature_set("current"), max_iter=50), test, ROW))


@check("m04_pca_logreg", SUMMARY + " explained:f")
def _(t):
    train, _, test = (with_abs_features(f) for f in _frames(t))
    model, explained = fit.fit_pca_logreg(train, feature_set("engineered"), n=20, C=0.1, max_iter=50)
    return _summary(fit.score(model, test, ROW)).withColumn("explained", F.lit(explained))


@check("m05_gbt", SUMMARY)
def _(t):
    train, val, test = _frames(t)
    return _summary(fit.score(fit.fit_gbt(train, feature_set("current"), SMALL, val), test, ROW))


SPLIT_ON = ["dwell", "leader_dwell"]
SPLIT = {
    "fitrows": """SELECT dwell, leader_dwell, y, w * (0.5::DOUBLE - y) AS g, w * 0.25::DOUBLE AS h FROM (
        SELECT dwell, leader_dwell, y_k3 AS y, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y_k3)) AS w
        FROM trips WHERE split = 'train' AND y_k3 IS NOT NULL)""",
    "vals": " UNION ALL ".join(f"""SELECT {i} AS f, {c} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM fitrows GROUP BY {c}"""
                               for i, c in enumerate(SPLIT_ON)),
    "below": """SELECT f, v, coalesce(v + lead(v) OVER up, 2 * v) / 2.0::DOUBLE AS cut, sum(g) OVER up AS gl, sum(h) OVER up AS hl,
        CAST(sum(n) OVER up AS BIGINT) AS nl FROM vals WHERE v IS NOT NULL WINDOW up AS (PARTITION BY f ORDER BY v)""",
    "sums": """SELECT f, sum(g) AS g, sum(h) AS h, CAST(sum(n) AS BIGINT) AS n, coalesce(sum(g) FILTER (v IS NULL), 0) AS g0,
        coalesce(sum(h) FILTER (v IS NULL), 0) AS h0, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n0 FROM vals GROUP BY f""",
    "sides": """SELECT f, cut, m, g, h, n, gl + m * g0 AS gl, hl + m * h0 AS hl, nl + m * n0 AS nl
        FROM below JOIN sums USING (f), (VALUES (0), (1)) AS missing(m)""",
    "split1": """SELECT * FROM sides WHERE nl >= 20 AND n - nl >= 20
        ORDER BY gl * gl / hl + (g - gl) * (g - gl) / (h - hl) DESC, f, m, cut LIMIT 1""",
    "value": "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SPLIT_ON)) + " END",
}
_side = SPLIT.pop("value")


@check("m05_one_split", KEY + "score:f",
       f"""SELECT date, trip_id, stop_sequence, 1 / (1 + exp(-CASE WHEN coalesce({_side} <= cut, m = 1) THEN -gl / hl
           ELSE -(g - gl) / (h - hl) END)) AS score FROM trips, split1 WHERE split = 'test' AND y_k3 IS NOT NULL""", **SPLIT)
def _(t):
    """One tree of one split: the best cut of two columns with missing values, and what its sides score."""
    train, _, test = _frames(t, columns=SPLIT_ON, source=t.trips)
    model = fit.fit_gbt(train, SPLIT_ON, {"max_iter": 1, "max_leaf_nodes": 2, "learning_rate": 1.0})
    return fit.score(model, test, [*ROW, "stop_sequence"])


@check("m06_score", KEY + "y:i score:f")
def _(t):
    train, val, test = _frames(t)
    model = fit.fit_gbt(train, feature_set("current"), SMALL, val)
    scored = fit.score(model, test.withColumn("seq", F.col("meta_stop_sequence")), [*ROW, "seq"])
    return scored.withColumnRenamed("seq", "stop_sequence")


LEDGER = "model:s k:i name:s params:s metric:s value:f"
TUNED = {"max_iter": 200, "max_leaf_nodes": 8, "max_depth": 3, "min_samples_leaf": 20, "patience": 5}
GRID = {"learning_rate": [0.2, 0.3, 0.5], "min_samples_leaf": [20, 50, 100]}


@check("m07_random_search", LEDGER)
def _(t):
    train, val, _ = _frames(t)
    trials, _ = search.random_search(train.withColumn("seq", F.col("meta_stop_sequence")), val, NUMERIC, K,
                                     [*ROW, "seq"], space=GRID, n=2, sample=20_000, fixed=TUNED,
                                     ledger=f"{scratch(t.spark)}/ledger")
    return trials


@check("m07_search_logreg", LEDGER)
def _(t):
    train, val, _ = _frames(t)
    return search.search_logreg(train, val, feature_set("current"), K, (0.1, 1.0), (10, 20), (1.0,), max_iter=30)


@check("m08_refine", LEDGER)
def _(t):
    train, val, _ = _frames(t)
    first = search.run_trials(train, val, search.draw_configs(GRID, 1, 5, TUNED), NUMERIC, K)
    return search.refine(train, val, first, NUMERIC, K, space=GRID)


@check("m09_refit_top", LEDGER)
def _(t):
    train, val, _ = _frames(t)
    part = describe.sample_n(train, [*ROW, "meta_stop_sequence"], 20_000)
    trials = search.run_trials(part, val, search.draw_configs(GRID, 3, 5, TUNED), NUMERIC, K)
    return search.refit_top(trials, train, val, NUMERIC, K)[0]


@check("m10_screen_features", LEDGER)
def _(t):
    columns = feature_set("no_month+all") + ["month_of_year"]
    train, val, _ = _frames(t, 5, columns, join_features(t.ds, t.extra))
    return search.screen_features(train, val, 5, SMALL)


@check("m10_pick_feature_set", "k:i name:s gain:f",
       """SELECT k, CASE WHEN greatest(a, b) - a >= 0.005 THEN CASE WHEN b > a THEN 'now' ELSE 'before' END
          ELSE 'before' END AS name, greatest(a, b) - a AS gain FROM (
          SELECT k, max(pr_auc) FILTER (model = 'before') AS a, max(pr_auc) FILTER (model = 'now') AS b
          FROM two GROUP BY k)""", **TWO_MODELS)
def _(t):
    screen = _two_models(t).select("k", F.col("model").alias("name"), F.col("pr_auc").alias("value"))
    return search.pick_feature_set(screen, base="before")


@check("m11_ablate", "model:s k:i pr_auc:f")
def _(t):
    train, val, test = _frames(t)
    return search.ablate(train, val, test, K, SMALL)


@check("m11_transfer", "model:s k:i pr_auc:f ci_low:f ci_high:f loss_pct:f")
def _(t):
    return search.transfer(*_frames(t), ["4", "541"], K, SMALL)


@check("m12_fit_horizons", "k:i n:i pr_auc:f brier:f f1:f")
def _(t):
    """Fit, save, load and score every horizon."""
    ds, path = durable(t.ds), scratch(t.spark)
    search.fit_horizons(ds, HORIZONS, SMALL, path=path)
    return union_all(*[_summary(fit.score(search.load_horizon(path, k), training_frame(ds, k, "test"), []), k)
                       for k in HORIZONS])


@check("m12_best_model", "model:s k:i value:f",
       "SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr_auc DESC, model) = 1".replace(
           "SELECT *", "SELECT model, k, pr_auc AS value"), **TWO_MODELS)
def _(t):
    ledger = _two_models(t).select("model", "k", F.col("model").alias("name"), F.lit("pr_auc").alias("metric"),
                                   F.col("pr_auc").alias("value"))
    return search.best_model(ledger, "pr_auc")


@check("m13_coefficients", "feature:s kind:s coefficient:f")
def _(t):
    train, _, _ = (with_abs_features(f) for f in _frames(t))
    columns = feature_set("engineered")
    assert set(ABS_FEATURES) <= set(columns)
    return fit.coefficient_table(fit.fit_logreg(train, columns, max_iter=30), train)


@check("e18_permutation_importance", "k:i feature:s mean:f std:f")
def _(t):
    train, val, test = _frames(t)
    model = fit.fit_gbt(train, NUMERIC, SMALL, val)
    rows = test.withColumn("seq", F.col("meta_stop_sequence"))
    return fit.permutation_importance(model, rows, NUMERIC, [*ROW, "seq"]).withColumn("k", F.lit(K))
