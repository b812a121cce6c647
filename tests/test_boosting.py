"""Boosted trees against a plain version that splits lists of rows."""

import heapq
import itertools
import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evengap.models import boosting, fit
from evengap.operators import skew


def table(spark, n=1000, seed=0, rounds=False):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 30, n).astype(float), rng.normal(size=n).round(1)
    c = rng.integers(0, 4, n)
    z = np.sin(a / 4) + b * (c == 2) + (a % 7 == 0) + rng.normal(0, 0.3, n)
    y = (z > 0.5).astype(int)
    a[rng.random(n) < 0.2] = np.nan
    rows = [(i, None if np.isnan(a[i]) else float(a[i]), float(b[i]), None if i % 11 == 0 else str(c[i]), int(y[i]), float(1 + i % 3), i % 4 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, LineNumber string, y int, w double, held_out boolean")


class Plain:
    """Best-first growth over rows, trying every cut and, for categories, every subset."""

    def __init__(self, rows, params, numeric=("a", "b"), category="LineNumber"):
        self.p = {**boosting.DEFAULTS, **params}
        self.rows, self.numeric, self.category = rows, numeric, category
        w = sum(r["w"] for r in rows)
        one = sum(r["w"] * r["y"] for r in rows)
        self.start = np.log(one / (w - one))
        self.f = {r["id"]: self.start for r in rows}
        self.trees = []

    def sums(self, rows):
        g = h = 0.0
        for r in rows:
            p = 1 / (1 + np.exp(-self.f[r["id"]]))
            g += r["w"] * (p - r["y"])
            h += r["w"] * p * (1 - p)
        return g, h

    def tests(self, rows):
        for c in self.numeric:
            values = sorted({r[c] for r in self.rows if r[c] is not None})
            for x, y in zip(values, values[1:]):
                for missing in (False, True):
                    yield lambda r, c=c, cut=(x + y) / 2, m=missing: m if r[c] is None else r[c] <= cut
        kinds = sorted({r[self.category] for r in self.rows}, key=str)
        for k in range(1, len(kinds)):
            for some in itertools.combinations(kinds, k):
                yield lambda r, some=some: r[self.category] in some

    def best(self, rows):
        l2 = self.p["l2_regularization"]
        g, h = self.sums(rows)
        top = None
        for test in self.tests(rows):
            left, right = [r for r in rows if test(r)], [r for r in rows if not test(r)]
            if min(len(left), len(right)) < self.p["min_samples_leaf"]:
                continue
            (gl, hl), (gr, hr) = self.sums(left), self.sums(right)
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - g * g / (h + l2)
            if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                top = gain, test, left, right
        return top

    def grow(self):
        leaves, ready, tick = {(): self.rows}, [], itertools.count()

        def offer(path, rows):
            found = self.best(rows) if self.p["max_depth"] is None or len(path) < self.p["max_depth"] else None
            if found:
                heapq.heappush(ready, (-found[0], next(tick), path, found))

        offer((), self.rows)
        while ready and len(leaves) < self.p["max_leaf_nodes"]:
            _, _, path, (_, _, left, right) = heapq.heappop(ready)
            del leaves[path]
            for side, rows in ((0, left), (1, right)):
                leaves[path + (side,)] = rows
                offer(path + (side,), rows)
        step = {}
        for rows in leaves.values():
            g, h = self.sums(rows)
            for r in rows:
                step[r["id"]] = -self.p["learning_rate"] * g / (h + self.p["l2_regularization"])
        for i, x in step.items():
            self.f[i] += x


@pytest.mark.parametrize("params", [
    {"max_iter": 1, "max_leaf_nodes": 2, "learning_rate": 1.0},
    {"max_iter": 2, "max_leaf_nodes": 6, "learning_rate": 0.5, "min_samples_leaf": 15},
    {"max_iter": 2, "max_leaf_nodes": 5, "learning_rate": 0.3, "l2_regularization": 3.0, "max_depth": 3},
])
def test_trees_equal_the_plain_version(spark, params):
    # subsets of categories are all tried there; in order of gradient by curvature is best for any l2 only at l2 = 0
    columns, category = (["a", "b", "LineNumber"], "LineNumber") if not params.get("l2_regularization") else (["a", "b"], "none")
    data = table(spark).where("not held_out").withColumn("none", F.lit("x"))
    plain = Plain([r.asDict() for r in data.collect()], params, category=category)
    for _ in range(params["max_iter"]):
        plain.grow()
    spec = boosting.fit_bins(data, columns, [c for c in columns if c == "LineNumber"])
    rows = boosting.Binner(spec=json.dumps(spec)).transform(data)
    model = boosting.fit_trees(rows.select("bins", "y", "w", "held_out"), spec, params)
    got = {r["id"]: r["score"] for r in fit.score(model, rows, ["id"]).collect()}
    want = {i: 1 / (1 + np.exp(-x)) for i, x in plain.f.items()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert len(set(got.values())) > 1


def test_bins(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i % 3), ["x", "y", None][i % 3]) for i in range(2000)] + [(float("nan"), None, "z")]
    df = spark.createDataFrame(rows, "many double, few double, name string")
    spec = boosting.fit_bins(df, ["many", "few", "name"], ["name"])
    assert spec["cuts"]["few"] == [0.5, 1.5] and 200 <= len(spec["cuts"]["many"]) <= 254
    assert spec["codes"]["name"].keys() == {"x", "y", "z"}
    got = [list(r.bins) for r in boosting.Binner(spec=json.dumps(spec)).transform(df).collect()]
    assert got[0][1:] == [255, spec["codes"]["name"]["x"]] and got[1][1] == 1 and got[2][2] == 255 and got[-1][:2] == [255, 255]
    many = [g[0] for g in got[:-1]]
    assert many == sorted(many)


def test_best_split_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(30):
        hist = np.zeros((256, 3))
        hist[:6] = np.column_stack([rng.normal(size=6), rng.uniform(0.1, 2, 6), rng.integers(1, 9, 6)])
        hist[255] = rng.normal(), 0.7, 3
        gain = boosting.best_split(hist, True, 0.0, 1)[0]
        own = [*range(6), 255]
        best = max(hist[list(s), 0].sum() ** 2 / hist[list(s), 1].sum() + (hist[:, 0].sum() - hist[list(s), 0].sum()) ** 2 / (hist[:, 1].sum() - hist[list(s), 1].sum())
                   for k in range(1, 7) for s in itertools.combinations(own, k))
        assert gain == pytest.approx(best - hist[:, 0].sum() ** 2 / hist[:, 1].sum())


def test_the_best_round_is_kept(spark, monkeypatch):
    """Held-out losses that rise for a while end nothing before the patience is over; the lowest round is the model."""
    losses = iter([1.0, 0.9, 0.8, 0.95, 0.93, *[0.79 - 0.01 * i for i in range(36)], *[0.6 + 0.01 * i for i in range(30)]])

    def planned(*_):
        tree = boosting.Tree()
        tree.add(), tree.add()
        tree.feature[0], tree.left[0], tree.right[0], tree.value = 0, 1, 2, [0.0, -1.0, 1.0]
        return tree, next(losses)

    monkeypatch.setattr(boosting, "grow", planned)
    monkeypatch.setattr(boosting, "durable", lambda df: df)
    monkeypatch.setattr(boosting, "blocks", lambda data, start: data)
    monkeypatch.setattr(boosting, "rescored", lambda state, *_: state)
    data = table(spark).select(F.lit(b"\0").alias("bins"), "y", "w", "held_out")
    for patience, want in ((20, 40), (2, 2)):
        losses = iter([1.0, 0.9, 0.8, 0.95, 0.93, *[0.79 - 0.01 * i for i in range(36)], *[0.6 + 0.01 * i for i in range(30)]])
        _, trees, seen = boosting.boost_trees(data, {"columns": ["a"], "codes": {}}, {"max_iter": 200}, patience)
        assert len(trees) == want == int(np.argmin(seen)) and len(seen) == want + patience + 1


def test_curve_equals_scores_of_every_round(spark):
    df = table(spark, 600)
    spec = boosting.fit_bins(df.where("not held_out"), ["a", "b"])
    rows = boosting.Binner(spec=json.dumps(spec)).transform(df).select("id", "bins", "y", "w", "held_out").cache()
    params = {"max_iter": 25, "max_leaf_nodes": 4, "learning_rate": 0.3}
    start, trees, losses = boosting.boost_trees(rows, spec, params, patience=60)
    held = rows.where("held_out").toPandas()
    x = np.stack([np.frombuffer(b, np.uint8) for b in held["bins"]])
    f, want = np.full(len(x), start), []
    for t in [None, *trees]:
        f = f if t is None else f + t.scores(x)
        want.append(np.average(np.logaddexp(0, np.where(held["y"] == 1, -f, f)), weights=held["w"]))
    assert losses[:len(want)] == pytest.approx(want, abs=1e-9) and min(losses) == losses[len(trees)]


def test_saved_models_score_alike(spark, tmp_path):
    df = table(spark, 400)
    model = fit.fit_gbt(df.where("not held_out"), ["a", "b", "LineNumber"], {"max_iter": 4, "max_leaf_nodes": 5}, df.where("held_out"))
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    odd = df.withColumn("LineNumber", F.when(F.col("id") % 2 == 0, "never seen").otherwise(F.col("LineNumber")))
    assert sorted(fit.score(model, odd, ["id"]).collect()) == sorted(fit.score(again, odd, ["id"]).collect())
    assert again.stages[-1].numTrees <= 4 and len(again.stages[-1].heldOutLosses) == 5


def test_no_rows_or_one_class(spark):
    df = table(spark, 50)
    for rows in (df.where("y = 1"), df.where("a is null").withColumn("b", F.lit(None).cast("double"))):
        model = fit.fit_gbt(rows, ["a", "b"], {"max_iter": 3})
        assert model.stages[-1].numTrees == 0
        assert all(0 <= r["score"] <= 1 for r in fit.score(model, df, ["id"]).collect())


def test_a_pass_is_one_job(spark):
    df = table(spark, 400)
    spec = boosting.fit_bins(df, ["a", "b"])
    rows = boosting.Binner(spec=json.dumps(spec)).transform(df).select("bins", "y", "w", "held_out").cache()
    rows.count()
    jobs = []
    for n in (1, 9, 17):
        spark.sparkContext.setJobGroup(f"trees {n}", "")
        _, trees, _ = boosting.boost_trees(rows, spec, {"max_iter": n, "max_leaf_nodes": 2}, None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {n}")))
        assert len(trees) == n
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] - jobs[0] == jobs[2] - jobs[1] == 8


def test_histograms_that_meet_in_tasks_give_the_same_trees(spark, monkeypatch):
    df = table(spark, 600)
    spec = boosting.fit_bins(df, ["a", "b", "LineNumber"], ["LineNumber"])
    rows = boosting.Binner(spec=json.dumps(spec)).transform(df).select("bins", "y", "w", "held_out")
    params = {"max_iter": 10, "max_leaf_nodes": 7, "learning_rate": 0.3}
    here = boosting.boost_trees(rows, spec, params, 20)
    monkeypatch.setattr(boosting, "GATHERED", 0)
    there = boosting.boost_trees(rows, spec, params, 20)
    assert here[2] == pytest.approx(there[2], abs=1e-12) and len(here[2]) == 11
    assert [t.feature for t in here[1]] == [t.feature for t in there[1]]


def test_boosting_leaves_no_tables(spark, tmp_path, monkeypatch):
    """Rows, scores and bins are gone once the model is there; before, every few rounds left a copy of the rows."""
    names = itertools.count()
    monkeypatch.setattr(skew, "shared_folder", lambda spark: f"{tmp_path}/{next(names)}")
    df = table(spark, 400)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    model = fit.fit_gbt(df.where("not held_out"), ["a", "b"], {"max_iter": 10, "max_leaf_nodes": 3}, df.where("held_out"))
    assert fit.pr_auc(model, df) > 0.5
    assert next(names) >= 3 and not list(tmp_path.iterdir())
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
