"""Exact ranking metrics over a table of scored rows.

A scored table has the label ``y`` (0/1), ``score``, the day, and any grouping
columns. Everything rests on :func:`score_cuts`: rows are first added up per
distinct score (combined before the shuffle), and only the distinct scores are
put in order, so tied rows are never cut apart and a group of any size is
spread over tasks by :func:`running`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evengap.functions import ratio, safe_div
from evengap.operators.resample import bootstrap_ci
from evengap.operators.select import is_peak
from evengap.operators.skew import GROUP_ROWS, LOOK, along, durable, large_groups, running, same_keys
from evengap.roles import DEFAULT, HORIZONS, Roles

By = Sequence[str]
CUT = ("score", "recall", "precision", "tp", "fp")


def score_cuts(scored: DataFrame, by: By = ("k",), weight: str | None = None, score: str = "score",
               limit: int = GROUP_ROWS) -> DataFrame:
    """One row per group and distinct score: true and false positives at this score or above."""
    w = F.lit(1) if weight is None else F.col(weight)
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))
    counts = durable(counts)  # the look-up and both passes read it, and the scored rows are evaluated once
    order = [F.col("score").desc_nulls_last()]
    totals = {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")}
    hot = large_groups(counts, list(by), limit) if by else LOOK
    cuts = along(counts, list(by), order, whole=totals, limit=limit, hot=hot)
    cuts = running(cuts, list(by), order, {"tp": F.col("pos"), "fp": F.col("neg")}, limit, hot)
    return cuts.withColumns({"precision": safe_div("tp", F.col("tp") + F.col("fp")),
                             "recall": safe_div("tp", "n_pos")})


def _ap() -> Column:
    """Step-wise area: the recall gained at each cut times the precision there."""
    return F.sum(safe_div("pos", "n_pos") * F.col("precision"))


def average_precision(scored: DataFrame, by: By = ("k",), weight: str | None = None, score: str = "score",
                      limit: int = GROUP_ROWS) -> DataFrame:
    return score_cuts(scored, by, weight, score, limit).groupBy(*by).agg(_ap().alias("pr_auc"))


def _last_cut_reaching(p: Column) -> Column:
    """The lowest threshold whose precision is still at least ``p``; null when none is."""
    ok = F.when(F.col("precision") >= p, F.col("score"))
    return F.min_by(F.struct(*CUT), ok)


def _cut_rows(cuts: DataFrame, by: By, levels: Sequence[float], pick) -> DataFrame:
    picked = cuts.groupBy(*by).agg(*[pick(level).alias(f"c{i}") for i, level in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(float(level)).alias("level"), F.col(f"c{i}").alias("c"))
                     for i, level in enumerate(levels)])
    return picked.select(*by, F.explode(rows).alias("r")).select(*by, "r.level", "r.c")


def recall_at_precision(scored: DataFrame, levels: Sequence[float] = (0.80,), by: By = ("k",),
                        score: str = "score", limit: int = GROUP_ROWS) -> DataFrame:
    """Highest recall whose precision reaches the level, with its threshold; nulls when it never does."""
    rows = _cut_rows(score_cuts(scored, by, None, score, limit), by, levels,
                     lambda p: _last_cut_reaching(F.lit(float(p))))
    return rows.select(*by, "level", F.col("c.recall").alias("recall"), F.col("c.precision").alias("precision"),
                       F.col("c.score").alias("threshold"))


def _days(scored: DataFrame, by: By, roles: Roles) -> DataFrame:
    return (scored.select(*by, roles.day).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_days")))


def at_recall(scored: DataFrame, levels: Sequence[float] = (0.5, 0.7, 0.8), by: By = ("k",),
              roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """First cut that reaches each recall: alarms, alarms per day, false per true alarm."""
    def pick(r):
        return F.max_by(F.struct(*CUT), F.when(F.col("tp") >= F.ceil(F.lit(float(r)) * F.col("n_pos")), F.col("score")))

    rows = same_keys(_cut_rows(score_cuts(scored, by, limit=limit), by, levels, pick),
                     _days(scored, by, roles), list(by), "left")
    return rows.select(*by, "level", F.col("c.score").alias("threshold"), F.col("c.tp").alias("true_alarms"),
                       F.col("c.fp").alias("false_alarms"),
                       safe_div("c.fp", "n_days").alias("false_alarms_per_day"),
                       safe_div("c.fp", "c.tp").alias("false_per_true_alarm"),
                       F.col("c.precision").alias("precision"))


def at_precision(scored: DataFrame, levels: Sequence[float] = (0.9, 0.8, 0.7), by: By = ("k",),
                 roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """Recall at each precision with false alarms per day; tied scores stay together."""
    rows = same_keys(_cut_rows(score_cuts(scored, by, limit=limit), by, levels,
                               lambda p: _last_cut_reaching(F.lit(float(p)))),
                     _days(scored, by, roles), list(by), "left")
    return rows.select(*by, "level", F.col("c.recall").alias("recall"), F.col("c.score").alias("threshold"),
                       safe_div("c.fp", "n_days").alias("false_alarms_per_day"))


def confusion(scored: DataFrame, threshold: float = 0.5, by: By = ("k",)) -> DataFrame:
    """Confusion counts and F1 at a fixed threshold."""
    flag, pos = F.col("score") >= threshold, F.col("y") == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(~flag & ~pos).alias("tn"), F.count_if(flag & ~pos).alias("fp"),
        F.count_if(~flag & pos).alias("fn"), F.count_if(flag & pos).alias("tp"))
    return counts.withColumn("f1", safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def brier(scored: DataFrame, by: By = ("k",)) -> DataFrame:
    gap = F.col("score") - F.col("y")
    return scored.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def pr_curve(scored: DataFrame, by: By = ("k",), steps: int = 100, limit: int = GROUP_ROWS) -> DataFrame:
    """Best precision reachable at recall >= j / steps, for j = 0 .. steps.

    Each cut falls in one recall cell, so the cuts shrink to at most
    ``steps + 1`` maxima per group before the running maximum is taken. Recall 0
    is reached with precision 1 by flagging nothing.
    """
    cuts = score_cuts(scored, by, limit=limit)
    cell = F.expr(f"cast({steps} * tp AS bigint) div cast(n_pos AS bigint)").cast("int")
    best = cuts.filter("n_pos > 0").groupBy(*by, cell.alias("cell")).agg(F.max("precision").alias("__p"))
    grid = (best.select(*by).distinct()
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(steps)))))
    full = same_keys(grid, best, [*by, "cell"], "left")
    w = W.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    curve = full.withColumn("precision", F.max("__p").over(w))
    return curve.select(*by, (F.col("cell") / float(steps)).alias("recall"),
                        F.when(F.col("cell") == 0, F.lit(1.0)).otherwise(F.col("precision")).alias("precision"))


def reliability(scored: DataFrame, bins: int = 10, by: By = ("k",)) -> DataFrame:
    """Mean score, observed rate and rows per score bin; bins are left-closed, score 1 is in the last."""
    place = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return scored.groupBy(*by, place.alias("bin")).agg(
        F.avg("score").alias("mean_score"), F.avg("y").alias("observed_rate"), F.count(F.lit(1)).alias("n"))


def by_group(scored: DataFrame, col: str, min_pos: int = 20, by: By = ("k",), limit: int = GROUP_ROWS,
             replicates: int | None = None, seed: int = 0, roles: Roles = DEFAULT) -> DataFrame:
    """PR-AUC per value of a column; groups with fewer than ``min_pos`` positives are left out.

    With ``replicates`` each group gets the 95 % interval of as many bootstrap draws of its own days.
    """
    keys = [*by, col]
    groups = (score_cuts(scored, keys, limit=limit).groupBy(*keys)
              .agg(_ap().alias("pr_auc"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
              .filter(F.col("n_pos") >= min_pos)
              .withColumn("base_rate_pct", ratio("n_pos", "n", 100.0)).drop("n_pos"))
    if replicates is None:
        return groups
    kept = same_keys(scored, groups.select(*keys), keys, "left_semi")
    interval = bootstrap_ci(kept, replicates, seed, keys, roles, limit=limit).drop("n_replicates")
    return same_keys(groups, interval, keys, "left")


def summary(scored: DataFrame, by: By = ("k",), threshold: float = 0.5, level: float = 0.80,
            limit: int = GROUP_ROWS) -> DataFrame:
    """One row per group: size, base rate, PR-AUC, recall at a precision, Brier score, F1 and confusion counts.

    All of it is read off the counts per distinct score, so the scored rows are evaluated once.
    """
    s, rows = F.col("score"), F.col("pos") + F.col("neg")
    count = lambda c, flag: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).cast("long")
    squares = F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s
    found = score_cuts(scored, by, limit=limit).groupBy(*by).agg(
        F.sum(rows).cast("long").alias("n"), F.sum("pos").alias("__pos"), _ap().alias("pr_auc"),
        F.max(F.when(F.col("precision") >= level, F.col("recall"))).alias("recall_at_precision"),
        safe_div(F.sum(squares), F.sum(F.when(s.isNotNull(), rows))).alias("brier"),
        count("neg", s < threshold).alias("tn"), count("neg", s >= threshold).alias("fp"),
        count("pos", s < threshold).alias("fn"), count("pos", s >= threshold).alias("tp"))
    return found.select(*by, "n", ratio("__pos", "n", 100.0).alias("base_rate_pct"), "pr_auc", "recall_at_precision",
                        "brier", "tn", "fp", "fn", "tp",
                        safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def persistence(ds: DataFrame, ks: Sequence[int] = HORIZONS, split: str | None = "test") -> DataFrame:
    """The rule "bunched now, bunched later": confusion counts, precision and recall of every horizon in one pass."""
    rows = ds.filter(F.col("is_bunched_now").isNotNull())
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    now, aggs = F.col("is_bunched_now"), []
    for k in ks:
        y = F.col(f"y_k{k}")
        aggs.append(F.struct(
            F.lit(k).alias("k"), F.avg(y).alias("base_rate"), F.count_if(now & (y == 1)).alias("tp"),
            F.count_if(now & (y == 0)).alias("fp"), F.count_if(~now & (y == 1)).alias("fn"),
            F.count_if(~now & (y == 0)).alias("tn")).alias(f"h{k}"))
    out = rows.agg(*aggs).select(F.explode(F.array(*[F.col(f"h{k}") for k in ks])).alias("h")).select("h.*")
    return out.withColumns({"precision": safe_div("tp", F.col("tp") + F.col("fp")),
                            "recall": safe_div("tp", F.col("tp") + F.col("fn"))})


def recall_at_reference(scored: DataFrame, targets: DataFrame, by: By = ("k",), limit: int = GROUP_ROWS) -> DataFrame:
    """Recall of a model where its precision equals that of a reference rule.

    ``targets`` has one row per group with the column ``target``.
    """
    cuts = same_keys(score_cuts(scored, by, limit=limit), targets.select(*by, "target"), list(by), "inner")
    picked = cuts.groupBy(*by, "target").agg(_last_cut_reaching(F.col("target")).alias("c"))
    return picked.select(*by, "target", F.col("c.recall").alias("recall"), F.col("c.precision").alias("precision"),
                         F.col("c.score").alias("threshold"))


def miss_profile(scored: DataFrame, threshold: float = 0.5, by: By = ("k",), line: str = "LineNumber") -> DataFrame:
    """Missed and found positives per group and line: counts, share of the outcome, peak share, mean score."""
    outcome = F.when(F.col("score") >= threshold, "found").otherwise("missed")
    cells = (scored.filter(F.col("y") == 1).groupBy(*by, outcome.alias("outcome"), line)
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_peak()).alias("__peak"),
                  F.sum("score").alias("__score")))
    keys = [*by, "outcome"]
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("n_outcome"), F.sum("__peak").alias("__tp"),
                                      F.sum("__score").alias("__ts"))
    out = same_keys(cells, totals, keys, "left")
    return out.select(*keys, line, "n", "n_outcome", ratio("n", "n_outcome", 100.0).alias("pct_of_outcome"),
                      ratio("__tp", "n_outcome", 100.0).alias("pct_peak"),
                      safe_div("__ts", "n_outcome").alias("mean_score"))


def degradation(metrics: DataFrame, full: str, restricted: str, metric: str = "pr_auc", by: By = ("k",),
                model: str = "model") -> DataFrame:
    """Per cent of the full model's metric that the restricted model loses."""
    value = lambda name: F.max(F.when(F.col(model) == name, F.col(metric)))
    out = metrics.groupBy(*by).agg(value(full).alias("full"), value(restricted).alias("restricted"))
    return out.withColumn("degradation_pct", safe_div(100.0 * (F.col("full") - F.col("restricted")), "full"))


def search_spread(ledger: DataFrame, metric: str, by: By = ("model", "k")) -> DataFrame:
    """Lowest, median and highest metric of the trials of each search."""
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trials"), F.min(metric).alias("lowest"),
                                   F.median(metric).alias("median"), F.max(metric).alias("highest"))


def compare(ledger: DataFrame, metric: str, models: Sequence[str] | None = None) -> DataFrame:
    """Horizon x model table of a metric."""
    grouped = ledger.groupBy("k")
    pivot = grouped.pivot("model", list(models)) if models else grouped.pivot("model")
    return pivot.agg(F.max(metric))


def blend_sweep(scored: DataFrame, weights: Sequence[float], a: str = "score", b: str = "score_b",
                by: By = ("k",), limit: int = GROUP_ROWS) -> DataFrame:
    """PR-AUC of weight * a + (1 - weight) * b for every weight, best weight marked."""
    listed = F.array(*[F.lit(float(x)) for x in weights])
    mixed = (scored.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .select(*by, "y", F.col(a).alias("__a"), F.col(b).alias("__b"), F.explode(listed).alias("weight"))
             .withColumn("score", F.col("weight") * F.col("__a") + (1 - F.col("weight")) * F.col("__b")))
    swept = average_precision(mixed, [*by, "weight"], limit=limit)
    w = W.partitionBy(*by).orderBy(F.desc("pr_auc"), "weight")  # one row per weight
    return swept.withColumn("best", F.row_number().over(w) == 1)


def importance_ranks(importance: DataFrame, by: By = ("k",), value: str = "mean") -> DataFrame:
    """Rank of each feature from the most and from the least important; one row per feature and group."""
    w = W.partitionBy(*by)
    return importance.withColumns({
        "rank": F.row_number().over(w.orderBy(F.desc(value), "feature")),
        "rank_from_last": F.row_number().over(w.orderBy(F.asc(value), F.desc("feature"))),
    })


def top_and_bottom(ranked: DataFrame, high: int = 5, low: int = 3) -> DataFrame:
    """Features among the first ``high`` or the last ``low`` of any group."""
    top = ranked.filter(F.col("rank") <= high).select("feature")
    bottom = ranked.filter(F.col("rank_from_last") <= low).select("feature")
    return top.union(bottom).distinct()
