"""Chains and ranking metrics of a stand-in score on the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import KEY, check
from checks.ctes import ap_sql, cuts_sql
from evengap import HORIZONS
from evengap.operators import chains, evaluate, resample
from evengap.sources import results_wide

REPLICATES = 1000


# --- cuts and operating points ---------------------------------------------------------------------------------------

@check("w21_score_cuts", "k:i score:f pos:i neg:i tp:i fp:i precision:f recall:f", "SELECT * FROM cuts")
def _(t):
    return evaluate.score_cuts(t.test)


@check("e01_persistence", "k:i base_rate:f tp:i fp:i fn:i tn:i precision:f recall:f",
       """SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM steady""")
def _(t):
    return evaluate.persistence(t.trips)


@check("e02_average_precision", "k:i pr_auc:f", "SELECT * FROM ap")
def _(t):
    return evaluate.average_precision(t.test)


@check("e02_average_precision_weighted", "k:i pr_auc:f", ap_sql("weighted", weight="w"),
       weighted="SELECT *, CASE WHEN y = 1 THEN 3.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM test")
def _(t):
    weighted = t.test.withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(0.5))
    return evaluate.average_precision(weighted, weight="w")


@check("e03_recall_at_precision", "k:i level:f recall:f precision:f threshold:f",
       """SELECT r.k, level, r.recall, c.precision, threshold FROM reached r
          LEFT JOIN cuts c ON c.k = r.k AND c.score = threshold""")
def _(t):
    return evaluate.recall_at_precision(t.test, (0.9, 0.8, 0.7))


@check("e03_recall_at_low_precision", "k:i level:f recall:f precision:f threshold:f",
       """SELECT r.k, level, r.recall, c.precision, threshold FROM (
          SELECT k, 0.1::DOUBLE AS level, min(score) FILTER (precision >= 0.1) AS threshold,
              max(recall) FILTER (precision >= 0.1) AS recall FROM cuts GROUP BY k) r
          LEFT JOIN cuts c ON c.k = r.k AND c.score = threshold""")
def _(t):
    return evaluate.recall_at_precision(t.test, (0.1,))


@check("e04_at_recall", "k:i level:f threshold:f true_alarms:i false_alarms:i false_alarms_per_day:f "
                        "false_per_true_alarm:f precision:f",
       """SELECT p.k, level, threshold, tp AS true_alarms, fp AS false_alarms, fp / n_days AS false_alarms_per_day,
          fp / nullif(tp, 0) AS false_per_true_alarm, precision FROM (
          SELECT k, CAST(r AS DOUBLE) AS level, max(score) FILTER (tp >= ceil(CAST(r AS DOUBLE) * n_pos)) AS threshold
          FROM cuts, (SELECT unnest([0.5, 0.7, 0.8]) AS r) GROUP BY k, r) p
          JOIN cuts c ON c.k = p.k AND c.score = threshold JOIN days d ON d.k = p.k""")
def _(t):
    return evaluate.at_recall(t.test)


@check("e05_at_precision", "k:i level:f recall:f threshold:f false_alarms_per_day:f",
       """SELECT r.k, level, recall, threshold, fp / n_days AS false_alarms_per_day
          FROM reached r JOIN days d ON d.k = r.k""")
def _(t):
    return evaluate.at_precision(t.test)


CONFUSION = """SELECT k, count(*) FILTER (score < 0.5 AND y = 0) AS tn, count(*) FILTER (score >= 0.5 AND y = 0) AS fp,
    count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score >= 0.5 AND y = 1) AS tp FROM test GROUP BY k"""


@check("e06_confusion", "k:i tn:i fp:i fn:i tp:i f1:f",
       f"SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM ({CONFUSION})")
def _(t):
    return evaluate.confusion(t.test)


@check("e07_brier", "k:i brier:f", "SELECT k, avg((score - y) * (score - y)) AS brier FROM test GROUP BY k")
def _(t):
    return evaluate.brier(t.test)


@check("e08_pr_curve", "k:i recall:f precision:f",
       """SELECT k, j / 100 AS recall, CASE WHEN j = 0 THEN 1 ELSE max(precision) FILTER (100 * tp >= j * n_pos) END
          AS precision FROM cuts, (SELECT unnest(range(0, 101)) AS j) GROUP BY k, j""")
def _(t):
    return evaluate.pr_curve(t.test)


@check("e09_reliability", "k:i bin:i mean_score:f observed_rate:f n:i",
       """SELECT k, least(9, floor(score * 10)) AS bin, avg(score) AS mean_score, avg(y) AS observed_rate, count(*) AS n
          FROM test GROUP BY ALL""")
def _(t):
    return evaluate.reliability(t.test)


def _group_sql(src: str, col: str, min_pos: int) -> str:
    return (f"SELECT k, {col}, sum(pos * precision) / nullif(max(n_pos), 0) AS pr_auc, sum(pos + neg) AS n, "
            f"100 * max(n_pos) / sum(pos + neg) AS base_rate_pct FROM ({cuts_sql(src, f'k, {col}')}) "
            f"GROUP BY k, {col} HAVING max(n_pos) >= {min_pos}")


@check("e10_by_line", "k:i LineNumber:s pr_auc:f n:i base_rate_pct:f", _group_sql("test", "LineNumber", 20))
def _(t):
    return evaluate.by_group(t.test, "LineNumber")


@check("e10_by_month", "k:i month_of_year:i pr_auc:f n:i base_rate_pct:f", _group_sql("test", "month_of_year", 20))
def _(t):
    return evaluate.by_group(t.test, "month_of_year")


@check("e10_by_peak", "k:i peak:b pr_auc:f n:i base_rate_pct:f", _group_sql("peaks", "peak", 5),
       peaks="SELECT *, hour_of_day IN (7, 8, 16, 17) AS peak FROM test")
def _(t):
    return evaluate.by_group(t.test.withColumn("peak", evaluate.is_peak()), "peak", min_pos=5)


@check("e10_by_weather", "k:i wx_group:s pr_auc:f n:i base_rate_pct:f", _group_sql("test_weather", "wx_group", 20))
def _(t):
    return evaluate.by_group(t.test_weather, "wx_group")


@check("e11_summary", "k:i n:i base_rate_pct:f pr_auc:f recall_at_precision:f brier:f tn:i fp:i fn:i tp:i f1:f",
       f"""SELECT s.k, n, base_rate_pct, pr_auc, recall_at_precision, brier, tn, fp, fn, tp,
           2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (
           SELECT k, count(*) AS n, 100 * avg(y) AS base_rate_pct, avg((score - y) * (score - y)) AS brier
           FROM test GROUP BY k) s JOIN ap USING (k) JOIN ({CONFUSION}) USING (k)
           JOIN (SELECT k, max(recall) FILTER (precision >= 0.3) AS recall_at_precision FROM cuts GROUP BY k) USING (k)""")
def _(t):
    return evaluate.summary(t.test, level=0.3)


# --- bootstrap -------------------------------------------------------------------------------------------------------

BOOT = {
    "dayno": "SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS d FROM (SELECT DISTINCT k, date FROM test)",
    "drawn": f"""SELECT k, r, CAST('0x' || substr(md5(r || '-' || i), 1, 8) AS BIGINT) % n_days AS d, count(*) AS w
        FROM days, range(0, {REPLICATES}) AS a(r), range(0, 1000) AS b(i) WHERE i < n_days GROUP BY ALL""",
    "redrawn": "SELECT test.*, r, w FROM test JOIN dayno USING (k, date) JOIN drawn USING (k, d)",
}


def _replicates(score: str, src: str = "redrawn", level: float = 0.3) -> str:
    return (f"SELECT k, r, sum(pos * precision) / nullif(max(n_pos), 0) AS auc, "
            f"coalesce(max(recall) FILTER (precision >= {level}), 0) AS rec "
            f"FROM ({cuts_sql(src, 'k, r', score, 'w')}) GROUP BY k, r")


@check("e12_bootstrap_ci", "k:i ci_low:f ci_high:f n_replicates:i",
       f"""SELECT k, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high,
           count(auc) AS n_replicates FROM ({_replicates('score')}) GROUP BY k""", **BOOT)
def _(t):
    return resample.bootstrap_ci(t.test, REPLICATES)


LINE_BOOT = {
    "dayno_line": """SELECT k, LineNumber, date, row_number() OVER (PARTITION BY k, LineNumber ORDER BY date) - 1 AS d,
           count(*) OVER (PARTITION BY k, LineNumber) AS nd FROM (SELECT DISTINCT k, LineNumber, date FROM test)""",
    "drawn_line": f"""SELECT k, LineNumber, r, CAST('0x' || substr(md5(r || '-' || i), 1, 8) AS BIGINT) % nd AS d,
           count(*) AS w FROM (SELECT DISTINCT k, LineNumber, nd FROM dayno_line), range(0, {REPLICATES}) AS a(r),
           range(0, 1000) AS b(i) WHERE i < nd GROUP BY ALL""",
    "redrawn_line": """SELECT test.*, r, w FROM test JOIN dayno_line USING (k, LineNumber, date)
           JOIN drawn_line USING (k, LineNumber, d)""",
}
LINE_INTERVALS = f"""SELECT k, LineNumber, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high,
           count(auc) AS n_replicates FROM (
           SELECT k, LineNumber, r, sum(pos * precision) / nullif(max(n_pos), 0) AS auc
           FROM ({cuts_sql('redrawn_line', 'k, LineNumber, r', 'score', 'w')}) GROUP BY k, LineNumber, r)
           GROUP BY k, LineNumber"""


@check("e12_bootstrap_ci_by_line", "k:i LineNumber:s ci_low:f ci_high:f n_replicates:i", LINE_INTERVALS, **LINE_BOOT)
def _(t):
    return resample.bootstrap_ci(t.test, REPLICATES, by=("k", "LineNumber"))


@check("e10_by_line_interval", "k:i LineNumber:s pr_auc:f n:i base_rate_pct:f ci_low:f ci_high:f",
       f"SELECT * EXCLUDE (n_replicates) FROM ({_group_sql('test', 'LineNumber', 20)}) JOIN ({LINE_INTERVALS}) USING (k, LineNumber)",
       **LINE_BOOT)
def _(t):
    return evaluate.by_group(t.test, "LineNumber", replicates=REPLICATES)


@check("e13_paired_bootstrap", "k:i auc_low:f auc_high:f auc_share_positive:f recall_low:f recall_high:f "
                               "recall_share_positive:f",
       f"""SELECT k, quantile_cont(d_auc, 0.025) AS auc_low, quantile_cont(d_auc, 0.975) AS auc_high,
           count(*) FILTER (d_auc > 0) / nullif(count(d_auc), 0) AS auc_share_positive,
           quantile_cont(d_rec, 0.025) AS recall_low, quantile_cont(d_rec, 0.975) AS recall_high,
           count(*) FILTER (d_rec > 0) / nullif(count(d_rec), 0) AS recall_share_positive FROM (
           SELECT k, a.auc - b.auc AS d_auc, a.rec - b.rec AS d_rec
           FROM ({_replicates('score', 'redrawn_both')}) a JOIN ({_replicates('score_b', 'redrawn_both')}) b USING (k, r))
           GROUP BY k""",
       paired_rows="SELECT * FROM test WHERE score_b IS NOT NULL",
       dayno="""SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS d,
           count(*) OVER (PARTITION BY k) AS nd FROM (SELECT DISTINCT k, date FROM paired_rows)""",
       drawn=f"""SELECT k, r, CAST('0x' || substr(md5(r || '-' || i), 1, 8) AS BIGINT) % nd AS d, count(*) AS w
           FROM (SELECT DISTINCT k, nd FROM dayno), range(0, {REPLICATES}) AS a(r), range(0, 1000) AS b(i)
           WHERE i < nd GROUP BY ALL""",
       redrawn_both="SELECT paired_rows.*, r, w FROM paired_rows JOIN dayno USING (k, date) JOIN drawn USING (k, d)")
def _(t):
    return resample.paired_bootstrap(t.test, replicates=REPLICATES, level=0.3)


# --- comparisons -----------------------------------------------------------------------------------------------------

@check("e14_recall_at_reference", "k:i target:f recall:f precision:f threshold:f",
       """SELECT r.k, target, r.recall, c.precision, threshold FROM (
          SELECT k, target, min(score) FILTER (precision >= target) AS threshold,
              max(recall) FILTER (precision >= target) AS recall
          FROM cuts JOIN (SELECT k, tp / nullif(tp + fp, 0) AS target FROM steady) USING (k) GROUP BY k, target) r
          LEFT JOIN cuts c ON c.k = r.k AND c.score = threshold""")
def _(t):
    targets = evaluate.persistence(t.trips).select(F.col("k").cast("bigint").alias("k"),
                                                   F.col("precision").alias("target"))
    return evaluate.recall_at_reference(t.test, targets)


@check("e17_miss_profile", "k:i outcome:s LineNumber:s n:i n_outcome:i pct_of_outcome:f pct_peak:f mean_score:f",
       """SELECT k, outcome, LineNumber, n, sum(n) OVER o AS n_outcome, 100.0::DOUBLE * n / sum(n) OVER o AS pct_of_outcome,
          100.0::DOUBLE * sum(p) OVER o / sum(n) OVER o AS pct_peak, sum(s) OVER o / sum(n) OVER o AS mean_score FROM (
          SELECT k, CASE WHEN score >= 0.5 THEN 'found' ELSE 'missed' END AS outcome, LineNumber, count(*) AS n,
              count(*) FILTER (hour_of_day IN (7, 8, 16, 17)) AS p, sum(score) AS s
          FROM test WHERE y = 1 GROUP BY ALL) WINDOW o AS (PARTITION BY k, outcome)""")
def _(t):
    return evaluate.miss_profile(t.test)


TWO_MODELS = {"two": f"""SELECT 'now' AS model, k, pr_auc FROM ap
    UNION ALL SELECT 'before', k, pr_auc FROM ({ap_sql('test', 'k', 'score_b')})"""}


def _two_models(t):
    """Test PR-AUC of two scores per horizon, as a ledger."""
    now = evaluate.average_precision(t.test).withColumn("model", F.lit("now"))
    before = evaluate.average_precision(t.test.filter("score_b IS NOT NULL"), score="score_b")
    return now.unionByName(before.withColumn("model", F.lit("before")))


@check("e19_degradation", "k:i full:f restricted:f degradation_pct:f",
       """SELECT *, 100 * ("full" - restricted) / nullif("full", 0) AS degradation_pct FROM (
          SELECT k, max(pr_auc) FILTER (model = 'now') AS "full", max(pr_auc) FILTER (model = 'before') AS restricted
          FROM two GROUP BY k)""", **TWO_MODELS)
def _(t):
    return evaluate.degradation(_two_models(t), "now", "before")


WIDE = """SELECT k, max(pr_auc) FILTER (model = 'before') AS before, max(pr_auc) FILTER (model = 'now') AS now
    FROM two GROUP BY k"""


@check("e20_compare", "k:i before:f now:f", WIDE, **TWO_MODELS)
def _(t):
    return evaluate.compare(_two_models(t), "pr_auc", ["before", "now"])


@check("s06_results_wide", "k:i before:f now:f", WIDE, **TWO_MODELS)
def _(t):
    return results_wide(_two_models(t), "pr_auc", values=["before", "now"])


@check("e20_search_spread", "model:s n_trials:i lowest:f median:f highest:f",
       """SELECT model, count(*) AS n_trials, min(pr_auc) AS lowest, median(pr_auc) AS median, max(pr_auc) AS highest
          FROM two GROUP BY model""", **TWO_MODELS)
def _(t):
    return evaluate.search_spread(_two_models(t), "pr_auc", ["model"])


WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


@check("e21_blend_sweep", "k:i weight:f pr_auc:f best:b",
       f"""SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr_auc DESC, weight) = 1 AS best
           FROM ({ap_sql('mixed', 'k, weight', 'blend')})""",
       mixed=f"""SELECT k, y, weight, weight * score + (1 - weight) * score_b AS blend
           FROM test, (SELECT CAST(unnest({WEIGHTS}) AS DOUBLE) AS weight) WHERE score_b IS NOT NULL""")
def _(t):
    return evaluate.blend_sweep(t.test, WEIGHTS)


IMPORTANCE = ["dwell", "speed_mps", "route_frac", "hour_of_day", "headway_ratio", "leader_dwell", "stop_sequence",
              "observed_arrival_delay", "leader_arrival_delay", "dist_traveled"]
IMPORTANCE_SQL = {"importance": " UNION ALL ".join(
    f"SELECT {k} AS k, '{c}' AS feature, round(abs(corr({c}, y_k{k})), 9) AS mean FROM trips WHERE split = 'test'"
    for k in (3, 5) for c in IMPORTANCE),
    "ranked": """SELECT *, row_number() OVER (PARTITION BY k ORDER BY mean DESC, feature) AS rank,
        row_number() OVER (PARTITION BY k ORDER BY mean, feature DESC) AS rank_from_last FROM importance"""}


def _importance(t):
    """Strength of each feature's linear relation to the label, as a stand-in importance."""
    row = t.trips.filter("split = 'test'").agg(*[
        F.round(F.abs(F.corr(c, f"y_k{k}")), 9).alias(f"{c}__{k}") for k in (3, 5) for c in IMPORTANCE])
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("feature"), F.col(f"{c}__{k}").alias("mean"))
                      for k in (3, 5) for c in IMPORTANCE])
    return row.select(F.explode(cells).alias("r")).select("r.*")


@check("w20_importance_ranks", "k:i feature:s mean:f rank:i rank_from_last:i", "SELECT * FROM ranked", **IMPORTANCE_SQL)
def _(t):
    return evaluate.importance_ranks(_importance(t))


@check("u03_top_and_bottom", "feature:s",
       "SELECT DISTINCT feature FROM ranked WHERE rank <= 5 OR rank_from_last <= 3", **IMPORTANCE_SQL)
def _(t):
    return evaluate.top_and_bottom(evaluate.importance_ranks(_importance(t)))


# --- chains ----------------------------------------------------------------------------------------------------------

@check("w16_chain_onsets", KEY + "rn:i prev_bunched:b onset:b", "SELECT * FROM onsets")
def _(t):
    return t.onsets


CHAINS = {
    "marks": """SELECT *, on_now AND NOT coalesce(lag(on_now) OVER (PARTITION BY date, trip_id ORDER BY stop_sequence), FALSE)
        AS starts FROM (SELECT date, trip_id, stop_sequence, coalesce(is_bunched_now, FALSE) AS on_now
        FROM trips WHERE split = 'test')""",
    "chain_sizes": """SELECT date, trip_id, chain, count(*) AS length FROM (
        SELECT *, sum(starts::INT) OVER (PARTITION BY date, trip_id ORDER BY stop_sequence ROWS UNBOUNDED PRECEDING)
            AS chain FROM marks) WHERE on_now GROUP BY date, trip_id, chain""",
}


@check("w17_chain_lengths", "date:i trip_id:i chain:i length:i", "SELECT * FROM chain_sizes", **CHAINS)
def _(t):
    return chains.chain_lengths(t.trips.filter("split = 'test'"))


@check("w17_chain_length_stats", "n_chains:i mean_length:f median_length:f",
       "SELECT count(*) AS n_chains, avg(length) AS mean_length, median(length) AS median_length FROM chain_sizes",
       **CHAINS)
def _(t):
    return chains.chain_length_stats(chains.chain_lengths(t.trips.filter("split = 'test'")))


@check("j10_onset_hits", "date:i trip_id:i rn:i score_k3:f",
       """SELECT o.date, o.trip_id, o.rn, s.score AS score_k3 FROM onsets o LEFT JOIN test_numbered s
          ON s.date = o.date AND s.trip_id = o.trip_id AND s.rn + 3 = o.rn AND s.k = 3 WHERE o.onset""")
def _(t):
    return chains.onset_hits(t.onsets.filter("onset").select("date", "trip_id", "rn"), t.test_numbered, 3)


HITS = {"hits": "SELECT o.date, o.trip_id, o.rn" + "".join(f", s{k}.score AS score_k{k}" for k in HORIZONS) +
        " FROM onsets o" + "".join(
            f" LEFT JOIN test_numbered s{k} ON s{k}.date = o.date AND s{k}.trip_id = o.trip_id "
            f"AND s{k}.rn + {k} = o.rn AND s{k}.k = {k}" for k in HORIZONS) + " WHERE o.onset",
        "limits": "SELECT k, CAST(p AS DOUBLE) AS level, min(score) FILTER (precision >= p) AS threshold "
                  "FROM cuts, (SELECT unnest([0.2, 0.1, 0.05]) AS p) GROUP BY k, p",
        "aimed": " UNION ALL ".join(f"SELECT date, trip_id, rn, {k} AS k, score_k{k} AS s FROM hits" for k in HORIZONS),
        "judged": "SELECT aimed.*, level, threshold FROM aimed JOIN limits USING (k)"}


def _hits(t):
    levels = evaluate.recall_at_precision(t.test, (0.2, 0.1, 0.05)).select("k", "level", "threshold")
    return chains.all_onset_hits(t.onsets.filter("onset"), t.test_numbered), levels


@check("e15_onsets_caught", "k:i level:f n_onsets:i with_prediction:i caught:i share_of_onsets:f share_of_predictable:f",
       """SELECT k, level, count(*) AS n_onsets, count(s) AS with_prediction, count(*) FILTER (s >= threshold) AS caught,
          count(*) FILTER (s >= threshold) / count(*) AS share_of_onsets,
          count(*) FILTER (s >= threshold) / nullif(count(s), 0) AS share_of_predictable FROM judged GROUP BY k, level""",
       **HITS)
def _(t):
    return chains.onsets_caught(*_hits(t))


@check("e16_earliest_warning", "level:f earliest_k:i n:i share:f",
       """SELECT level, earliest_k, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY level) AS share FROM (
          SELECT date, trip_id, rn, level, max(CASE WHEN s >= threshold THEN k ELSE 0 END) AS earliest_k
          FROM judged GROUP BY ALL) GROUP BY level, earliest_k""", **HITS)
def _(t):
    return chains.earliest_warning(*_hits(t))
