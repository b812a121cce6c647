"""Features that look back along the trip, and labels that look ahead.

Feature functions ask :func:`along` for ``ahead=0`` and only use lags and
preceding frames. The two exceptions read what is known beforehand: the
timetable and per-stop statistics of the training months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.operators.select import check_leakage
from evengap.operators.skew import GROUP_ROWS, LOOK, along
from evengap.roles import DEFAULT, HORIZONS, Roles

SEQUENCE_STEPS = 6
SEQUENCE_SIGNALS = {"hr": "headway_ratio", "dw": "dwell", "dg": "delay_growth"}


def lag_columns(col: str, ns: Sequence[int], name: str | None = None):
    return lambda w: {f"{name or col}_lag{n}": F.lag(col, n).over(w) for n in ns}


def closing_columns(n: int, col: str = "headway_ratio"):
    return lambda w: {f"closing_speed_{n}": (F.col(col) - F.lag(col, n).over(w)) / float(n)}


def rolling_columns(col: str, n: int, name: str):
    return lambda w: {name: F.sum(col).over(w.rowsBetween(-(n - 1), 0))}


def combine(*builders):
    return lambda w: {name: c for b in builders for name, c in b(w).items()}


def _trip(df: DataFrame, builder, roles: Roles, limit: int, back: int = 0, ahead: int = 0, hot=LOOK) -> DataFrame:
    return along(df, roles.trip_group, [F.col(roles.seq)], builder, back=back, ahead=ahead, limit=limit, hot=hot)


def with_lags(df: DataFrame, col: str, ns: Sequence[int], name: str | None = None, roles: Roles = DEFAULT,
              limit: int = GROUP_ROWS) -> DataFrame:
    return _trip(df, lag_columns(col, ns, name), roles, limit, back=max(ns))


def with_closing(df: DataFrame, n: int = 3, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """Change of the headway ratio per stop over the last ``n`` stops."""
    return _trip(df, closing_columns(n), roles, limit, back=n)


def rolling_sum(df: DataFrame, col: str, n: int, name: str, roles: Roles = DEFAULT,
                limit: int = GROUP_ROWS) -> DataFrame:
    """Sum over this row and the ``n - 1`` before it; null when all of them are null."""
    return _trip(df, rolling_columns(col, n, name), roles, limit, back=n - 1)


def with_history(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """All short-history features in one pass over the trip."""
    builder = combine(
        lag_columns("headway_ratio", (1, 2, 3)), closing_columns(3),
        rolling_columns("delay_growth", 3, "cum_delay_growth_3"), lag_columns("speed_mps", (1, 2), "speed"))
    return _trip(df, builder, roles, limit, back=3, hot=hot)


def stop_medians(df: DataFrame, col: str, name: str, roles: Roles = DEFAULT) -> DataFrame:
    """Exact median per stop. Durations are whole seconds, so the merged value counts stay small."""
    return df.groupBy(roles.stop).agg(F.median(col).alias(name))


def with_rel_median(df: DataFrame, fit_split: str | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """Dwell relative to the median dwell of the stop.

    The medians come from an aggregate that is joined back, so a busy stop is
    never sorted in one task. By default they use every row; ``fit_split``
    restricts them to one split.
    """
    base = df if fit_split is None else df.filter(F.col("split") == fit_split)
    medians = stop_medians(base, "dwell", "__median", roles)
    return (df.join(medians, roles.stop, "left")
            .withColumn("dwell_rel_median", F.col("dwell") - F.col("__median")).drop("__median"))


def with_targets(df: DataFrame, ks: Sequence[int] = HORIZONS, same_pair: bool = False, roles: Roles = DEFAULT,
                 limit: int = GROUP_ROWS, hot=LOOK) -> DataFrame:
    """Label ``k`` stops later on the same trip, and whether the trip gets that far.

    With ``same_pair`` the label is also null when the leader there is another
    trip than here.
    """
    def columns(w):
        out = {}
        for k in ks:
            known = F.lead("headway_ratio", k).over(w).isNotNull()
            if same_pair:
                known = known & (F.lead("leader_trip_id", k).over(w) == F.col("leader_trip_id"))
            out[f"y_k{k}"] = F.when(known, F.lead("is_bunched", k).over(w).cast("int"))
            out[f"target_valid_k{k}"] = F.lead(roles.seq, k).over(w).isNotNull()
        return out

    return _trip(df, columns, roles, limit, ahead=max(ks), hot=hot)


_LONG_LAGS = combine(
    lag_columns("headway_ratio", (5, 8)), closing_columns(8),
    rolling_columns("delay_growth", 8, "cum_delay_growth_8"),
    rolling_columns("dwell", 3, "dwell_sum_3"), rolling_columns("dwell", 5, "dwell_sum_5"))


def with_long_lags(df: DataFrame, roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    return _trip(df, _LONG_LAGS, roles, limit, back=8)


def _sched_run(roles: Roles, ns: Sequence[int]):
    return lambda w: {f"sched_run_{n}": F.lead(roles.sched_arr, n).over(w) - F.col(roles.sched_arr) for n in ns}


def with_sched_run(df: DataFrame, ns: Sequence[int] = (5, 8), roles: Roles = DEFAULT,
                   limit: int = GROUP_ROWS) -> DataFrame:
    """Timetabled running time to the stops ahead."""
    return _trip(df, _sched_run(roles, ns), roles, limit, ahead=max(ns))


def _ahead(ns: Sequence[int], sums: dict[str, str]):
    return lambda w: {f"{name}_{n}": F.sum(col).over(w.rowsBetween(1, n)) for name, col in sums.items() for n in ns}


def with_ahead(df: DataFrame, ns: Sequence[int] = (5, 8), train_to: int = 9, roles: Roles = DEFAULT,
               limit: int = GROUP_ROWS) -> DataFrame:
    """Training-month median dwell and interchange count summed over the stops ahead."""
    joined = _with_train_median(df, train_to, roles).withColumn("__ic", F.col("is_interchange").cast("int"))
    out = _trip(joined, _ahead(ns, {"ahead_med_dwell": "med_dwell_train", "ahead_interchanges": "__ic"}),
                roles, limit, ahead=max(ns))
    return out.drop("__ic")


def _with_train_median(df: DataFrame, train_to: int, roles: Roles) -> DataFrame:
    medians = stop_medians(df.filter(F.col("month_of_year") <= train_to), "dwell", "med_dwell_train", roles)
    return df.join(medians, roles.stop, "left")


def with_long_features(df: DataFrame, train_to: int = 9, roles: Roles = DEFAULT,
                       limit: int = GROUP_ROWS) -> DataFrame:
    """Long history, timetable and look-ahead columns in one pass over the trip."""
    joined = _with_train_median(df, train_to, roles).withColumn("__ic", F.col("is_interchange").cast("int"))
    builder = combine(_LONG_LAGS, _sched_run(roles, (5, 8)),
                      _ahead((5, 8), {"ahead_med_dwell": "med_dwell_train", "ahead_interchanges": "__ic"}))
    return _trip(joined, builder, roles, limit, back=8, ahead=8).drop("__ic", "med_dwell_train")


def sequence_frame(df: DataFrame, signals: dict[str, str] | None = None, steps: int = SEQUENCE_STEPS,
                   roles: Roles = DEFAULT, limit: int = GROUP_ROWS) -> DataFrame:
    """The last ``steps`` values of each signal, oldest first, as flat columns."""
    signals = signals or SEQUENCE_SIGNALS
    check_leakage(list(signals.values()))
    builder = lambda w: {
        f"{short}_{i}": F.lag(col, steps - 1 - i).over(w) for i in range(steps) for short, col in signals.items()}
    out = _trip(df, builder, roles, limit, back=steps - 1)
    return out.select(*roles.key, *[f"{short}_{i}" for i in range(steps) for short in signals])


def pack_sequence(df: DataFrame, channels: Sequence[str], steps: int = SEQUENCE_STEPS,
                  name: str = "sequence") -> DataFrame:
    """Pack flat step columns into one array of steps, each an array of channels."""
    step = lambda i: F.array(*[F.col(f"{c}_{i}").cast("double") for c in channels])
    return df.withColumn(name, F.array(*[step(i) for i in range(steps)]))
