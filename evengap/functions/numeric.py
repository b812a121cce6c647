"""Arithmetic helpers that give null where a ratio is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b as double; null when b is 0 or either side is null."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def ratio(hits, total, scale: float = 1.0) -> Column:
    """Share of two counts, scaled (100 for per cent)."""
    return safe_div(F.lit(scale) * _col(hits), total)


def bucket(c, width: float) -> Column:
    """Nearest multiple of ``width``. Fractions of one (0.05, 0.1) are formed as round(x * n) / n."""
    x = _col(c).cast("double")
    if width < 1:
        n = float(round(1 / width))
        return F.round(x * F.lit(n)) / F.lit(n)
    return F.round(x / F.lit(float(width))) * F.lit(float(width))


def clamp(c, lo=None, hi=None) -> Column:
    """Limit a value to [lo, hi]; null stays null."""
    x = _col(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNotNull(), out)
