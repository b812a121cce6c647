"""Weather categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WMO weather codes of every group.
WX_CODES = {
    "clear": [0],
    "cloudy": [1, 2, 3],
    "fog": [45, 48],
    "drizzle": [51, 53, 55, 56, 57],
    "rain": [61, 63, 65, 66, 67],
    "snow": [71, 73, 75, 77],
    "rain_showers": [80, 81, 82],
    "snow_showers": [85, 86],
    "thunderstorm": [95, 96, 99],
}
# Upper edges (inclusive) of the temperature bins and their labels; the lowest edge is exclusive.
TEMP_FLOOR = -100
TEMP_BINS = [(-5, "<-5"), (0, "-5_0"), (5, "0_5"), (15, "5_15"), (25, "15_25"), (100, ">25")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wx_group(code) -> Column:
    """Group name of a weather code; unknown and missing codes are 'other'."""
    rounded = F.round(_col(code)).cast("int")
    out = F.lit("other")
    for name, codes in WX_CODES.items():
        out = F.when(rounded.isin(codes), name).otherwise(out)
    return out


def temp_bin(celsius) -> Column:
    """Right-closed temperature bin; null outside the outer edges."""
    t = _col(celsius)
    out = F.when(t <= TEMP_FLOOR, F.lit(None).cast("string"))
    for upper, label in TEMP_BINS:
        out = out.when(t <= upper, label)
    return out
