from evengap.functions.geo import grid_key, tile_x, tile_y, web_mercator_x, web_mercator_y
from evengap.functions.numeric import bucket, clamp, ratio, safe_div
from evengap.functions.time import add_seconds, dow0, hour_floor, local_to_utc, service_midnight
from evengap.functions.weather import temp_bin, wx_group

__all__ = [
    "add_seconds", "bucket", "clamp", "dow0", "grid_key", "hour_floor", "local_to_utc", "ratio", "safe_div",
    "service_midnight", "temp_bin", "tile_x", "tile_y", "web_mercator_x", "web_mercator_y", "wx_group",
]
