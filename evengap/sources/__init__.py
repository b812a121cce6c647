from evengap.sources.readers import EVENT_TYPES, read_events, read_static, read_table
from evengap.sources.sinks import (append_results, compact_results, open_clustered, pending, read_results, results_wide,
                                   write_clustered, write_report, write_table)

__all__ = ["EVENT_TYPES", "append_results", "compact_results", "open_clustered", "pending", "read_events",
           "read_results", "read_static", "read_table", "results_wide", "write_clustered", "write_report",
           "write_table"]
