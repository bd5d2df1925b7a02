"""Reading the inputs: events, trades, users, metric points, logs, alarms."""

from .events_store import write_shredded_events
from .metrics import (log_hours, metric_dim_values, metric_series, metric_series_by_dim, metric_series_by_service,
                      period_for)
from .newest import day_folders, newest_rows
from .rollups import read_rollup, write_rollup
from .tables import (scan_alarms, scan_events, scan_logs, scan_points, scan_trades,
                     scan_trades_by_timestamp, scan_users)

__all__ = ["day_folders", "log_hours", "metric_dim_values", "metric_series", "metric_series_by_dim", "metric_series_by_service",
           "newest_rows", "period_for", "read_rollup", "scan_alarms", "scan_events", "scan_logs", "scan_points", "scan_trades",
           "scan_trades_by_timestamp", "scan_users", "write_rollup",
           "write_shredded_events"]
