"""Structured Streaming twins of four batch results, for results that refresh by themselves."""

from .attribution import stream_time_to_trade, with_open_taps
from .rollups import (Run, metric_rollup, run_available, stream_concurrent_users, stream_errors_per_hour, stream_metric_rollup,
                      viewers_per_bucket, with_open_windows)

__all__ = ["Run", "metric_rollup", "run_available", "stream_concurrent_users", "stream_errors_per_hour", "stream_metric_rollup",
           "stream_time_to_trade", "viewers_per_bucket", "with_open_taps", "with_open_windows"]
