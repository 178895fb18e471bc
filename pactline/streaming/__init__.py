"""Incremental counts and alert evaluation with Structured Streaming."""

from pactline.streaming.alerts import watch_alerts
from pactline.streaming.counters import (
    count_distinct_keys,
    count_rows,
    stream_rows,
    unique_key_totals,
)

__all__ = ["count_distinct_keys", "count_rows", "stream_rows", "unique_key_totals", "watch_alerts"]
