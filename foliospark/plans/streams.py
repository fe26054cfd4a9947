"""Queries over the event stream, in batch form."""

from __future__ import annotations

from foliospark.plans.registry import query
from foliospark.streaming import events


@query("SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS opens, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return events.windowed(events.batch(spark, d))
