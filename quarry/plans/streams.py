"""Streaming queries over ``events`` (phase 8), run with ``availableNow``."""

from __future__ import annotations

from quarry.plans.registry import register
from quarry.session import table
from quarry.streaming.corpus_stream import (dedup_within_watermark, period_counts, read_stream,
                                            run_available_now)


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return read_stream(spark, sf_dir, schema, glob="events.parquet")


@register("stream_dedup", sql="SELECT DISTINCT user_id FROM events")
def q_stream_dedup(spark, sf_dir):
    """STR-1: arrivals de-duplicated by key (user).  The watermark (60 days) spans the whole table, so the
    answer does not depend on how arrivals are split into files and triggers."""
    s = dedup_within_watermark(_events_stream(spark, sf_dir), ["user_id"], "ts", "60 days")
    return run_available_now(s.select("user_id"), "stream_dedup")


@register("stream_period_counts", sql="""
WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS ws, event_type
           FROM events, range(0, 7) t(k)),
wm AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events)
SELECT ws AS window_start, ws + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n
FROM w, wm WHERE ws + INTERVAL 7 DAY <= wm GROUP BY ws, event_type""")
def q_stream_period_counts(spark, sf_dir):
    """STR-2: 7-day windows sliding by 1 day per event type, closed windows only."""
    c = period_counts(_events_stream(spark, sf_dir), "ts", ["event_type"], "7 days", "1 day", "1 day")
    return run_available_now(c, "stream_period_counts")
