"""Structured Streaming forms of the incremental behaviour: latest draft, debounce by sessions, idempotent ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_drafts(events: DataFrame, key: str = "user_id", value: str = "event_id", at: str = "ts") -> DataFrame:
    """K1, K2: the newest draft of each key; update mode on a stream."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias("latest"), F.max(at).alias("at"))


def debounced(events: DataFrame, gap: str = "10 minutes", key: str = "user_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each quiet-bounded burst, when the gap has passed; late events beyond the watermark are dropped (K4)."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("burst"), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def ledger(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """K7: each job once, whatever is delivered again within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
