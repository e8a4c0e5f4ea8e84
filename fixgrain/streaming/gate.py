"""Extension: the curation gate and event counts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curate import curate


def gated(stream: DataFrame) -> DataFrame:
    """The gate is row-local, so it runs on a stream of findings as it does on a table."""
    return curate(stream)


def new_only(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the delay; later repeats are dropped with bounded state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", delay: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
