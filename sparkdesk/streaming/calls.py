"""Identical tool calls of a turn dropped as they stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def distinct_calls(calls: DataFrame, within: str) -> DataFrame:
    """Calls (ts, turn_id, tool, arguments) without repeats seen within the
    delay; a call is forgotten once the watermark passes it."""
    return calls.withWatermark("ts", within).dropDuplicatesWithinWatermark(["turn_id", "tool", "arguments"])
