"""Streaming forms of the look-back metrics, over a stream of events ts, op_type, duration, success."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """Event time with a watermark; times without zone are read as session time first, since watermarks need a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def retained_statistics(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding windows of each operation: n, success_rate, mean and spread of the duration; rows later than the watermark are dropped."""
    w = timed(events, late).groupBy(F.window("ts", window, slide), "op_type")
    return w.agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("duration").alias("mean"), F.stddev_pop("duration").alias("std"))


def once_by_key(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Repeated events dropped within the watermark, so that the state stays bounded."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])


def breaker_stream(events: DataFrame, failures: int = 5, window: int = 10, reset_seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """op_type, ts, state: the circuit breaker as a stateful operator; a circuit's state is at most ten failure times."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now, opened, held = state.get if state.exists else ("closed", 0.0, [])
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, ok in zip(rows["ts"], rows["success"]):
            s = ts.timestamp()
            if now == "open" and s - opened >= reset_seconds:
                now = "half_open"
            if now != "open":
                if ok:
                    now, held = "closed", []
                else:
                    held = [*held, s][-window:]
                    if sum(s - x <= window for x in held) >= failures:
                        now, opened = "open", s
            out.append((key[0], ts, now))
        state.update((now, opened, held))
        yield pd.DataFrame(out, columns=["op_type", "ts", "state"])

    return timed(events, late).groupBy("op_type").applyInPandasWithState(step, "op_type string, ts timestamp, state string", "now string, opened double, held array<double>", "append", "NoTimeout")
