"""Streaming variants of the usage rollup and the circuit breaker (extensions:
the batch queries define the results)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from amalgam.operators.breaker import STATE, advance


def usage_by_window(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, cost and failures per window and provider; later rows than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), F.coalesce("event_type", F.lit("unknown")).alias("provider"))
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("event_type") == "error").alias("failures"))
        .select(F.col("window.start").alias("start"), "provider", "n", "cost", "failures")
    )


def breaker_stream(calls: DataFrame, key: str = "user_id") -> DataFrame:
    """The breaker's state after each micro-batch and key of (key, ts, ok)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(STATE, state.get)) if state.exists else dict(STATE)
        rows = pd.concat(list(batches)).sort_values("seconds", kind="stable")  # one micro-batch of one key
        for ts, ok in zip(rows["seconds"], rows["ok"]):
            s = advance(s, float(ts), bool(ok))
        state.update(tuple(s[c] for c in STATE))
        yield pd.DataFrame({key: [k[0]], "state": [s["state"]], "failures": [s["failures"]]})

    timed = calls.select(key, F.col("ts").cast("timestamp").cast("double").alias("seconds"), "ok")
    kind = dict(calls.dtypes)[key]
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, state string, failures int", "state string, failures int, successes int, opened double", "update", GroupStateTimeout.NoTimeout
    )
