"""Cooldowns, retries and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from amalgam.operators.running import with_running_sum


def cooldown_ms(failures: Column) -> Column:
    """30 s doubled from the fifth failure in a row on, at most 10 min."""
    return F.when(failures >= 5, F.least(F.lit(600_000.0), F.lit(30_000.0) * F.pow(F.lit(2.0), failures - 5))).otherwise(0.0)


def backoff_ms(attempt: Column, rate_limited: Column) -> Column:
    """Wait before a retry, without jitter."""
    base = F.when(rate_limited, 1000.0).otherwise(250.0)
    return F.least(F.lit(5000.0), base * F.pow(F.lit(2.0), attempt))


STATE = {"state": "CLOSED", "failures": 0, "successes": 0, "opened": None}


def advance(s: dict, ts: float, ok: bool, failures: int = 5, probe_s: float = 60.0, successes: int = 2) -> dict:
    """The state after one call at ``ts`` (seconds)."""
    s = dict(s)
    if s["state"] == "OPEN" and ts - s["opened"] >= probe_s:
        s.update(state="HALF_OPEN", successes=0)
    if s["state"] == "OPEN":
        return s  # the call is refused
    if ok:
        s["failures"] = 0
        if s["state"] == "HALF_OPEN":
            s["successes"] += 1
            if s["successes"] >= successes:
                s.update(state="CLOSED", successes=0)
    else:
        s["failures"] += 1
        if s["state"] == "HALF_OPEN" or s["failures"] >= failures:
            s.update(state="OPEN", opened=ts, successes=0)
    return s


def circuit_states(calls: DataFrame, key: str) -> DataFrame:
    """The breaker's state after each call (key, ts, call_id, ok), in order of
    ts and call_id.

    The state depends on every call before, but it is closed and without failures
    for certain after the second success that comes a probe time or more after the
    last failure, whatever was before. A key's calls are cut to segments there;
    each segment streams through a task in order, and the segments of one key
    spread over all tasks. Only a key that fails at least once a minute for ever
    stays one segment."""
    slice_ = F.to_date("ts")
    within = W.partitionBy(key, "_day").orderBy("seconds", "call_id").rowsBetween(W.unboundedPreceding, 0)
    timed = calls.select(key, "ts", F.col("ts").cast("timestamp").cast("double").alias("seconds"), "call_id", "ok").withColumn("_day", slice_)
    # In a day, failures before its first call are no later than that call.
    bound = F.coalesce(F.max(F.when(~F.col("ok"), F.col("seconds"))).over(within), F.first("seconds").over(within))
    timed = timed.withColumns({"_late": (F.col("ok") & (F.col("seconds") >= bound + 60.0)).cast("int"), "_fails": F.sum((~F.col("ok")).cast("int")).over(within)})
    second = F.sum("_late").over(W.partitionBy(key, "_day", "_fails").orderBy("seconds", "call_id").rowsBetween(W.unboundedPreceding, 0)) == 2
    marked = timed.withColumn("_reset", ((F.col("_late") == 1) & second).cast("int"))
    counted = with_running_sum(marked, key, ["seconds", "call_id"], slice_, F.col("_reset"), "_resets")
    segments = counted.select(key, "seconds", "call_id", "ok", (F.col("_resets") - F.col("_reset")).alias("segment"))
    schema = f"{key} {dict(calls.dtypes)[key]}, call_id long, state string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = object(), dict(STATE)
        for pdf in batches:
            out = []
            for k, segment, ts, call, ok in zip(pdf[key], pdf["segment"], pdf["seconds"], pdf["call_id"], pdf["ok"]):
                if (k, segment) != current:
                    current, s = (k, segment), dict(STATE)
                s = advance(s, ts, bool(ok))
                out.append((k, call, s["state"]))
            yield pd.DataFrame(out, columns=[key, "call_id", "state"])

    ordered = segments.repartition(key, "segment").sortWithinPartitions(key, "segment", "seconds", "call_id")
    return ordered.mapInPandas(run, schema)
