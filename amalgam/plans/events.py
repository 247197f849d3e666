"""Operational analytics over the event log: usage, cost, latency, failures.

event_type stands for the provider, value for cost and latency, the error type
for failed calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from amalgam.operators.breaker import circuit_states, cooldown_ms
from amalgam.operators.running import nearest_rank, rolling_percentiles, streaks, with_running_sum, with_running_sums
from amalgam.runtime import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events")


def _day():
    return F.date_format("ts", "yyyy-MM-dd")


def _month():
    return F.date_format("ts", "yyyy-MM")


def _failed():
    return F.col("event_type") == "error"


_SETS = "GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d')), (strftime(ts, '%Y-%m')), (coalesce(event_type, 'unknown')), ())"


@query(
    "a17_usage_rollup",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, coalesce(event_type, 'unknown') AS provider,
          count(*) AS n, round(sum(value), 4) AS cost, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events {_SETS}""",
)
def a17_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(_day().alias("day"), _month().alias("month"), F.coalesce("event_type", F.lit("unknown")).alias("provider"), "value", _failed().alias("failed"))
    return rows.groupingSets([["day"], ["month"], ["provider"], []], "day", "month", "provider").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.count_if("failed").alias("failures")
    )


#: A month's budget; it is at risk once the projection passes four fifths of it.
BUDGET = 50_000.0


@query(
    "a18_a19_cost_outlook",
    """SELECT month, round(cost / days_passed, 4) AS per_day, round(cost / days_passed * days_in_month, 4) AS projected, round(greatest(0.0, 50000.0 - cost / days_passed * days_in_month), 4) AS remaining, cost / days_passed * days_in_month > 40000.0 AS at_risk,
          round(CASE WHEN n - failures > 0 THEN cost / (n - failures) ELSE 0 END, 6) AS per_success
       FROM (SELECT strftime(ts, '%Y-%m') AS month, sum(value) AS cost, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures,
               max(day(ts)) AS days_passed, max(day(last_day(ts))) AS days_in_month FROM events GROUP BY 1)""",
)
def _(spark, sf):
    m = _events(spark, sf).groupBy(_month().alias("month")).agg(
        F.sum("value").alias("cost"), F.count("*").alias("n"), F.count_if(_failed()).alias("failures"),
        F.max(F.dayofmonth("ts")).alias("passed"), F.max(F.dayofmonth(F.last_day("ts"))).alias("days"),
    )
    good, projected = F.col("n") - F.col("failures"), F.col("cost") / F.col("passed") * F.col("days")
    return m.select(
        "month", F.round(F.col("cost") / F.col("passed"), 4).alias("per_day"), F.round(projected, 4).alias("projected"),
        F.round(F.greatest(F.lit(0.0), F.lit(BUDGET) - projected), 4).alias("remaining"), (projected > F.lit(BUDGET * 0.8)).alias("at_risk"),
        F.round(F.when(good > 0, F.col("cost") / good).otherwise(0.0), 6).alias("per_success"),
    )


@query(
    "a20_daily_trend",
    """WITH span AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events),
        days AS (SELECT unnest(generate_series(a, b + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS d FROM span),
        used AS (SELECT ts::DATE AS d, sum(value) AS cost, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT strftime(days.d, '%Y-%m-%d') AS day, round(coalesce(cost, 0), 4) AS cost, coalesce(n, 0) AS n FROM days LEFT JOIN used USING (d)""",
)
def _(spark, sf):
    e = _events(spark, sf)
    days = e.agg(F.explode(F.sequence(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 3))).alias("d"))
    used = e.filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("cost"), F.count("*").alias("n"))
    return days.join(used, "d", "left").select(
        F.date_format("d", "yyyy-MM-dd").alias("day"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "a21_w10_quota",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS used_month,
         CASE WHEN sum(value) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 0.95 * 5000 THEN 'critical'
              WHEN sum(value) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 0.80 * 5000 THEN 'warn' ELSE 'ok' END AS level
       FROM events""",
)
def _(spark, sf, quota: float = 5000.0):
    e = _events(spark, sf).withColumn("k", F.concat_ws("|", "user_id", _month()))
    used = with_running_sum(e, "k", ["ts", "event_id"], F.to_date("ts"), F.col("value"), "used")
    level = F.when(F.col("used") >= 0.95 * quota, "critical").when(F.col("used") >= 0.80 * quota, "warn").otherwise("ok")
    return used.select("event_id", F.round("used", 4).alias("used_month"), level.alias("level"))


@query(
    "a22_log_stats",
    """SELECT event_type, count(*) AS total, round(sum(value), 4) AS cost, floor(avg(value) + 0.5) AS avg_latency, round(sum(value) / count(*), 6) AS cost_per_request FROM events GROUP BY 1""",
)
def _(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(
        F.count("*").alias("total"), F.round(F.sum("value"), 4).alias("cost"), F.floor(F.avg("value") + F.lit(0.5)).cast("double").alias("avg_latency"),
        F.round(F.sum("value") / F.count("*"), 6).alias("cost_per_request"),
    )


@query(
    "a23_percentiles",
    """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""",
)
def _(spark, sf):
    return nearest_rank(_events(spark, sf), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query(
    "a24_a27_counts",
    """SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS won,
         round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END) / count(*), 6) AS avg_latency, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*)) AS uptime FROM events""",
)
def _(spark, sf):
    return _events(spark, sf).agg(
        F.count("*").alias("total"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("won"),
        F.round(F.sum(F.when(~_failed(), F.col("value")).otherwise(0.0)) / F.count("*"), 6).alias("avg_latency"),  # failures count in the denominator
        F.round(F.count_if(~_failed()) / F.count("*"), 6).alias("success_rate"), F.round(F.lit(100.0) * F.count_if(~_failed()) / F.count("*")).alias("uptime"),
    )


@query(
    "w04_rolling_latency",
    """WITH r AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)) AS l FROM events WHERE event_type <> 'error')
       SELECT event_id, l[greatest(1, ceil(0.5 * len(l)))::BIGINT] AS p50, l[greatest(1, ceil(0.95 * len(l)))::BIGINT] AS p95 FROM r""",
)
def _(spark, sf):
    e = _events(spark, sf).filter(~_failed())
    return rolling_percentiles(e, "user_id", ["ts", "event_id"], F.to_date("ts"), "value", 100, {"p50": 0.5, "p95": 0.95}).select("event_id", "p50", "p95")


@query(
    "w05_last_calls",
    """SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50""",
)
def _(spark, sf):
    e = _events(spark, sf)
    # The last 50 of each part first, so that no key's whole history is sorted in one task.
    part = W.partitionBy("event_type", "salt").orderBy(F.desc("ts"), F.desc("event_id"))
    near = e.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(64))).withColumn("r", F.row_number().over(part)).filter("r <= 50")
    whole = W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return near.withColumn("r", F.row_number().over(whole)).filter("r <= 50").select("event_type", "event_id", "value")


_STREAK = """WITH i AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
        s AS (SELECT event_id, CASE WHEN bad THEN sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM i)"""


@query(
    "w06_w07_failure_streaks",
    f"""{_STREAK} SELECT event_id, streak::BIGINT AS streak, CASE WHEN streak >= 5 THEN least(600000.0, 30000.0 * pow(2.0, streak - 5)) ELSE 0.0 END AS cooldown_ms FROM s WHERE streak > 0""",
)
def _(spark, sf):
    s = streaks(_events(spark, sf), "user_id", ["ts", "event_id"], F.to_date("ts"), _failed(), "streak")
    return s.filter("streak > 0").select("event_id", "streak", cooldown_ms(F.col("streak")).alias("cooldown_ms"))


@query(
    "w08_circuit_states",
    """WITH RECURSIVE c AS (SELECT user_id, event_id AS call_id, epoch(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        -- the state after a call: state, failures in a row, successes since half open, time of opening
        m(user_id, call_id, k, state, fails, wins, opened) AS (
          SELECT user_id, call_id, k, 'CLOSED', CASE WHEN ok THEN 0 ELSE 1 END, 0, NULL::DOUBLE FROM c WHERE k = 1
          UNION ALL
          SELECT user_id, call_id, k,
            CASE WHEN s = 'OPEN' THEN 'OPEN' WHEN ok THEN CASE WHEN s = 'HALF_OPEN' AND w + 1 < 2 THEN 'HALF_OPEN' ELSE 'CLOSED' END WHEN s = 'HALF_OPEN' OR fails + 1 >= 5 THEN 'OPEN' ELSE 'CLOSED' END,
            CASE WHEN s = 'OPEN' THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
            CASE WHEN s = 'OPEN' THEN w WHEN ok AND s = 'HALF_OPEN' AND w + 1 < 2 THEN w + 1 WHEN ok AND s = 'HALF_OPEN' THEN 0 WHEN NOT ok AND (s = 'HALF_OPEN' OR fails + 1 >= 5) THEN 0 ELSE w END,
            CASE WHEN s <> 'OPEN' AND NOT ok AND (s = 'HALF_OPEN' OR fails + 1 >= 5) THEN t ELSE opened END
          FROM (SELECT c.user_id, c.call_id, c.k, c.t, c.ok, m.fails, m.opened, CASE WHEN m.state = 'OPEN' AND c.t - m.opened >= 60.0 THEN 'HALF_OPEN' ELSE m.state END AS s,
                  CASE WHEN m.state = 'OPEN' AND c.t - m.opened >= 60.0 THEN 0 ELSE m.wins END AS w FROM m JOIN c ON c.user_id = m.user_id AND c.k = m.k + 1))
        SELECT user_id, call_id, state FROM m""",
)
def _(spark, sf):
    calls = _events(spark, sf).select("user_id", "ts", F.col("event_id").alias("call_id"), (~_failed()).alias("ok"))
    return circuit_states(calls, "user_id")


@query(
    "w09_failure_rate",
    """SELECT event_id, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS failure_rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    order, day = ["ts", "event_id"], F.to_date("ts")
    b = with_running_sums(_events(spark, sf), "user_id", order, day, {"bad": F.when(_failed(), 1).otherwise(0), "n": F.lit(1)})
    return b.select("event_id", F.round(F.col("bad") / F.col("n"), 6).alias("failure_rate"))


@query("t01_page", "SELECT event_id, (SELECT count(*) FROM events) AS total, ceil((SELECT count(*) FROM events) / 20.0)::BIGINT AS total_pages FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def _(spark, sf, page: int = 2, size: int = 20):
    """A page of the newest events with the numbers of rows and pages."""
    e = _events(spark, sf)
    total = e.agg(F.count("*").alias("total"))
    rows = e.orderBy(F.desc("ts"), F.desc("event_id")).offset((page - 1) * size).limit(size).select("event_id")
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / F.lit(float(size))))  # one row


@query("t06_cache_stats", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50")
def _(spark, sf):
    return _events(spark, sf).orderBy(F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("f27_errors_in_range", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, sf):
    return _events(spark, sf).filter("event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'").select("event_id", "user_id", "value")


@query("proj13_clean_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, sf):
    """Properties without sensitive keys (compared in lower case on both sides)."""
    sensitive = ["email", "phone", "name", "address", "token", "password"]
    props = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~F.lower(k).isin(*sensitive))
    return _events(spark, sf).select("event_id", F.try_element_at(props, F.lit("k")).alias("k")).filter("k IS NOT NULL")


@query(
    "a37_d04_distinct_users",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    return _events(spark, sf).groupBy(_day().alias("day"), "event_type").agg(F.countDistinct("user_id").alias("users"))
