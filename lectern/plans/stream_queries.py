"""Rate limits and metrics over the event table, as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans import inputs as I
from lectern.streaming import streams

SPAN = 86_400


def rate_limit_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.rate_limit_batch(I.requests(spark, d), 3, SPAN)
    return rows.select("identity", "request_id", "current", "remaining", F.round("retry_after", 0).cast("long").alias("retry_after"), "exceeded")


def rate_limit_aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.rate_limit_aligned(I.requests(spark, d), 3, SPAN)
    return rows.select("identity", F.unix_seconds("window_start").alias("window_start"), "n", "exceeded")


def metrics_cube(spark: SparkSession, d: str) -> DataFrame:
    m = streams.metrics_rollup(I.requests(spark, d))
    return m.select("outcome", "action", "n", F.col("total_latency").cast("decimal(28,2)").alias("total_latency"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "failures", F.round("repair_rate", 6).alias("repair_rate"))


def metrics_windows(spark: SparkSession, d: str) -> DataFrame:
    m = streams.metrics_windows(I.requests(spark, d), "1 day")
    return m.select(F.unix_seconds("window_start").alias("window_start"), "outcome", "n", F.col("total_latency").cast("decimal(28,2)").alias("total_latency"))


def metrics_sliding(spark: SparkSession, d: str) -> DataFrame:
    m = streams.metrics_windows(I.requests(spark, d), "2 days", "1 day")
    return m.select(F.unix_seconds("window_start").alias("window_start"), "outcome", "n")


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Daily sketches merged over all days, and whether the latencies they give lie at their ranks, within the stated error, among all requests of a cell."""
    rows = I.requests(spark, d)
    cells = streams.merged_quantiles(streams.latency_sketches(rows, "1 day"), "outcome", "action")
    at = cells.select(F.col("outcome").alias("o"), F.col("action").alias("a"), "n", "total_latency", "p50", "p95")
    none = F.lit(None).cast("string")
    of = [F.struct(o.alias("outcome"), a.alias("action")) for o in (F.col("outcome"), none) for a in (F.col("action"), none)]
    each = rows.select("latency", F.explode(F.array(*of)).alias("c"))
    met = each.join(at, F.col("o").eqNullSafe(F.col("c.outcome")) & F.col("a").eqNullSafe(F.col("c.action")))
    ranks = [F.count_if(F.col("latency").cast("double") < F.col(c)).alias(f"{c}_below") for c in ("p50", "p95")] + [F.count_if(F.col("latency").cast("double") <= F.col(c)).alias(f"{c}_to") for c in ("p50", "p95")]
    found = met.groupBy("o", "a", "n", "total_latency").agg(*ranks)
    near = lambda c, q: (F.col(f"{c}_below") / F.col("n") <= q + streams.RANK_ERROR) & (F.col(f"{c}_to") / F.col("n") >= q - streams.RANK_ERROR)
    return found.select(F.col("o").alias("outcome"), F.col("a").alias("action"), "n", F.col("total_latency").cast("decimal(28,2)").alias("total_latency"), near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


def request_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.latency_sessions(I.requests(spark, d), "6 hours")
    return s.select("identity", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


def identity_hashes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    h = streams.identity_hash(F.when(k % 3 == 0, F.concat(F.lit(" 1.2.3."), (k % 250).cast("string"), F.lit(", 9.9.9.9"))), F.when(k % 3 == 1, "5.6.7.8"), F.lit("0.0.0.0"), F.when(k % 2 == 0, F.lit("key")))
    return I.table(spark, d, "events").select("event_id", h.alias("identity"))


QUERIES = {f.__name__: f for f in (rate_limit_batch, rate_limit_aligned, metrics_cube, metrics_windows, metrics_sliding, latency_quantiles, request_sessions, identity_hashes)}

W = "WITH "

ORACLE_SQL = {
    "rate_limit_batch": "WITH RECURSIVE " + I.REQUESTS_SQL + """, o AS (SELECT identity, request_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY identity ORDER BY ts, request_id) AS i FROM requests),
  r AS (SELECT identity, request_id, i, t, t AS anchor, 1 AS n FROM o WHERE i = 1
   UNION ALL SELECT o.identity, o.request_id, o.i, o.t, CASE WHEN o.t >= r.anchor + 86400000000 THEN o.t ELSE r.anchor END, CASE WHEN o.t >= r.anchor + 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.identity = r.identity AND o.i = r.i + 1)
  SELECT identity, request_id, CAST(n AS BIGINT) AS current, CAST(greatest(0, 3 - n) AS BIGINT) AS remaining, CAST(round((anchor + 86400000000 - t) / 1000000.0, 0) AS BIGINT) AS retry_after, n > 3 AS exceeded FROM r""",
    "rate_limit_aligned": W + I.REQUESTS_SQL + " SELECT identity, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS n, count(*) > 3 AS exceeded FROM requests GROUP BY identity, floor(epoch(ts) / 86400)",
    "metrics_cube": W + I.REQUESTS_SQL + " SELECT outcome, action, count(*) AS n, CAST(sum(latency) AS DECIMAL(28, 2)) AS total_latency, round(quantile_cont(CAST(latency AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(latency AS DOUBLE), 0.95), 4) AS p95, count(*) FILTER (failed) AS failures, round(avg(CAST(repaired AS INTEGER)), 6) AS repair_rate FROM requests GROUP BY CUBE (outcome, action)",
    "metrics_windows": W + I.REQUESTS_SQL + " SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, outcome, count(*) AS n, CAST(sum(latency) AS DECIMAL(28, 2)) AS total_latency FROM requests GROUP BY floor(epoch(ts) / 86400), outcome",
    "metrics_sliding": W + I.REQUESTS_SQL + " SELECT CAST((floor(epoch(ts) / 86400) - k) * 86400 AS BIGINT) AS window_start, outcome, count(*) AS n FROM requests, (SELECT unnest([0, 1]) AS k) GROUP BY floor(epoch(ts) / 86400) - k, outcome",
    "latency_quantiles": W + I.REQUESTS_SQL + " SELECT outcome, action, count(*) AS n, CAST(sum(latency) AS DECIMAL(28, 2)) AS total_latency, true AS p50_near, true AS p95_near FROM requests GROUP BY CUBE (outcome, action)",
    "request_sessions": W + I.REQUESTS_SQL + ", g AS (SELECT identity, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY identity ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM requests), s AS (SELECT identity, t, sum(new) OVER (PARTITION BY identity ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT identity, min(t) AS session_start, max(t) + 21600000000 AS session_end, count(*) AS n FROM s GROUP BY identity, s",
    "identity_hashes": "SELECT event_id, sha256(CASE event_id % 3 WHEN 0 THEN '1.2.3.' || CAST(event_id % 250 AS VARCHAR) WHEN 1 THEN '5.6.7.8' ELSE '0.0.0.0' END || ':' || sha256(CASE WHEN event_id % 2 = 0 THEN 'key' ELSE '' END)) AS identity FROM events",
}
