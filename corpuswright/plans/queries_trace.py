"""Queries over logs: events stand for traces (type for status, value for latency, props for a record)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, trace
from ..sources import tables
from ..streaming import events as streams
from ..streaming import sinks
from .catalogue import query, table


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    gate = F.struct(F.when(F.col("event_type") == "error", "refine_once").otherwise("answer").alias("decision"))
    usage = lambda n: F.struct(n.alias("total_tokens"), F.create_map(F.col("event_type"), F.struct(n.alias("total_tokens"))).alias("by_stage"))
    shadow = F.struct(gate.alias("initial_gate"), F.struct(F.lit("answer").alias("decision")).alias("final_gate"), (F.col("event_type") == "error").alias("refinement_executed"), F.create_map(F.lit("total"), F.col("value")).alias("latency_ms"), usage(k).alias("token_usage"))
    return log(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("run_id"), F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("completed_at"), F.col("ts").cast("string").alias("started_at"), F.col("event_type").alias("final_status"),
        F.when(k % 2 == 0, shadow).alias("shadow_adaptive"), F.create_map(F.lit("total"), F.col("value")).alias("latency_ms"), usage(k).alias("token_usage"),
        F.struct((k % 5 - 2).cast("int").alias("removed_count")).alias("grounding"), F.when(k % 3 == 0, F.struct((k % 2 == 0).alias("pii_redacted"))).alias("privacy"),
    )


_T = "t AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"


@query(f"""WITH {_T}, s AS (SELECT *, k % 2 = 0 AS shadow, event_type = 'error' AS err, greatest(coalesce(k % 5 - 2, 0), 0) AS removed FROM t)
SELECT count(*) AS record_count, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, sum(coalesce(k, 0))::BIGINT AS tokens, round_even(avg(coalesce(k, 0)), 2) AS tokens_per_trace,
 sum(removed)::BIGINT AS removed_sentences, count(*) FILTER (removed > 0) AS traces_with_removals, count(*) FILTER (shadow) AS shadow_count, round_even(count(*) FILTER (shadow AND err)::DOUBLE / nullif(count(*) FILTER (shadow), 0), 4) AS would_activate_rate,
 count(*) FILTER (shadow AND err) AS refinements, count(*) FILTER (shadow AND err) AS rescues, round_even(count(*) FILTER (shadow AND err)::DOUBLE / nullif(count(*) FILTER (shadow AND err), 0), 4) AS rescue_rate,
 round(quantile_cont(value, 0.5) FILTER (shadow), 6) AS shadow_p50, round(quantile_cont(value, 0.95) FILTER (shadow), 6) AS shadow_p95, sum(CASE WHEN shadow THEN k ELSE 0 END)::BIGINT AS additional_tokens, count(*) FILTER (k % 3 = 0 AND shadow) AS redacted, count(*) FILTER (k % 3 <> 0 OR k IS NULL) AS without_privacy FROM s""")
def trace_summary(spark, sf_dir):
    out = trace.summary(traces(spark, sf_dir))
    out = out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "shadow_p50", "shadow_p95")})
    return out.withColumn("first", _plain(F.col("first"))).withColumn("last", _plain(F.col("last")))


def _plain(at):
    return at.cast("timestamp_ntz").cast("string")


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def trace_counts(spark, sf_dir):
    return trace.counted(traces(spark, sf_dir), F.col("final_status"), "unknown")


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.5) AS n50, quantile_disc(value, 0.95) AS n95 FROM events GROUP BY 1""")
def percentiles(spark, sf_dir):
    found = metrics.group_percentiles(log(spark, sf_dir), "event_type", "value", [0.5, 0.95])
    at = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)))
    return found.groupBy("event_type").agg(F.round(at(0.5, "linear"), 6).alias("p50"), F.round(at(0.95, "linear"), 6).alias("p95"), at(0.5, "nearest").alias("n50"), at(0.95, "nearest").alias("n95"))


@query(f"WITH {_T}, u AS (SELECT event_type AS stage, k FROM t UNION ALL SELECT 'shadow.' || event_type, k FROM t WHERE k % 2 = 0) SELECT stage, sum(k)::BIGINT AS total_tokens FROM u GROUP BY 1")
def stage_tokens(spark, sf_dir):
    return trace.stage_tokens(traces(spark, sf_dir))


@query("SELECT event_id FROM events WHERE event_type = 'error' OR ('0x' || left(sha256(event_id::VARCHAR), 8))::BIGINT / 4294967295.0::DOUBLE < 0.25")
def trace_sampling(spark, sf_dir):
    return log(spark, sf_dir).filter(trace.sampled(F.col("event_id").cast("string"), 0.25, F.col("event_type") == "error")).select("event_id")


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_prune(spark, sf_dir):
    rows = log(spark, sf_dir)
    last = rows.agg(F.max("ts").alias("__last"))
    return trace.retained(rows.crossJoin(F.broadcast(last)), F.col("ts"), F.col("__last") - F.expr("interval 7 days")).select("event_id")


@query("""WITH l AS (SELECT CASE WHEN event_id % 7 = 0 THEN left(props, 3) WHEN event_id % 11 = 0 THEN '' ELSE props END AS line FROM events) SELECT count(*) AS lines, count(*) FILTER (line IS NULL OR line = '' OR NOT json_valid(line)) AS malformed FROM l""")
def jsonl_malformed(spark, sf_dir):
    line = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 11 == 0, "").otherwise(F.col("props"))
    parsed = tables.parsed_lines(log(spark, sf_dir).select(line.alias("value")), "k bigint")
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed"))


@query("SELECT date_trunc('day', ts)::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_window(spark, sf_dir):
    return streams.windowed(log(spark, sf_dir)).withColumn("window_start", _plain(F.col("window_start")))


@query("""WITH m AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(ts)::VARCHAR AS session_start, count(*) AS n, count(*) > 1 AS over_quota FROM g GROUP BY user_id, run""")
def session_quota(spark, sf_dir):
    return streams.sessions(log(spark, sf_dir), quota=1).withColumn("session_start", _plain(F.col("session_start")))


@query("""WITH m AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT event_id, user_id, (min(ts) OVER (PARTITION BY user_id, run))::VARCHAR AS session_start, row_number() OVER r AS n, row_number() OVER r > 1 AS over_quota FROM g WINDOW r AS (PARTITION BY user_id, run ORDER BY ts, event_id)""")
def session_decisions(spark, sf_dir):
    """What the quota says of each event as it comes, by the batch twin of the stream's state."""
    return sinks.decided_batch(log(spark, sf_dir), quota=1).withColumn("session_start", _plain(F.col("session_start")))
