"""Queries over events: ledgers, windows, budgets, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import ledger
from quarrymill.plans.registry import query
from quarrymill.runtime import table
from quarrymill.streaming import ledger as st


@query("SELECT event_type, count(*)::BIGINT AS calls, count(*) FILTER (WHERE value > 0)::BIGINT AS succeeded, round(sum(value), 3) AS total, count(DISTINCT user_id)::BIGINT AS users, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def ledger_totals(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 0).alias("succeeded"), F.round(F.sum("value"), 3).alias("total"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("k_sum"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events")
def rolling_hour_usage(spark, sf):
    return st.rolling_sum(table(spark, sf, "events"), "user_id", "ts", "value", 3600).select("event_id", "user_id", "rolling")


@query(
    """WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*)::BIGINT AS n FROM s GROUP BY user_id, s"""
)
def user_sessions(spark, sf):
    return st.sessions_batch(table(spark, sf, "events"), "user_id", "ts", 3600)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def daily_usage(spark, sf):
    e = table(spark, sf, "events").where("ts is not null")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def _stream(spark, sf):
    return st.event_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query()
def stream_daily_usage(spark, sf):
    """The daily windows as a stream: those the watermark has closed."""
    return st.drained(st.windowed_usage(_stream(spark, sf), "ts", "event_type", "value", "1 day", "2 hours"), "daily-usage")


@query()
def stream_sessions(spark, sf):
    return st.drained(st.sessions(_stream(spark, sf), "ts", "user_id", "1 hour", "2 hours"), "sessions")


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_unique_events(spark, sf):
    """Events once each, whatever the number of deliveries, counted after the stream is drained."""
    once = st.drained(st.once_within(_stream(spark, sf), ["event_id"], "ts", "40 days"), "unique-events")
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query()
def stream_call_budget(spark, sf):
    """Admitted and refused events of each user under a budget of 500, by persisted state."""
    e = _stream(spark, sf).where("value is not null and user_id is not null").select(F.col("user_id").cast("string").alias("user"), F.abs("value").alias("cost"), "event_id")
    got = st.drained(st.call_budget(e, "user", "cost", "event_id", 500.0), "call-budget", "update")
    last = got.groupBy("key").agg(F.max_by(F.struct("admitted", "refused", "spent"), "batch_id").alias("s"))
    return last.select(F.col("key").alias("user"), "s.admitted", "s.refused", "s.spent")


@query(
    """WITH c AS (SELECT event_id, ts, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS n_role FROM events),
r AS (SELECT *, n_role <= CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 300 WHEN 'purchase' THEN 200 ELSE 0 END AS in_role FROM c),
t AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n_total FROM r WHERE in_role)
SELECT r.event_id, r.event_type, coalesce(t.n_total <= 800, FALSE) AS admitted FROM r LEFT JOIN t USING (event_id)"""
)
def budget_admission(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return ledger.admitted(e, "event_type", ["ts", "event_id"], {"click": 500, "view": 300, "purchase": 200}, 800).select("event_id", "event_type", "admitted")


@query("SELECT user_id, count(*)::INT AS version, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def registry_replay(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return ledger.replay(e, "user_id", ["event_id"], ["last_type", "last_value"], kind="last_type").select("user_id", F.col("version").cast("int").alias("version"), "last_type", "last_value")


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'changed' ELSE 'new' END AS status FROM documents WHERE n_chars > 2000 OR doc_id % 97 = 0")
def stream_drift(spark, sf):
    """Documents as a stream against a frozen copy in which long ones were cut and some are missing."""
    d = table(spark, sf, "documents")
    frozen = d.where("doc_id % 97 <> 0 or n_chars > 2000").withColumn("text", F.when(F.col("n_chars") > 2000, F.substring("text", 1, 1000)).otherwise(F.col("text")))
    # an empty text and a missing one are the same here
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    flat = d.select("doc_id", "text")
    folder, file = (f"{sf}/documents.parquet", "*.parquet") if _is_folder(spark, f"{sf}/documents.parquet") else (sf, "documents.parquet")
    live = st.event_stream(spark, folder, file, d.schema, 100).select(flat.columns)
    return st.drained(st.drift(live, frozen.select("doc_id", "text"), "doc_id", digest), "drift")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
