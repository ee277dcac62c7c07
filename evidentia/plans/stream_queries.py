"""Queries of streams (ST); each drains the files there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.plans.catalog import query
from evidentia.plans.join_queries import EDGES
from evidentia.storage import new_folder, saved
from evidentia.streaming import jobs as S
from evidentia.views import table, view


def _events(spark, sf_dir):
    return S.event_stream(spark, f"{sf_dir}/events.parquet")


def _spans(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "ts")


@query("SELECT user_id AS trace_id, event_id AS span_id, ts FROM events")
def st01_ingest_spans(spark, sf_dir):
    """Every span is sent twice."""
    twice = _spans(spark, sf_dir).withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2)))).drop("sent")
    return S.drained(S.ingest_spans(twice)).select("trace_id", "span_id", S.to_local(F.col("ts")).alias("ts"))


def _windows(width: str, starts: str) -> str:
    return f"""WITH w AS ({starts}) SELECT started_at, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_value FROM w
        GROUP BY started_at HAVING started_at + INTERVAL {width} <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query(_windows("1 DAY", "SELECT date_trunc('day', ts)::TIMESTAMP AS started_at, event_type, value FROM events"))
def st02_monitoring_windows(spark, sf_dir):
    return S.drained(S.monitoring_windows(_events(spark, sf_dir))).select(S.to_local(F.col("started_at")).alias("started_at"), "requests", "errors", F.round("mean_value", 6).alias("mean_value"))


@query(_windows("1 DAY", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS started_at, event_type, value FROM events, (VALUES (0), (1), (2), (3)) v(k)"))
def st02_sliding_windows(spark, sf_dir):
    return S.drained(S.monitoring_windows(_events(spark, sf_dir), slide="6 hours")).select(S.to_local(F.col("started_at")).alias("started_at"), "requests", "errors", F.round("mean_value", 6).alias("mean_value"))


def _requests(df):
    """Errors are failures; every state was logged as closed, every second one only before its request."""
    closed = F.lit("closed")
    return df.select(F.col("user_id").alias("service"), "event_id", F.unix_micros("ts").alias("at_us"), (F.col("event_type") == "error").alias("failed"),
                     closed.alias("logged_before"), F.when(F.col("event_id") % 2 == 1, closed).alias("logged_after"))


_BREAKERS = """WITH RECURSIVE e AS (SELECT user_id AS service, event_id, epoch_us(ts) AS at_us, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
    r AS (SELECT DISTINCT service, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS at_us, 'closed' AS before, 'closed' AS after, 0 AS failures, 0 AS passed, CAST(0 AS BIGINT) AS opened FROM e
      UNION ALL SELECT service, i, event_id, at_us, b, CASE WHEN b = 'open' THEN b WHEN trips THEN 'open' WHEN NOT failed AND b = 'half_open' AND p + 1 >= 2 THEN 'closed' ELSE b END,
        CASE WHEN b = 'open' THEN f WHEN trips OR NOT failed THEN 0 ELSE f + 1 END, CASE WHEN b = 'half_open' AND NOT failed THEN p + 1 ELSE p END, CASE WHEN trips THEN at_us ELSE opened END
      FROM (SELECT *, b <> 'open' AND failed AND (b = 'half_open' OR f + 1 >= 2) AS trips FROM
        (SELECT e.*, r.failures AS f, r.opened, CASE WHEN r.after = 'open' AND e.at_us - r.opened >= 3600000000 THEN 'half_open' ELSE r.after END AS b,
           CASE WHEN r.after = 'open' AND e.at_us - r.opened >= 3600000000 THEN 0 ELSE r.passed END AS p FROM r JOIN e ON e.service = r.service AND e.i = r.i + 1)))
    SELECT service, event_id, at_us, before AS state_before, after AS state_after, before = 'open' AS rejected,
      CASE WHEN before <> 'closed' THEN 'state_before' WHEN event_id % 2 = 1 AND after <> 'closed' THEN 'state_after' END AS violation FROM r WHERE i > 0"""


@query(_BREAKERS + " AND at_us // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)")
def st03_breakers(spark, sf_dir):
    S.rocks(spark)
    events = table(spark, sf_dir, "events").withColumn("ts", S.to_instant(F.col("ts")))
    return S.drained(S.replay_breakers_stream(_requests(S.in_order(events, 4))))


@query(_BREAKERS)
def f03_breakers(spark, sf_dir):
    return S.replay_breakers(_requests(table(spark, sf_dir, "events").withColumn("ts", S.to_instant(F.col("ts")))))


@query("""WITH e AS (SELECT ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) > date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS late FROM events)
    SELECT count(*) AS input, count_if(NOT late) AS accepted, count_if(late) AS rejected, 0 AS late, true AS adds_up FROM e""")
def st04_two_sinks(spark, sf_dir):
    """An event's value is taken as the minutes it lasts; files come in order of time, so no row is late."""
    ended = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60000000).cast("long"))
    events = table(spark, sf_dir, "events").withColumn("ts", S.to_instant(F.col("ts"))).withColumn("ended_at", ended)
    accepted, rejected, progress = (new_folder(spark) for _ in range(3))
    told = S.two_sinks(S.in_order(events, 4), accepted, rejected, progress)
    n = lambda path, name: spark.read.parquet(path).agg(F.count("*").alias(name))
    both = n(accepted, "accepted").join(n(rejected, "rejected"))
    counted = both.select(F.lit(told["input"]).cast("long").alias("input"), "accepted", "rejected", F.lit(told["late"]).cast("int").alias("late"))
    return counted.withColumn("adds_up", F.col("input") == F.col("accepted") + F.col("rejected") + F.col("late"))


@query("""SELECT event_id, CASE WHEN ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) > date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY THEN 'rejected' ELSE 'accepted' END AS sink FROM events""")
def st04_route_late(spark, sf_dir):
    """An event's value is taken as the minutes it lasts."""
    ended = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60000000).cast("long"))
    return S.drained(S.route_late(_events(spark, sf_dir).withColumn("ended_at", ended)).select("event_id", "sink"))


@query(EDGES + " AND c.ts <= p.ts + INTERVAL 7 DAY")
def st05_parent_child(spark, sf_dir):
    spans = saved(view(spark, sf_dir, "v_spans").withColumn("ts", S.to_instant(F.col("ts"))))
    stream = spark.readStream.schema(spans.schema).parquet(spans.inputFiles()[0].rsplit("/", 1)[0])
    return S.drained(S.parent_child(stream, stream)).select("trace_id", "span_id", "parent_span_id", "source", "target")


@query("SELECT event_type AS source, CAST(user_id % 50 AS VARCHAR) AS target, count(*) AS seen, count(DISTINCT event_id % 3) AS channels FROM events GROUP BY ALL")
def st06_rolling_edges(spark, sf_dir):
    edges = _events(spark, sf_dir).select(F.col("event_type").alias("source"), (F.col("user_id") % 50).alias("target"), (F.col("event_id") % 3).cast("string").alias("channel"))
    return S.rolling_edges(edges).select("source", "target", "seen", F.size("channels").cast("long").alias("channels"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id AS trace_id, min(ts) AS started_at, count(*) AS spans FROM n GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st07_sessions(spark, sf_dir):
    return S.drained(S.sessions(_spans(spark, sf_dir))).select("trace_id", S.to_local(F.col("started_at")).alias("started_at"), "spans")
