"""Registered queries: streams drained over the whole event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions.ids import content_hash
from folioscan.operators.ranks import previous_value
from folioscan.plans import fixtures as X
from folioscan.plans.registry import query
from folioscan.streaming import jobs, pacing

MINUTE = "yyyy-MM-dd HH:mm"


def _stamp(c: str, fmt: str = MINUTE):
    return F.date_format(c, fmt).alias(c)


def both(spark, d, end, late, shape):
    """The stream, and the part of a finished table that it holds back."""
    events = jobs.event_table(spark, d, "events")
    return shape(jobs.stream_table(spark, d, "events")), jobs.tail(shape(events), events, end, late)


@query("stream_tumbling_by_type", "S2 S1 AGG17 S10", """
with w as (select time_bucket(interval 1 hour, ts) s, event_type, count(*) n, sum(value) total from events group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, event_type, n, round(total, 6) as total from w""")
def stream_tumbling_by_type(spark, d):
    w, rest = both(spark, d, "window_end", "2 hours", lambda e: jobs.windows(e, ["event_type"], "1 hour", None, "2 hours"))
    return jobs.drain(w, "tumbling", rest).select(_stamp("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sliding_metrics", "S1 Z20", """
with w as (select unnest(range(time_bucket(interval 5 minute, ts) - interval 10 minute, time_bucket(interval 5 minute, ts) + interval 1 minute, interval 5 minute)) s, value from events)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, count(*) as n, round(avg(value), 6) as mean from w group by 1""")
def stream_sliding_metrics(spark, d):
    w, rest = both(spark, d, "window_end", "24 hours", lambda e: jobs.windows(e, [], "15 minutes", "5 minutes", "24 hours"))
    return jobs.drain(w, "sliding", rest).select(_stamp("window_start"), "n", F.round("mean", 6).alias("mean"))


@query("stream_sessions", "S3", """
with o as (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events),
s as (select *, sum(case when p is null or ts >= p + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) sid from o),
g as (select user_id, min(ts) a, max(ts) + interval 30 minute b, sum((event_type = 'view')::int)::bigint q, sum((event_type = 'click')::int)::bigint c from s group by user_id, sid)
select user_id, strftime(a, '%Y-%m-%d %H:%M') as start_time, strftime(b, '%Y-%m-%d %H:%M') as end_time, q as query_count, c as click_count from g""")
def stream_sessions(spark, d):
    s, rest = both(spark, d, "end_time - interval 1 microsecond", "1 hour", lambda e: jobs.sessions(e, "30 minutes", "1 hour"))
    return jobs.drain(s, "sessions", rest).select("user_id", _stamp("start_time"), _stamp("end_time"), "query_count", "click_count")


@query("stream_dedup", "S6 SO1", "select event_id, event_type, value from events")
def stream_dedup(spark, d):
    """Every event is delivered twice and passes once."""
    once, again = jobs.stream_table(spark, d, "events"), jobs.stream_table(spark, d, "events")
    return jobs.drain(jobs.unique_events(once.union(again), ["event_id"], "40 days"), "dedup").select("event_id", "event_type", "value")


@query("stream_alerts", "S9 S4", """
with w as (select time_bucket(interval 1 hour, ts) s, event_type, count(*) n, avg(value) m from events group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, event_type, n, case when event_type = 'error' and n > 3 then 'many_errors' else 'slow' end as alert from w
where (event_type = 'error' and n > 3) or m > 75""")
def stream_alerts(spark, d):
    errors = (F.col("event_type") == "error") & (F.col("n") > 3)

    def hits(e):
        w = jobs.windows(e, ["event_type"], "1 hour", None, "2 hours")
        return w.filter(errors | (F.col("mean") > 75)).withColumn("alert", F.when(errors, "many_errors").otherwise("slow"))

    w, rest = both(spark, d, "window_end", "2 hours", hits)
    return jobs.drain(w, "alerts", rest).select(_stamp("window_start"), "event_type", "n", "alert")


@query("stream_change_feed", "S6 SNK3", f"""
with {X.V2_SQL} select o.doc_id, o.source from documents o left join documents_v2 n using (doc_id) where n.doc_id is null or n.text <> o.text""")
def stream_change_feed(spark, d):
    stored = X.documents_v2(spark, d).select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return jobs.drain(jobs.changed(jobs.stream_table(spark, d, "documents"), stored), "changes").select("doc_id", "source")


@query("stream_last_request", "S5 W11", """
select event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_request, count(*) as requests from events group by 1""")
def stream_last_request(spark, d):
    state = jobs.stream_table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_request"), F.count(F.lit(1)).alias("requests"))
    return jobs.drain_complete(state, "last").select("event_type", _stamp("last_request", "yyyy-MM-dd HH:mm:ss"), "requests")


@query("stream_request_gap", "S5 W11", f"""
with {X.REQUESTS_SQL}, g as (select event_id, endpoint, epoch_us(ts) / 1e6 - epoch_us(lag(ts) over (partition by endpoint order by ts, event_id)) / 1e6 gap from requests)
select event_id, endpoint, round(gap, 3) as gap, case when gap < 60 then round(60 - gap, 3) else 0 end as wait from g""")
def stream_request_gap(spark, d):
    """Gap and wait of every request from state kept per endpoint."""
    shape = lambda e: e.select(F.col("event_type").alias("endpoint"), "event_id", "ts")
    events = jobs.event_table(spark, d, "events")
    whole = previous_value(shape(events), ["endpoint"], "ts", ["ts", "event_id"], F.date_trunc("day", "ts"), "before")
    passed = events.agg((F.date_trunc("millisecond", F.max("ts")) - F.expr("interval 2 hours")).alias("t")).scalar()
    rest = whole.select("endpoint", "event_id", "ts", "before").filter(F.col("ts") >= passed)  # the watermark hasn't passed these
    r = jobs.drain(pacing.previous_requests(shape(jobs.stream_table(spark, d, "events")), "endpoint", "2 hours", 3650), "pacing", rest)
    secs = lambda c: F.unix_micros(F.col(c)) / 1e6
    gap = r.withColumn("g", secs("ts") - secs("before"))
    return gap.select(
        "event_id", "endpoint", F.round("g", 3).alias("gap"), F.when(F.col("g") < 60, F.round(60 - F.col("g"), 3)).otherwise(0.0).alias("wait")
    )
