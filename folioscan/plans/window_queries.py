"""Registered queries: ordered and windowed operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators import monitoring
from folioscan.operators.ranks import previous_value
from folioscan.plans import fixtures as X
from folioscan.plans.registry import query


@query("last_n_per_endpoint", "W5 W6 T6", f"""
with {X.REQUESTS_SQL} select event_id, endpoint, row_number() over (partition by endpoint order by ts desc, event_id desc) as recency from requests qualify recency <= 1000""")
def last_n_per_endpoint(spark, d):
    return monitoring.newest(X.requests(spark, d), ["endpoint"], 1000).select("event_id", "endpoint", "recency")


@query("recent_history", "W6 T5", f"""
with {X.CLICKS_SQL} select event_id, query, chunk_id from clicks order by ts desc, event_id limit 1000""")
def recent_history(spark, d):
    return X.clicks(spark, d).orderBy(F.desc("ts"), "event_id").limit(1000).select("event_id", "query", "chunk_id")


@query("domain_request_gap", "W11 S5", f"""
with {X.REQUESTS_SQL}, g as (select event_id, endpoint, epoch_us(ts) / 1e6 - epoch_us(lag(ts) over (partition by endpoint order by ts, event_id)) / 1e6 gap from requests)
select event_id, endpoint, round(gap, 3) as gap, case when gap < 60 then round(60 - gap, 3) else 0 end as wait from g""")
def domain_request_gap(spark, d):
    """Seconds since the previous request of the endpoint and the wait that keeps one request a minute."""
    r = previous_value(X.requests(spark, d), ["endpoint"], "ts", ["ts", "event_id"], F.date_trunc("day", "ts"), "before")
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    gap = r.withColumn("g", secs("ts") - secs("before"))
    return gap.select(
        "event_id", "endpoint", F.round("g", 3).alias("gap"), F.when(F.col("g") < 60, F.round(60 - F.col("g"), 3)).otherwise(0.0).alias("wait")
    )


@query("running_clicks", "W4", f"""
with {X.CLICKS_SQL} select event_id, query, count(*) over (partition by query, date_trunc('day', ts) order by ts, event_id) as clicks_so_far from clicks""")
def running_clicks(spark, d):
    w = Window.partitionBy("query", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return X.clicks(spark, d).select("event_id", "query", F.count(F.lit(1)).over(w).alias("clicks_so_far"))
