"""Registered queries: monitoring statistics over the whole request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions.ids import client_key
from folioscan.operators import aggregates, filters, monitoring
from folioscan.plans import fixtures as X
from folioscan.plans.registry import query
from folioscan.session import as_of, load

BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]  # fixed values: seconds


@query("request_summary", "AGG13 Z17 M8", f"""
with {X.REQUESTS_SQL}, r as (select * from requests where ts >= (select max(ts) from requests) - interval 24 hour)
select count(*) as total, sum((status_code >= 400)::int)::bigint as errors, round(sum((status_code >= 400)::int) / count(*), 10) as error_rate,
 round(avg(response_time), 10) as avg_response_time, round(count(*) / 24, 10) as requests_per_hour from r""")
def request_summary(spark, d):
    r = X.requests(spark, d)
    return monitoring.request_summary(filters.within(r, "ts", as_of(r), hours=24), 24)


@query("endpoint_stats_p95_index", "AGG14 W5", f"""
with {X.REQUESTS_SQL}, t as (select endpoint, count(*) n, sum((status_code >= 400)::int)::bigint e from requests group by 1),
l as (select endpoint, response_time from requests qualify row_number() over (partition by endpoint order by ts desc, event_id desc) <= 1000),
s as (select endpoint, avg(response_time) m, list_sort(list(response_time)) v, count(*) k from l group by 1)
select endpoint, n as total_requests, e as error_count, round(e / n, 10) as error_rate, round(m, 10) as avg_response_time,
 round(case when k > 20 then v[1 + cast(floor(k * 0.95) as int)] else m end, 10) as p95_response_time from t join s using (endpoint)""")
def endpoint_stats_p95_index(spark, d):
    return monitoring.endpoint_stats(X.requests(spark, d))


@query("latency_percentiles", "AGG15 E11", f"""
with {X.REQUESTS_SQL}, g as (select endpoint, count(*) total from requests group by 1),
s as (select endpoint, count(*) n, avg(response_time) mean, min(response_time) mn, max(response_time) mx, sum(response_time) sp, list_sort(list(response_time)) v from requests where status_code < 400 group by 1)
select endpoint, total, n as successful, round(mean, 10) as mean, round(mn, 10) as min, round(mx, 10) as max, round(v[1 + n // 2], 10) as median, round(v[1 + cast(floor(n * 0.95) as int)], 10) as p95,
 round(v[1 + cast(floor(n * 0.99) as int)], 10) as p99, round(n / total, 10) as success_rate, round(n / sp, 10) as per_second from g join s using (endpoint)""")
def latency_percentiles(spark, d):
    return monitoring.latency_stats(X.requests(spark, d), ["endpoint"])


@query("user_latency_percentiles", "AGG15 AGG16", f"""
with {X.REQUESTS_SQL}, s as (select user_id, count(*) n, list_sort(list(response_time)) v from requests where status_code < 400 group by 1)
select user_id, n as successful, round(v[1 + n // 2], 10) as median, round(v[1 + cast(floor(n * 0.95) as int)], 10) as p95 from s""")
def user_latency_percentiles(spark, d):
    return monitoring.latency_stats(X.requests(spark, d), ["user_id"]).select("user_id", "successful", "median", "p95")


@query("sliding_latency_quantiles", "S1 AGG15", f"""
with {X.REQUESTS_SQL}, w as (select endpoint, response_time, unnest(range(time_bucket(interval 6 hour, ts) - interval 18 hour, time_bucket(interval 6 hour, ts) + interval 1 minute, interval 6 hour)) s from requests),
l as (select endpoint, s, count(*) n, list_sort(list(response_time)) v from w group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, endpoint, n, round(v[greatest(1, cast(ceil(n * 0.5) as bigint))], 10) as median, round(v[greatest(1, cast(ceil(n * 0.95) as bigint))], 10) as p95 from l""")
def sliding_latency_quantiles(spark, d):
    """Quantiles of a day, every six hours, merged from hourly sketches."""
    hourly = monitoring.quantile_sketches(X.requests(spark, d), ["endpoint"], "response_time", "1 hour")
    w = monitoring.sliding_quantiles(hourly, ["endpoint"], "24 hours", "6 hours", {"median": 0.5, "p95": 0.95})
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "endpoint", "n", F.round("median", 10).alias("median"), F.round("p95", 10).alias("p95"))


@query("metric_windows", "AGG17 Z20 S1", """
select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 10) as total, round(avg(value), 10) as mean from events group by 1, 2""")
def metric_windows(spark, d):
    w = monitoring.windowed(load(spark, d, "events"), ["event_type"], "5 minutes")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total", "mean")


@query("sliding_error_rate", "AGG17 M8 S1", """
with w as (select unnest(range(time_bucket(interval 5 minute, ts) - interval 10 minute, time_bucket(interval 5 minute, ts) + interval 1 minute, interval 5 minute)) s, event_type from events)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, count(*) as n, round(sum((event_type = 'error')::int) / greatest(1, count(*)), 10) as error_rate from w group by 1""")
def sliding_error_rate(spark, d):
    g = load(spark, d, "events").groupBy(F.window("ts", "15 minutes", "5 minutes")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")
    )
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round(F.col("e") / F.greatest(F.lit(1), F.col("n")), 10).alias("error_rate"))


@query("kind_distributions", "AGG18 Z19", """
select event_type, case when event_type = 'error' then 500 else 200 end as status, count(*) as n, count(distinct user_id) as users from events group by 1, 2""")
def kind_distributions(spark, d):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return load(spark, d, "events").groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("hit_rate", "AGG19 Z17 C8", f"""
with p as (select user_id, {X.PROP_K} k, row_number() over (partition by user_id, {X.PROP_K} order by ts, event_id) nth from events)
select user_id, sum((nth > 1)::int)::bigint as hits, sum((nth = 1)::int)::bigint as misses, round(sum((nth > 1)::int) / count(*), 10) as hit_rate from p group by 1""")
def hit_rate(spark, d):
    """With an unbounded cache the first request of a key misses and the others hit."""
    k = F.get_json_object("props", "$.k")
    keys = load(spark, d, "events").groupBy("user_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    misses = F.count(F.lit(1))
    return keys.groupBy("user_id").agg((total - misses).alias("hits"), misses.alias("misses"), F.round((total - misses) / total, 10).alias("hit_rate"))


@query("histogram_buckets", "AGG20 SNK12 Z21", f"""
with {X.REQUESTS_SQL}, b as (select unnest([{', '.join(map(str, BOUNDS))}, 'inf'::double]) le)
select endpoint, case when isinf(le) then '+Inf' else regexp_replace(cast(le as varchar), '\\.0$', '') end as le, sum((response_time <= le)::int)::bigint as n from requests cross join b group by 1, 2""")
def histogram_buckets(spark, d):
    return aggregates.cumulative_buckets(X.requests(spark, d), ["endpoint"], "response_time", BOUNDS)


_CUM = ", ".join(f"sum((response_time <= {b})::int) c{i}" for i, b in enumerate(BOUNDS))
_EDGE = [0.0, *BOUNDS]
_PICK = " ".join(
    f"when c{i} >= n * 0.95 then {_EDGE[i]} + ({b} - {_EDGE[i]}) * (n * 0.95 - {f'c{i - 1}' if i else '0'}) / (c{i} - {f'c{i - 1}' if i else '0'})" for i, b in enumerate(BOUNDS)
)


@query("histogram_quantile", "AGG30", f"""
with {X.REQUESTS_SQL}, c as (select endpoint, count(*) n, {_CUM} from requests group by 1)
select endpoint, n, round(case {_PICK} else {BOUNDS[-1]} end, 6) as quantile from c""")
def histogram_quantile(spark, d):
    q = aggregates.histogram_quantile(X.requests(spark, d), ["endpoint"], "response_time", BOUNDS, 0.95)
    return q.withColumn("quantile", F.round("quantile", 6))


@query("counter_increase", "AGG30", """
with h as (select date_trunc('hour', ts) hr, count(*) n from events group by 1), c as (select hr, sum(n) over (order by hr) total from h)
select strftime(hr, '%Y-%m-%d %H') as hour, total::bigint as total,
 (select sum(n) from h where h.hr > c.hr - interval 6 hour and h.hr <= c.hr)::bigint as increase_6 from c""")
def counter_increase(spark, d):
    """Running event counter per hour and its increase over the last six hours, also where hours have no event."""
    from pyspark.sql import Window

    hours = load(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("hr")  # one row per hour
    last = Window.orderBy(F.unix_seconds(F.col("hr").cast("timestamp"))).rangeBetween(-5 * 3600, 0)
    total = hours.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return total.select(F.date_format("hr", "yyyy-MM-dd HH").alias("hour"), "total", F.sum("n").over(last).alias("increase_6"))


@query("rate_limit_breaches", "P9 S4 Z25", """
with k as (select 'user:' || user_id || ':10.0.0.' || user_id % 256 key, ts from events)
select key, 'day' as period, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as window_start, count(*) as n from k group by 1, 3 having count(*) > 4
union all select key, 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M'), count(*) from k group by 1, 3 having count(*) > 1""")
def rate_limit_breaches(spark, d):
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    rows = load(spark, d, "events").select(client_key(F.col("user_id"), ip).alias("key"), "ts")
    out = None
    for period, width, limit in (("day", "1 day", 4), ("hour", "1 hour", 1)):
        b = monitoring.rate_breaches(rows, "key", width, limit).select(
            "key", F.lit(period).alias("period"), F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n"
        )
        out = b if out is None else out.unionByName(b)
    return out


@query("search_sessions", "S3", """
with o as (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events),
s as (select *, sum(case when p is null or ts >= p + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) sid from o)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_time, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as end_time,
 sum((event_type = 'view')::int)::bigint as query_count, sum((event_type = 'click')::int)::bigint as click_count from s group by user_id, sid""")
def search_sessions(spark, d):
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = monitoring.sessions(ev)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", shown("start_time"), shown("end_time"), "query_count", "click_count")


@query("sustained_alerts", "S9 E15", """
with w as (select event_type, time_bucket(interval 1 hour, ts) s, count(*) n from events group by 1, 2), h as (select * from w where n >= 3),
g as (select *, epoch(s) - 3600 * row_number() over (partition by event_type order by s) run from h),
k as (select *, row_number() over (partition by event_type, run order by s) streak from g)
select event_type, strftime(s, '%Y-%m-%d %H:%M') as window_start, n, streak from k where streak >= 3""")
def sustained_alerts(spark, d):
    w = load(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = w.select("event_type", F.col("window.start").alias("window_start"), "n")
    a = monitoring.sustained(w, "event_type", F.col("n") >= 3, 3600, 3)
    return a.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", "streak")


@query("component_health", "Z28", f"""
with {X.REQUESTS_SQL}, c as (select endpoint, avg((status_code >= 400)::int) e from requests group by 1)
select case when bool_or(e > 0.5) then 'degraded' else 'healthy' end as status, sum((e > 0.5)::int)::bigint as unhealthy, count(*) as components from c""")
def component_health(spark, d):
    e = X.requests(spark, d).groupBy("endpoint").agg(F.avg((F.col("status_code") >= 400).cast("int")).alias("e"))
    return e.agg(
        F.when(F.bool_or(F.col("e") > 0.5), "degraded").otherwise("healthy").alias("status"),
        F.count_if(F.col("e") > 0.5).alias("unhealthy"), F.count(F.lit(1)).alias("components"),
    )


@query("rate_limits", "P9 Z25", """
with m as (select user_id k, date_trunc('minute', ts) w, count(*) n from events group by 1, 2),
h as (select user_id k, date_trunc('hour', ts) w, count(*) n from events group by 1, 2),
l(name, allowed, width) as (values ('strict', 10, '1 minute'), ('moderate', 100, '1 minute'), ('generous', 300, '1 minute'), ('burst', 1000, '1 hour'))
select name, allowed, width, case width when '1 minute' then (select max(n) from m) else (select max(n) from h) end as peak,
 case width when '1 minute' then (select count(*) from m where n > allowed) else (select count(*) from h where n > allowed) end as breaches from l""")
def rate_limits(spark, d):
    return monitoring.rate_limit_report(load(spark, d, "events").select("user_id", "ts"), "user_id")


@query("alert_rules", "S9 AGG30", f"""
with {X.REQUESTS_SQL}, b as (select time_bucket(interval 5 minute, ts) step, * from requests),
c as (select step, count(*) n, {_CUM} from b group by 1), q as (select step, case {_PICK} else {BOUNDS[-1]} end q from c),
k as (select step, count(*) n, count_if(endpoint = 'view') page, count_if(status_code >= 400) error, count_if(endpoint = 'click') crawl from b group by 1),
g as (select unnest(range(min(step), max(step) + interval 1 minute, interval 5 minute)) step from b),
f as (select step, coalesce(n, 0) n, coalesce(page, 0) page, coalesce(error, 0) error, coalesce(crawl, 0) crawl, coalesce(q, 0) q from g left join k using (step) left join q using (step)),
s as (select step, q > 0.75 as p95_high, sum(n) over (order by step rows 2 preceding) = 0 as no_traffic,
  sum(crawl) over (order by step rows 5 preceding) > 0 and sum(page) over (order by step rows 5 preceding) = 0 as stalled,
  sum(error) over (order by step rows 1 preceding) > 10 as error_spike from f),
r as (select 'p95_high' alert, 'warning' severity, 10 mins, step, p95_high c from s union all select 'no_traffic', 'info', 15, step, no_traffic from s
  union all select 'stalled', 'warning', 30, step, stalled from s union all select 'error_spike', 'critical', 10, step, error_spike from s),
u as (select *, sum((not c)::int) over (partition by alert order by step) run from r),
v as (select *, sum(c::int) over (partition by alert, run order by step) held from u)
select alert, severity, count_if(c and held > mins // 5)::bigint as firing, strftime(min(step) filter (c and held > mins // 5), '%Y-%m-%d %H:%M') as first_firing from v group by 1, 2""")
def alert_rules(spark, d):
    """The four rules over all requests; a click stands for an active crawl, a view for a crawled page."""
    r = X.requests(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.window("ts", "5 minutes")["start"]
    p95 = aggregates.histogram_quantile(r.withColumn("step", step), ["step"], "response_time", BOUNDS, 0.95).select("step", "quantile")
    kind = F.when(F.col("status_code") >= 400, "error").when(F.col("endpoint") == "view", "page").when(F.col("endpoint") == "click", "crawl").otherwise("other")
    fires = monitoring.firing(monitoring.alert_steps(r.select("ts", kind.alias("kind")), p95))
    return fires.select("alert", "severity", "firing", F.date_format("first", "yyyy-MM-dd HH:mm").alias("first_firing"))
