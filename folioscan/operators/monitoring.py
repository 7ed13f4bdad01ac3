"""Request, search and click monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.ranks import order_statistics


def newest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n newest rows per key as column recency; each partition passes on at most n rows per key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def request_summary(requests: DataFrame, hours: int) -> DataFrame:
    total, errors = F.count(F.lit(1)), F.count_if(F.col("status_code") >= 400)
    return requests.agg(
        total.alias("total"), errors.alias("errors"), F.round(_ratio(errors, total), 10).alias("error_rate"),
        F.round(F.coalesce(F.avg("response_time"), F.lit(0.0)), 10).alias("avg_response_time"),
        F.round(total / hours, 10).alias("requests_per_hour"),
    )


def endpoint_stats(requests: DataFrame, history: int = 1000, least: int = 20) -> DataFrame:
    """Totals over all rows, mean and p95 over each endpoint's newest `history` samples.

    p95 is the sample at sorted position int(n * 0.95); up to `least` samples it is the mean.
    """
    totals = requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("status_code") >= 400).alias("error_count")
    )
    recent = newest(requests, ["endpoint"], history)
    sorted_times = F.sort_array(F.collect_list("response_time"))  # at most `history` values
    n = F.count(F.lit(1))
    stats = recent.groupBy("endpoint").agg(
        F.avg("response_time").alias("mean"), n.alias("n"), F.get(sorted_times, F.floor(n * 0.95).cast("int")).alias("at95")
    )
    p95 = F.when(F.col("n") > least, F.col("at95")).otherwise(F.col("mean"))
    return totals.join(stats, "endpoint").select(
        "endpoint", "total_requests", "error_count", F.round(F.col("error_count") / F.col("total_requests"), 10).alias("error_rate"),
        F.round("mean", 10).alias("avg_response_time"), F.round(p95, 10).alias("p95_response_time"),
    )


def latency_stats(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, extremes, index-based median, p95, p99, rate and success share of successful requests."""
    ok = requests.filter("status_code < 400")
    n = F.col("n")
    at = order_statistics(
        ok, keys, "response_time",
        {"median": F.floor(n / 2), "p95": F.floor(n * 0.95), "p99": F.floor(n * 0.99)},
    )
    t = F.col("response_time")
    good = F.col("status_code") < 400
    base = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("successful"),
        F.avg(F.when(good, t)).alias("mean"), F.min(F.when(good, t)).alias("min"), F.max(F.when(good, t)).alias("max"),
        F.sum(F.when(good, t)).alias("spent"),
    )
    r = lambda c: F.round(c, 10).alias(c)
    return base.join(at, keys).select(
        *keys, "total", "successful", r("mean"), r("min"), r("max"), r("median"), r("p95"), r("p99"),
        F.round(F.col("successful") / F.col("total"), 10).alias("success_rate"),
        F.round(F.col("successful") / F.col("spent"), 10).alias("per_second"),
    )


def windowed(rows: DataFrame, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding window statistics by event time."""
    return rows.groupBy(F.window("ts", width, slide), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 10).alias("total"), F.round(F.avg("value"), 10).alias("mean")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total", "mean")


def rate_breaches(rows: DataFrame, key: str, width: str, limit: int) -> DataFrame:
    """(key, window_start, n) of windows with more calls than the limit."""
    counts = rows.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select(key, F.col("window.start").alias("window_start"), "n")


#: Size of a quantile sketch: ranks are off by about 0.7 % of n with 99 % confidence; up to SKETCH_SIZE values it is exact.
SKETCH_SIZE = 400


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, step: str, ts: str = "ts") -> DataFrame:
    """keys, step_start, n and a mergeable sketch of `value` per step: one scan, folded map-side, usable in a stream."""
    cells = rows.filter(F.col(value).isNotNull()).groupBy(F.window(ts, step), *keys)
    return cells.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_SIZE).alias("sketch")).select(
        *keys, F.col("window.start").alias("step_start"), "n", "sketch"
    )


def sliding_quantiles(sketches: DataFrame, keys: list[str], width: str, slide: str, fractions: dict[str, float]) -> DataFrame:
    """Quantiles of sliding windows from the sketches of their steps; no value is read again.

    `slide` and `width` are multiples of the sketches' step. A window's quantile is the smallest value whose rank reaches
    the fraction of n, within the sketch's rank error.
    """
    merged = sketches.groupBy(F.window("step_start", width, slide), *keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("_s"))
    found = [F.kll_sketch_get_quantile_double("_s", F.lit(f)).alias(name) for name, f in fractions.items()]
    return merged.select(F.col("window.start").alias("window_start"), *keys, "n", *found)


def sustained(windows: DataFrame, key: str, breached: Column, seconds: int, consecutive: int) -> DataFrame:
    """Alert rows: windows that end a run of at least `consecutive` adjacent breached windows.

    Breached windows are few; a run is recognised by its start time minus its position.
    """
    hit = windows.filter(breached).withColumn("_s", F.unix_micros(F.col("window_start").cast("timestamp")) / 1000000)
    order = Window.partitionBy(key).orderBy("_s")
    run = hit.withColumn("_run", F.col("_s") - F.row_number().over(order) * seconds)
    nth = F.row_number().over(Window.partitionBy(key, "_run").orderBy("_s"))
    return run.withColumn("streak", nth).filter(F.col("streak") >= consecutive).drop("_s", "_run")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Search sessions per user: start, end, counts of queries and clicks."""
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("query_count"), F.count_if(F.col("event_type") == "click").alias("click_count")
    ).select("user_id", F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), "query_count", "click_count")


# fixed values: name, allowed requests, window
RATE_LIMITS = (("strict", 10, "1 minute"), ("moderate", 100, "1 minute"), ("generous", 300, "1 minute"), ("burst", 1000, "1 hour"))


def rate_limit_report(rows: DataFrame, key: str) -> DataFrame:
    """Per limit: allowed requests, the fullest window of any key, and how many windows broke it."""
    out = None
    for width in dict.fromkeys(w for _, _, w in RATE_LIMITS):
        n = rows.groupBy(key, F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
        limits = [(name, allowed) for name, allowed, w in RATE_LIMITS if w == width]
        counted = n.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"), *[F.count_if(F.col("n") > a).alias(name) for name, a in limits])
        each = counted.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(a).alias("allowed"), F.lit(width).alias("width"), F.col("peak"), F.col(name).alias("breaches")) for name, a in limits
        ])))
        out = each if out is None else out.unionByName(each)
    return out


STEP_MINUTES = 5
# fixed values: alert, severity, minutes that the condition must have held
ALERT_RULES = (("p95_high", "warning", 10), ("no_traffic", "info", 15), ("stalled", "warning", 30), ("error_spike", "critical", 10))
P95_LIMIT, ERROR_LIMIT = 0.75, 10


def alert_steps(requests: DataFrame, quantile: DataFrame) -> DataFrame:
    """One row per step of STEP_MINUTES from the first request to the last, with every rule's condition.

    requests(ts, kind: 'page', 'error' or 'crawl'); quantile(step, quantile) is the step's 95th percentile. Steps without
    a request are made from the time range, so absence can be seen. There is one row per step, however many requests.
    """
    stamp = F.window("ts", f"{STEP_MINUTES} minutes")["start"]
    kinds = ("page", "error", "crawl")
    seen = requests.groupBy(stamp.alias("step")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    span = seen.agg(F.min("step").alias("a"), F.max("step").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {STEP_MINUTES} minutes"))).alias("step"))
    full = grid.join(seen, "step", "left").join(quantile, "step", "left").fillna(0, ["n", *kinds])
    order = Window.orderBy("step")
    last = lambda c, minutes: F.sum(c).over(order.rowsBetween(1 - minutes // STEP_MINUTES, 0))
    return full.select(
        "step", (F.coalesce("quantile", F.lit(0.0)) > P95_LIMIT).alias("p95_high"), (last("n", 15) == 0).alias("no_traffic"),
        ((last("crawl", 30) > 0) & (last("page", 30) == 0)).alias("stalled"), (last("error", 10) > ERROR_LIMIT).alias("error_spike"),
    )


def firing(steps: DataFrame) -> DataFrame:
    """Per rule: alert, severity, steps at which it fires, and the first of them."""
    order = Window.orderBy("step")
    out = None
    for name, severity, minutes in ALERT_RULES:
        breaks = steps.select("step", name, F.sum((~F.col(name)).cast("int")).over(order).alias("run"))
        held = F.sum(F.col(name).cast("int")).over(Window.partitionBy("run").orderBy("step"))
        on = breaks.withColumn("held", held).filter(F.col(name) & (F.col("held") > minutes // STEP_MINUTES))
        one = on.agg(F.count(F.lit(1)).alias("firing"), F.min("step").alias("first")).select(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "firing", "first")
        out = one if out is None else out.unionByName(one)
    return out
