"""Mergeable quantile sketches against exact order statistics."""

import numpy as np
from pyspark.sql import functions as F

from folioscan.operators import monitoring
from folioscan.streaming import jobs


def test_rank_error_of_merged_sketches(spark):
    """60,000 skewed values in 60 minutes, one of them an outlier, merged to sliding windows of 20 minutes."""
    rows = spark.range(60_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3600).alias("ts"), F.lit("a").alias("endpoint"),
        F.when(F.col("id") == 7, 1e9).otherwise(F.pow(F.rand(3), 4)).alias("value"),
    ).cache()
    steps = monitoring.quantile_sketches(rows, ["endpoint"], "value", "1 minute")
    got = monitoring.sliding_quantiles(steps, ["endpoint"], "20 minutes", "10 minutes", {"p50": 0.5, "p99": 0.99}).collect()
    exact = {r.s: np.sort(r.v) for r in rows.groupBy(F.window("ts", "20 minutes", "10 minutes")["start"].alias("s")).agg(F.collect_list("value").alias("v")).collect()}
    worst = 0.0
    for r in got:
        v = exact[r.window_start]
        assert r.n == len(v)
        worst = max(worst, *(abs(np.searchsorted(v, r[name], "right") / len(v) - f) for name, f in (("p50", 0.5), ("p99", 0.99))))
    print(f"largest rank error {worst:.4f}")
    assert len(got) == 7 and worst < 0.02


def test_sketches_from_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:00:00", "a", float(v)) for h in range(4) for v in range(10)], "t string, endpoint string, value double")
    rows.select(F.col("t").cast("timestamp").alias("ts"), "endpoint", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, endpoint string, value double").parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    steps = jobs.drain(monitoring.quantile_sketches(stream, ["endpoint"], "value", "1 hour"), "sketches")
    got = monitoring.sliding_quantiles(steps, ["endpoint"], "1 hour", "1 hour", {"p50": 0.5}).collect()
    assert sorted((r.n, r.p50) for r in got) == [(10, 4.0)] * 2  # the watermark has not passed the later hours
