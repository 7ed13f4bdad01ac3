from pyspark.sql import functions as F

from folioscan.plans import load_all
from folioscan.streaming import jobs, pacing


def write(spark, folder, n, rows):
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double")
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(f"{folder}/part{n}")


def stream(spark, folder, per_batch=1):
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    return raw.option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_late_rows_and_bridged_session(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(1, "2024-01-01 00:00:10", 1, "view", 1.0), (2, "2024-01-01 00:20:00", 1, "view", 1.0)])
    write(spark, folder, 1, [(3, "2024-01-01 00:35:00", 1, "click", 1.0), (4, "2024-01-01 03:00:00", 2, "view", 1.0)])
    write(spark, folder, 2, [(5, "2024-01-01 06:00:00", 2, "view", 1.0)])
    write(spark, folder, 3, [(6, "2024-01-01 00:01:00", 1, "view", 1.0), (7, "2024-01-01 06:30:00", 2, "view", 1.0)])  # 6 is too late
    w = jobs.drain(jobs.windows(stream(spark, folder), [], "10 minutes", None, "1 hour"), "late")
    got = {r.s: r.n for r in w.select(F.date_format("window_start", "HH:mm").alias("s"), "n").collect()}
    assert got == {"00:00": 1, "00:20": 1, "00:30": 1, "03:00": 1}
    s = jobs.drain(jobs.sessions(stream(spark, folder), "30 minutes", "1 hour"), "sess")
    first = s.filter("user_id = 1").collect()
    assert [(r.query_count, r.click_count) for r in first] == [(2, 1)]


def test_duplicates_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    row = lambda i, m: (i, f"2024-01-01 00:{m:02d}:00", 1, "view", 1.0)
    write(spark, folder, 0, [row(1, 0), row(2, 1)])
    write(spark, folder, 1, [row(1, 0), row(3, 2)])
    out = jobs.drain(jobs.unique_events(stream(spark, folder), ["event_id"], "1 day"), "dup")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_complete_result_is_the_last_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(1, "2024-01-01 00:00:00", 1, "view", 1.0)])
    write(spark, folder, 1, [(2, "2024-01-01 01:00:00", 1, "view", 1.0)])
    out = jobs.drain_complete(stream(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "all")
    assert [tuple(r) for r in out.collect()] == [("view", 2)]


def test_gaps_do_not_depend_on_batches(spark, tmp_path):
    """Rows out of order across batches, ties, a row behind the watermark, a forgotten key."""
    folder = str(tmp_path / "in")
    row = lambda i, t, key: (i, f"2024-01-0{t}:00", 1, key, 1.0)
    parts = [
        [row(1, "1 00:10", "a"), row(2, "1 00:30", "a"), row(3, "1 00:05", "b")], [row(4, "1 00:20", "a"), row(6, "1 00:30", "a"), row(5, "1 00:30", "a")],
        [row(7, "1 09:00", "b")], [row(8, "1 00:15", "a"), row(9, "1 09:10", "a")], [row(10, "8 00:00", "c")], [row(11, "8 01:00", "b")], [row(12, "9 00:00", "c")],
    ]
    for n, rows in enumerate(parts):
        write(spark, folder, n, rows)

    def gaps(per_batch, days):
        events = stream(spark, folder, per_batch).select("event_type", "event_id", "ts")
        out = jobs.drain(pacing.previous_requests(events, "event_type", "1 hour", days), "gaps")
        return {r.event_id: (r.ts - r.before).total_seconds() / 60 if r.before else None for r in out.collect()}

    one = gaps(1, 30)
    assert one == {1: None, 4: 10, 2: 10, 5: 0, 6: 0, 3: None, 7: 535, 9: 520, 10: None, 11: 7 * 1440 - 480}
    assert gaps(100, 30) == {**one, 8: 5, 4: 5}
    assert gaps(1, 2)[11] is None


def test_gaps_continue_after_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        write(spark, folder, n, [(10 * n + i, f"2024-01-01 0{2 * n}:{i}0:00", 1, "a", 1.0) for i in range(3)] + [(10 * n + 9, f"2024-01-01 0{2 * n + 1}:59:00", 1, "z", 1.0)])
        events = stream(spark, folder).select("event_type", "event_id", "ts")
        job = pacing.previous_requests(events, "event_type", "1 minute").writeStream.format("parquet").option("path", out)
        job.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.before for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [0, 1, 2, 9, 10, 11, 12] and got[10].minute == 20 and got[0] is None


def test_sessions_that_cross_the_last_watermark_stay_whole(spark, tmp_path):
    """A session held back by the stream keeps the events whose own half hour ended before the watermark."""
    rows = [(1, 7, "2024-01-01 09:22:00", "view"), (2, 7, "2024-01-01 09:33:00", "click"), (3, 8, "2024-01-01 11:00:00", "view"), (4, 7, "2024-01-01 08:52:00", "view")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.user_id, r.start_time, r.end_time, r.query_count, r.click_count) for r in load_all()["stream_sessions"].run(spark, str(tmp_path)).collect())
    assert got == [
        (7, "2024-01-01 08:52", "2024-01-01 09:22", 1, 0), (7, "2024-01-01 09:22", "2024-01-01 10:03", 1, 1), (8, "2024-01-01 11:00", "2024-01-01 11:30", 1, 0),
    ]


def test_waiting_requests_are_packed_and_answered_in_batches(spark, tmp_path, monkeypatch):
    """All requests of a key in one batch: none is lost at the borders of the answers, and the state holds bytes."""
    assert pacing.STATE == "last long, held binary, ids binary"
    monkeypatch.setattr(pacing, "ANSWERS", 3)
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(i, f"2024-01-01 00:{59 - i % 60:02d}:00", 1, "view", 1.0) for i in range(10)] + [(99, "2024-01-02 00:00:00", 1, "other", 1.0)])
    r = jobs.drain(pacing.previous_requests(stream(spark, folder), "event_type", "1 hour"), "packed")
    got = sorted((x.ts.minute, x.before and x.before.minute) for x in r.filter("event_type = 'view'").collect())
    assert got == [(50 + i, 49 + i if i else None) for i in range(10)]
