"""Streams over several batches against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assetlake.operators import windows as W
from assetlake.operators.skew import row_blocks
from assetlake.session import scratch_path
from assetlake.sources import readers as S
from assetlake.streaming import heartbeats as B
from assetlake.streaming import intake as I
from assetlake.streaming import thermal as H
from assetlake.streaming.run import drain_append, drain_updates, read_table_stream


@pytest.fixture(scope="module")
def beats_dir(spark):
    """Beats of twelve tasks in time order over five files, with long gaps."""
    r, rows, t = random.Random(5), [], 0
    for i in range(1500):
        t += r.choice([2, 5, 9])
        k = r.randrange(12)
        if not (k == 3 and 2000 < t < 4000) and not (k == 7 and t > 5000):
            rows.append((i, f"T{k}", t, float(40 + r.randrange(30))))
    out = scratch_path(spark, "beats-in")
    df = spark.createDataFrame(rows, "event_id long, task_id string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    step = rows[-1][2] // 5 + 1
    for b in range(5):
        df.filter(F.floor(F.col("s") / step) == b).coalesce(1).write.mode("append").parquet(out)
    return out


def one_by_one(spark, path):
    return read_table_stream(spark, path, max_files=1)


def test_stale_events(spark, beats_dir):
    src = one_by_one(spark, beats_dir).select("task_id", "ts")
    got = sorted((r.task_id, r.last_heartbeat) for r in drain_append(B.stale_events(src), "stale").collect())
    want = sorted((r.task_id, r.last_heartbeat) for r in B.stale_events_batch(spark.read.parquet(beats_dir)).collect())
    assert got == want and any(k == "T3" for k, _ in got) and any(k == "T7" for k, _ in got)


def test_thermal_events(spark, beats_dir):
    cols = [F.col("event_id"), F.col("task_id").alias("drive"), F.col("ts"), F.col("v").alias("temperature")]
    got = sorted(tuple(r) for r in H.thermal_events_stream(one_by_one(spark, beats_dir).select(*cols), block_rows=50).select("drive", "event_id", "event").collect())
    want = sorted(tuple(r) for r in W.thermal_events(spark.read.parquet(beats_dir).select(*cols)).select("drive", "event_id", "event").collect())
    assert got == want and len(want) > 100


def test_history(spark, beats_dir):
    cols = [F.col("event_id"), F.col("task_id").alias("drive"), F.col("ts"), F.col("v").alias("temperature")]
    out = H.history_stream(one_by_one(spark, beats_dir).select(*cols), 30)
    got = {r.drive: (r.readings, r.min_temperature, r.max_temperature) for r in W.latest_per_key(out, ["drive"], ["batch_id"]).collect()}
    last = W.last_n(spark.read.parquet(beats_dir).select(*cols), "drive", ["ts", "event_id"], 30)
    want = {r.drive: (r.n, r.a, r.b) for r in last.groupBy("drive").agg(
        F.count("*").alias("n"), F.min("temperature").alias("a"), F.max("temperature").alias("b")).collect()}
    assert got == want


def test_latest_beats(spark, beats_dir):
    out = drain_updates(B.latest_beats(one_by_one(spark, beats_dir).select("task_id", "ts", "event_id")), "latest")
    got = {r.task_id: r.event_id for r in W.latest_per_key(out, ["task_id"], ["batch_id"]).collect()}
    want = {r.task_id: r.event_id for r in B.latest_beats(spark.read.parquet(beats_dir).select("task_id", "ts", "event_id")).collect()}
    assert got == want


def test_file_intake(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"one")
    (folder / "b.txt").write_bytes(b"no")
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    I.start_intake(S.watch_folder(spark, str(folder)), table, mark).awaitTermination()
    (folder / "c.mp4").write_bytes(b"two")
    I.start_intake(S.watch_folder(spark, str(folder)), table, mark).awaitTermination()
    got = {r.path.rsplit("/", 1)[-1]: (r.file_type, r.size_bytes) for r in I.current_inventory(spark.read.parquet(table)).collect()}
    assert got == {"a.jpg": ("IMAGE", 3), "c.mp4": ("VIDEO", 3)}


def test_sessions_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("T", t0 + dt.timedelta(seconds=s), 1.0) for s in (0, 30, 60, 1000, 1030)]
    df = spark.createDataFrame(rows, "task_id string, ts timestamp, progress_pct double")
    assert sorted(r.beats for r in B.progress_sessions_batch(df).collect()) == [2, 3]


def _plain_events(rows):
    """Pause and resume by one walk over (drive, ts, id, temperature) in order."""
    paused, out = {}, []
    for drive, ts, k, temp in sorted(rows, key=lambda r: (r[1], r[2])):
        if temp >= 55 and not paused.get(drive):
            paused[drive] = True
            out.append((drive, k, "THERMAL_PAUSE"))
        elif temp <= 45 and paused.get(drive):
            paused[drive] = False
            out.append((drive, k, "THERMAL_RESUME"))
    return sorted(out)


def _one_hot_hour(spark, n=6000):
    """A third of all readings are of one drive in one hour."""
    r = random.Random(11)
    rows = [(0, 7_200_000 + r.randrange(3_600_000), k, float(r.choice([40, 45, 50, 54, 55, 60]))) for k in range(n // 3)]
    rows += [(1 + r.randrange(40), r.randrange(86_400_000), k, float(r.choice([40, 50, 60]))) for k in range(n // 3, n)]
    df = spark.createDataFrame(rows, "drive long, ms long, event_id long, temperature double")
    return rows, df.select("drive", F.timestamp_millis("ms").alias("ts"), "event_id", "temperature")


def test_thermal_scan_of_one_hot_hour(spark):
    rows, df = _one_hot_hour(spark)
    got = sorted((r.drive, r.event_id, r.event) for r in W.thermal_events(df, block_rows=300).collect())
    assert got == _plain_events(rows)
    blocks = row_blocks(W.signals(df), ["drive"], ["ts", "event_id"], block_rows=300)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    of_hot = blocks.filter("drive = 0").select("_block").distinct().count()
    assert max(sizes) <= 2 * 300 and of_hot >= 4


def test_thermal_stream_goes_on_after_a_stop(spark, tmp_path):
    rows, df = _one_hot_hour(spark, 900)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for day in range(3):
        df.filter(F.floor(F.hour("ts") / 8) == day).coalesce(1).write.mode("append").parquet(path)
        seen = [(r.drive, r.event_id, r.event) for r in H.thermal_events_stream(read_table_stream(spark, path), out=out, block_rows=100).collect()]
    assert sorted(seen) == _plain_events(rows)


def test_a_gap_of_just_the_limit_is_no_silence(spark, tmp_path):
    ms = {"a": [0, 300_000, 600_001, 900_002], "b": [0, 300_001], "c": [0], "d": [9_000_000]}
    df = spark.createDataFrame([(k, t) for k, times in ms.items() for t in times], "task_id string, ms long").select(
        "task_id", F.timestamp_millis("ms").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    key = lambda rows: sorted((r.task_id, r.last_heartbeat.timestamp(), r.failed_at.timestamp()) for r in rows)
    got = key(drain_append(B.stale_events(read_table_stream(spark, str(tmp_path / "in"))), "stale").collect())
    assert got == key(B.stale_events_batch(df).collect())
    assert [(k, t) for k, t, _ in got] == [("a", 300.0), ("a", 600.001), ("a", 900.002), ("b", 0.0), ("b", 300.001), ("c", 0.0)]


def test_sessions_closed_and_open_are_all_sessions(spark, beats_dir):
    src = one_by_one(spark, beats_dir).select("task_id", "ts", F.col("v").alias("progress_pct"))
    path = scratch_path(spark, "sessions")
    closed = drain_append(B.progress_sessions(src, "3 minutes"), "sessions", path)
    opened = B.open_sessions(spark, f"{path}/checkpoint")
    table = spark.read.parquet(beats_dir).select("task_id", "ts", F.col("v").alias("progress_pct"))
    for block_rows in (10**6, 40):
        want = B.progress_sessions_batch(table, "3 minutes", block_rows)
        assert sorted(closed.unionByName(opened).collect()) == sorted(want.collect())
    plain = table.groupBy("task_id", F.session_window("ts", "3 minutes").alias("s")).agg(F.count("*").alias("beats"), F.max("progress_pct"))
    assert sorted(plain.select("task_id", "s.start", "s.end", "beats", F.col("max(progress_pct)")).collect()) == sorted(want.collect())
    assert closed.count() and opened.count()


def test_history_of_one_hot_drive(spark):
    rows, df = _one_hot_hour(spark, 3000)
    for salts in (1, 7):
        got = sorted(r.event_id for r in W.last_n_salted(df, "drive", ["ts", "event_id"], 25, salts).filter("drive = 0").collect())
        assert got == sorted(k for _, _, k, _ in sorted((r for r in rows if r[0] == 0), key=lambda r: r[1:3])[-25:])


def test_streams_use_no_python_workers(spark, beats_dir):
    table = spark.read.parquet(beats_dir).select("event_id", F.col("task_id").alias("drive"), "ts", F.col("v").alias("temperature"))
    for df in (W.thermal_events(table), W.last_n_salted(table, "drive", ["ts", "event_id"], 5)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
