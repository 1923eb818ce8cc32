"""Streaming operators give the batch results on the same log."""

import json
import os

import pytest
from pyspark.sql import functions as F

from logs import Log, frame
from spanforge.operators import gpu, live, sequences
from spanforge.sinks.files import event_json
from spanforge.streaming import feeds, stateful

S = 10**9


@pytest.fixture(scope="module")
def log(spark):
    a, b = Log("a"), Log("b")
    for i in range(6):
        t = i * 2 * S
        a.sched(t, i % 2).commit(t + 1, i % 2, depth=i).done(t + S, i % 2, error=3 if i == 4 else None)
        a.ops(t + S + 1, i % 2, ("p", "gemm", 700_000_000 + i * 10**8, 1), ("q", None, 600_000_000, 2))
        a.add("Mark", t + S + 2, label=f"m{i}")
    a.commit(13 * S, 7)
    for r in a.rows[10:]:
        r["seq"] += 3  # a hole in the sequence
    b.commit(1, 1).add("Mark", 30 * S, label="late")
    z = Log("z").add("Mark", 100 * S, label="tick")  # moves the watermark past all timers
    return frame(spark, a, b, z).cache()


@pytest.fixture(scope="module")
def feed_dir(spark, log, tmp_path_factory):
    """The log as NDJSON in three files, in order."""
    root = tmp_path_factory.mktemp("feed")
    docs = [json.loads(r["json"]) for r in event_json(log).orderBy(F.col("session_key"), "event_ord").collect()]
    a = [d for d in docs if d["session_key"] == "a"]
    b, z = ([d for d in docs if d["session_key"] == k] for k in "bz")
    for i, part in enumerate((a[:11], a[11:], b, z)):
        (root / "x").mkdir(exist_ok=True)
        path = root / "x" / f"{i}.json"
        path.write_text("\n".join(map(json.dumps, part)) + "\n")
        os.utime(path, (10**9 + i * 10, 10**9 + i * 10))  # the file source reads oldest first
    return str(root)


def run(spark, df, name, tmp_path, mode="append"):
    stateful.use_state_store(spark)
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_feed_filter(spark, feed_dir, tmp_path):
    got = run(spark, feeds.live_events(spark, feed_dir, session_key="b", max_files=1), "feed", tmp_path)
    assert rows(got, "session_key", "kind") == [("b", "Mark"), ("b", "MetalCbCommitted")]


def test_sequence_gaps_match_batch(spark, log, feed_dir, tmp_path):
    got = run(spark, stateful.sequence_gaps(feeds.live_events(spark, feed_dir, max_files=1)), "gaps", tmp_path)
    want = sequences.sequence_gaps(log, keys=["session_key"], order="event_ord", seq="seq")
    cols = ("session_key", "event_ord", "expected", "got")
    assert rows(got, *cols) == rows(want, *cols) == [("a", 11, 11, 14)]


def test_op_scales_match_batch(spark, log, feed_dir, tmp_path):
    got = run(spark, stateful.op_scales(feeds.live_events(spark, feed_dir, max_files=1)), "scales", tmp_path)
    want = gpu.clamped_ops(gpu.cb_events(log))
    assert rows(got, "event_ord", "scale") == rows(want, "event_ord", "scale")


def test_queue_state_matches_batch(spark, log, feed_dir, tmp_path):
    got = run(spark, stateful.queue_state(feeds.live_events(spark, feed_dir, max_files=1)), "queues", tmp_path, "update")
    cols = ["session_key", "queue_id", "depth", "in_flight", "oldest_cb_id", "oldest_commit_ts", "last_completed_status", "last_completed_error"]
    last = got.groupBy("session_key", "queue_id").agg(F.max_by(F.struct(*cols[2:]), "event_ord").alias("s")).select("session_key", "queue_id", "s.*")
    assert rows(last, *cols) == rows(live.queue_state(log), *cols)


def test_overdue_buffers_fire_once(spark, feed_dir, tmp_path):
    got = run(spark, stateful.open_too_long(feeds.live_events(spark, feed_dir, max_files=1), limit_ns=5 * S), "overdue", tmp_path)
    # the commit of session b arrives behind the watermark and is dropped as late
    assert rows(got, "session_key", "cb_id") == [("a", 7)]


def test_recent_items_match_batch(spark, log, feed_dir, tmp_path):
    marks = feeds.live_events(spark, feed_dir, max_files=1).where("kind = 'Mark'").withColumn("text", F.col("label"))
    got = run(spark, stateful.recent_items(marks, 3), "recent", tmp_path, "update")
    newest = got.where("session_key = 'a'").groupBy().agg(F.max("event_ord")).first()[0]
    assert newest == 30
    want = live.recent_lists(log, limits={"marks": 3})["marks"].where("session_key = 'a'")
    assert set(rows(want, "event_ord", "label")) <= set(rows(got.where("session_key = 'a'"), "event_ord", "text"))


def test_events_per_second(spark, log, feed_dir, tmp_path):
    got = run(spark, feeds.events_per_second(feeds.live_events(spark, feed_dir, max_files=1), delay="1 second"), "rate", tmp_path)
    want = live.events_per_second(log).where("session_key = 'a'")
    assert set(rows(got.where("session_key = 'a'"), "second", "events")) == set(rows(want, "second", "events"))


def test_incident_slices(spark, log, feed_dir, tmp_path):
    got = run(spark, feeds.incident_slices(feeds.live_events(spark, feed_dir, max_files=1), host=None, seconds=2, delay="1 minute"), "slices", tmp_path)
    fail = log.where("error_code = 3").first()["ts_wall_ns"]
    want = log.where(F.col("ts_wall_ns").between(fail - 2 * S, fail)).count()
    # event time is in microseconds, so events a few ns after the failure share its instant
    assert want <= got.count() <= want + 2


def test_positions_by_file_and_place_and_damaged_lines(spark, tmp_path):
    """Lines without stored positions get one; bad lines come out of a feed of their own."""
    line = lambda n: json.dumps({"ts_mono_ns": n, "ts_wall_ns": n, "session_id": "a", "source": "Mark", "seq": n, "payload": {"kind": "Mark", "label": f"m{n}"}})
    d = tmp_path / "feed" / "s1"
    d.mkdir(parents=True)
    (d / "events-2.jsonl").write_text("\n".join([line(1), "{broken", line(2)]) + "\n")
    (d / "events-10.jsonl").write_text(line(3) + "\n" + '{"ts_mo')
    got = run(spark, feeds.live_events(spark, str(tmp_path / "feed"), max_files=1), "placed", tmp_path)
    assert rows(got, "event_ord", "label", "session_key") == [(2 << 32, "m1", "s1"), ((2 << 32) + 2, "m2", "s1"), (10 << 32, "m3", "s1")]
    bad = run(spark, feeds.damaged_lines(spark, str(tmp_path / "feed")), "bad", tmp_path)
    assert rows(bad, "event_ord", "line", "reason") == [((2 << 32) + 1, "{broken", "damaged"), ((10 << 32) + 1, '{"ts_mo', "damaged")]


def test_change_feed_has_marks_in_place(spark, log, feed_dir, tmp_path):
    got = run(spark, stateful.change_feed(feeds.live_events(spark, feed_dir, max_files=1)), "changes", tmp_path)
    lines = [(r.event_ord, r.side, json.loads(r.line)) for r in got.where("session_key = 'a'").orderBy("event_ord", "side").collect()]
    marks = [x for x in lines if x[1] == 0]
    assert marks == [(11, 0, {"gap": True, "session_key": "a", "expected": 11, "got": 14, "skipped": 3})]
    assert [o for o, side, _ in lines if side] == list(range(1, 32)) and all(x["event_ord"] == o for o, side, x in lines if side)


def test_rolling_ops_match_batch(spark, log, feed_dir, tmp_path):
    feed = feeds.live_events(spark, feed_dir, max_files=1)
    got = run(spark, stateful.hot_ops(feed, window_ns=5 * S, top_n=3), "rolling", tmp_path)
    newest = got.agg(F.max("at_ns")).first()[0]
    assert rows(got.where(F.col("at_ns") == newest), "rank", "name", "gpu_ns", "count") == rows(live.hot_ops(log, window_ns=5 * S, top_n=3), "rank", "name", "gpu_ns", "count")


def test_pages_of_the_queue_index(spark, tmp_path, monkeypatch):
    """Many buffers in flight over several batches; the oldest leaves late, others early."""
    monkeypatch.setattr(stateful._Queue, "PAGE", 3)
    parts = [Log("q") for _ in range(3)]
    n = 0
    for k, part in enumerate(parts):
        for i in range(8):
            part.commit(100 * k + i, 10 * k + i, depth=i)
        for cb in ([3, 1], [0, 2, 4, 12], [5, 6, 7, 10, 11, 27])[k]:
            part.done(100 * k + 50 + cb, cb)
        for r in part.rows:
            n += 1
            r["event_ord"] = r["seq"] = n
    out = tmp_path / "log"
    want = []
    for k in range(3):
        frame(spark, parts[k]).coalesce(1).write.mode("append").parquet(str(out))
        feed = spark.readStream.schema(frame(spark, parts[0]).schema).parquet(str(out)).withColumn("event_time", feeds.wall_time())
        stateful.use_state_store(spark)
        (stateful.queue_state(feed).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "pages"))
         .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).trigger(availableNow=True).start().awaitTermination())
        got = spark.read.parquet(str(tmp_path / "out"))
        want.append(rows(live.queue_state(spark.read.parquet(str(out))), "depth", "in_flight", "oldest_cb_id", "oldest_commit_ts"))
        last = got.orderBy(F.col("event_ord").desc()).limit(1)
        assert rows(last, "depth", "in_flight", "oldest_cb_id", "oldest_commit_ts") == want[-1]
    assert len({w[0][2] for w in want}) == 3


def test_replayed_batches_change_nothing(spark, log, tmp_path):
    sink = feeds.DeltaSink(str(tmp_path / "deltas"), top_n=2)
    parts = [log.where(c) for c in ("event_ord <= 9", "event_ord > 9 AND event_ord <= 20", "event_ord > 20")]
    for k, part in enumerate(parts):
        sink(part, k)
    read = lambda: [sorted(map(str, sink.read(spark, p).collect())) for p in ("state", "totals", "by_kind", "top_ops", "model_loads")]
    before = read()
    sink(parts[1], 1)
    sink(parts[2], 2)
    assert read() == before
    whole = live.delta_summary(log, 20)["totals"].where("session_key = 'a'").first()
    last = sink.read(spark, "totals").where("session_key = 'a' AND batch = 2").first()
    for c in ("cursor", "prev_cursor", "new_events", "elapsed_ns", "new_cbs", "gpu_ns_added", "current_bytes", "peak_bytes_session"):
        assert last[c] == whole[c], c


@pytest.mark.parametrize("seconds", [1, 7, 3600])
def test_incidents_meet_few_events_beyond_their_window(spark, monkeypatch, seconds):
    """Against brute force, also at the edges of the window and of its cells and before 1970."""
    at = sorted({b + d for b in (-10_000_003, 0, 1_700_000_000_123_457) for k in range(-2, 27) for d in (k * seconds * 1_000_000 // 12 + e for e in (-1, 0, 1))})
    rows = [(f"s{i % 3}", i, t, i % 5 == 0) for i, t in enumerate(at)]
    events = spark.createDataFrame(rows, "session_key string, event_ord bigint, us bigint, bad boolean").withColumn("event_time", F.timestamp_micros("us"))
    monkeypatch.setattr(feeds.filters, "incident_label", lambda: F.when(F.col("bad"), "x"))
    out = feeds.incident_slices(events, host=None, seconds=seconds)
    want = sorted((f"{k}-{i}", j) for k, i, t, bad in rows if bad for _, j, u, _ in rows if t - seconds * 1_000_000 <= u <= t)
    assert sorted(map(tuple, out.select("incident_key", "event_ord").collect())) == want
    # an hour of cells is not one cell: an incident is not compared with a whole second window
    assert feeds.CELLS >= 12
