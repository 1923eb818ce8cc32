"""Incidents of one cell are one row of the stream's state, and meet the same events."""

from pyspark.sql import functions as F

from spanforge.streaming import feeds, stateful

SCHEMA = "session_key string, event_ord bigint, us bigint, h string, bad boolean"


def test_incidents_that_come_together_are_one_row_of_state(spark, tmp_path, monkeypatch):
    """Two batches, three hosts, of which one has no name; most incidents are in a few cells."""
    rows = [("s", i, 1_700_000_000_000_000 + i * 50_000, ("a", "b", None)[i % 7 % 3], 200 <= i < 400 or i == 805) for i in range(1000)]
    monkeypatch.setattr(feeds.filters, "incident_label", lambda: F.when(F.col("bad"), "x"))
    stateful.use_state_store(spark)
    got, state, schema = [], [], None
    for n, part in enumerate((rows[:500], rows[500:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        feed = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")).withColumn("event_time", F.timestamp_micros("us"))
        out = feeds.incident_slices(feed, host="h", seconds=12, delay="1 hour")
        assert out.columns == ["session_key", "event_ord", "us", "h", "bad", "event_time", "incident_key", "incident_label", "incident_time"]
        run = (out.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
               .foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.select("incident_key", "event_ord").collect())).start())
        run.awaitTermination()
        state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]))
    want = sorted((f"s-{i}", j) for _, i, t, h, bad in rows if bad and h for _, j, u, g, _ in rows if g == h and t - 12_000_000 <= u <= t)
    assert sorted(got) == want and len(want) > 12_000
    # events, and for each of two hosts the cells of the window before 10 s of incidents; 2,216 with a row for each incident and cell
    assert state[0] <= 500 + 2 * (13 + 11)
