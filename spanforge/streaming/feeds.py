"""Streaming forms that Spark's own operators express.

Event time is the wall clock.  The recorded log has no notion of late data, so
each function takes the watermark delay; rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanforge.functions.labels import op_label
from spanforge.functions.text import basename
from spanforge.operators import filters, live
from spanforge.operators.gpu import top_per_group
from spanforge.sources import events as event_source


def wall_time(ns: str = "ts_wall_ns") -> Column:
    return F.timestamp_micros(F.call_function("div", F.col(ns), F.lit(1000)))


def live_lines(spark: SparkSession, path: str, *, max_files: int | None = 16) -> DataFrame:
    """Parsed lines of a growing folder of NDJSON files, one folder per session, good and damaged.

    A line's position is the one that the writer stored, else the file's number, the last
    one in its name, times 2^32, plus the line's place in the file; so a session's files are
    numbered in the order of their writing.  A trigger takes ``max_files`` files, which bounds
    what the processors of a batch hold; files are as large as the writer's rotation makes them.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    number = F.regexp_extract(F.regexp_extract("_metadata.file_path", "[^/]+$", 0), "([0-9]+)[^0-9]*$", 1)
    files = reader.text(path, wholetext=True).select("value", event_source.directory_name().alias("_dir"), F.col("_metadata.file_path").alias("_file"),
                                     F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("_number"))
    lines = files.select("_dir", "_file", "_number", F.posexplode(F.split("value", "\n")).alias("_line", "value"))
    return event_source.parsed_lines(lines).withColumn(
        "event_ord", F.coalesce("event_ord", F.col("_number") * F.lit(1 << 32) + F.col("_line")))


def live_events(spark: SparkSession, path: str, *, session_key: str | None = None,
                max_files: int | None = 16) -> DataFrame:
    """Event feed from the good lines of :func:`live_lines`."""
    raw = live_lines(spark, path, max_files=max_files).where(F.col("reason").isNull())
    events = event_source._flatten(raw, F.coalesce("session_key", "_dir"), F.col("event_ord"))
    if session_key is not None:
        events = events.where(F.col("session_key") == session_key)
    return events.withColumn("event_time", wall_time())


def damaged_lines(spark: SparkSession, path: str, *, max_files: int | None = 16) -> DataFrame:
    """The lines that :func:`live_events` leaves out, as a feed of their own: session_key, file, event_ord, line, reason."""
    raw = live_lines(spark, path, max_files=max_files).where(F.col("reason").isNotNull())
    return raw.select(F.coalesce("session_key", "_dir").alias("session_key"), F.col("_file").alias("file"), "event_ord", F.col("value").alias("line"), "reason")


def events_per_second(events: DataFrame, *, delay: str = "10 seconds") -> DataFrame:
    w = F.window("event_time", "1 second")
    return (events.withWatermark("event_time", delay).groupBy("session_key", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select("session_key", F.unix_seconds("w.start").alias("second"), "events"))


def hot_ops(ops: DataFrame, *, width: str = "30 seconds", slide: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Op time by name over a sliding window; ``ops`` are clamped ops rows with event_time."""
    rows = ops.select("session_key", "event_time", F.explode("ops").alias("o"))
    return (rows.withWatermark("event_time", delay)
            .groupBy("session_key", F.window("event_time", width, slide).alias("w"), F.col("o.name").alias("name"))
            .agg(F.sum("o.gpu_ns").alias("gpu_ns"), F.sum("o.count").alias("count"))
            .select("session_key", F.col("w.end").alias("at"), "name", "gpu_ns", "count"))


def latest_values(events: DataFrame) -> DataFrame:
    """Latest samples per session; run in update mode."""
    return live.latest_values(events)


#: Cells of a window in which incidents and events meet.
CELLS = 12


def incident_slices(events: DataFrame, *, host: str | None, seconds: int = 60, delay: str = "10 seconds") -> DataFrame:
    """Each incident with the events of the window before it on its host, as an interval join.

    ``host`` names the events' column; None says that all are of one host.  Both sides carry the number of the cell their time falls into, a
    twelfth of the window wide; an incident looks into its own cell and those of the window before.
    So of 13 events that it is compared with 12 are in the window.  The incidents of a cell that
    come together are one row of the join's state, as reading the state costs by its rows.
    """
    width = -(-seconds * 1_000_000 // CELLS)
    cell = lambda c: F.call_function("div", F.unix_micros(c), F.lit(width))
    keys = [*(["incident_host"] if host else []), "_cell"]
    triggers = events.withColumn("incident_label", filters.incident_label()).where(
        F.col("incident_label").isNotNull()).select(
        *([F.col(host).alias("incident_host")] if host else []), F.concat_ws("-", "session_key", F.col("event_ord").cast("string")).alias("incident_key"),
        "incident_label", F.col("event_time").alias("incident_time"))
    own = cell(F.col("incident_time"))
    triggers = triggers.withColumn("_cell", F.explode(F.sequence(own - CELLS, own)))
    kinds = dict(triggers.dtypes)
    incident = ",".join(f"{c}:{kinds[c]}" for c in triggers.columns if c not in keys)
    packs = triggers.repartition(*keys).mapInArrow(
        _packed(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + f", _latest timestamp, _incidents array<struct<{incident}>>")
    packs = packs.withColumnRenamed("_cell", "_incident_cell").withWatermark("_latest", delay)
    rows = events.withWatermark("event_time", delay).withColumn("_cell", cell(F.col("event_time")))
    # what is in a cell is no more than 13 cells, 14 where cells meet at time 0, before the latest of its incidents
    near = F.expr(f"event_time BETWEEN _latest - INTERVAL {(CELLS + 2) * width} MICROSECONDS AND _latest")
    same = F.col("_cell") == F.col("_incident_cell")
    if host:
        same = same & (F.col(host) == F.col("incident_host"))
    # the packs come first: an event then reads the few packs of its cell, not an incident all events
    met = packs.join(rows, same & near, "inner").select(*[c for c in rows.columns if c != "_cell"], F.explode("_incidents").alias("_i"))
    inside = F.expr(f"event_time BETWEEN incident_time - INTERVAL {seconds} SECONDS AND incident_time")
    return met.select(*events.columns, "_i.*").where(inside)


def _packed(keys: list[str]):
    """The rows of each batch by ``keys``: these, the latest time of the rows, and the rows' other columns as a list."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                batch = batch.sort_by([(k, "ascending") for k in keys])
                ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys]))
                starts = np.concatenate([[0], ends[:-1]])
                own = [c for c in batch.schema.names if c not in keys]
                time = batch.column("incident_time")
                latest = np.maximum.reduceat(time.cast(pa.int64()).to_numpy(), starts)
                rows = pa.StructArray.from_arrays([batch.column(c) for c in own], names=own)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends[-1:]]), pa.int32()), rows)
                yield pa.record_batch([*(batch.column(k).take(pa.array(starts)) for k in keys), pa.array(latest).cast(time.type), lists],
                                      names=[*keys, "_latest", "_incidents"])

    return run


def new_reports(reports: DataFrame, *, own_process: str, delay: str = "1 hour") -> DataFrame:
    """Reports not seen before, by incident id or else path; ``reports`` has event_time."""
    fresh = reports.where(~F.coalesce(F.col("proc_name") == own_process, F.lit(False)))
    return (fresh.withColumn("report_key", F.coalesce("incident_id", "path")).withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["report_key"]))


def ndjson_feed(events: DataFrame) -> DataFrame:
    from spanforge.sinks.files import event_json

    return event_json(events).select(F.col("json").alias("value"))


class DeltaSink:
    """What is new in each batch of a feed, and every session's running totals, for ``foreachBatch``.

    The totals before a batch are a table of their own, written by the batch before.  A
    batch's results depend on these and on its rows alone and overwrite what an earlier try
    of it left, so a batch that is replayed after a failure changes nothing.  Parts, under
    ``path``: ``state`` (session_key, cursor, first and last time, current and peak bytes),
    ``totals``, ``by_kind``, ``top_ops`` and ``model_loads``, each by batch.
    """

    STATE = "session_key string, cursor bigint, first_ord bigint, first_ns bigint, last_ord bigint, last_ns bigint, mem_ord bigint, current_bytes bigint, peak_bytes bigint"

    def __init__(self, path: str, *, top_n: int = 8):
        self.path, self.top_n = path, top_n

    def _write(self, df: DataFrame, part: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch_id}")

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{part}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, order = batch.sparkSession, F.col("event_ord")
        batch = batch.persist()
        old = spark.read.schema(self.STATE).parquet(f"{self.path}/state/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], self.STATE)
        kind = F.col("kind")
        sample = F.when(kind == "MetalDeviceMemSample", F.col("allocated_bytes"))
        new = batch.groupBy("session_key").agg(
            F.count(F.lit(1)).alias("cursor"), F.min("event_ord").alias("first_ord"), F.min_by("ts_mono_ns", "event_ord").alias("first_ns"),
            F.max("event_ord").alias("last_ord"), F.max_by("ts_mono_ns", "event_ord").alias("last_ns"),
            F.max(F.when(sample.isNotNull(), order)).alias("mem_ord"), F.max_by(sample, F.when(sample.isNotNull(), order)).alias("current_bytes"),
            F.max(sample).alias("peak_bytes"))
        state = old.unionByName(new).groupBy("session_key").agg(
            F.sum("cursor").alias("cursor"), F.min("first_ord").alias("first_ord"), F.min_by("first_ns", "first_ord").alias("first_ns"),
            F.max("last_ord").alias("last_ord"), F.max_by("last_ns", "last_ord").alias("last_ns"), F.max("mem_ord").alias("mem_ord"),
            F.max_by("current_bytes", "mem_ord").alias("current_bytes"), F.max("peak_bytes").alias("peak_bytes"))
        self._write(state, "state", batch_id)
        state = spark.read.schema(self.STATE).parquet(f"{self.path}/state/batch={batch_id}")
        ops = batch.where(kind == "MetalCbOps").select("session_key", F.explode("ops").alias("o"))
        by_op = ops.groupBy("session_key", op_label(F.col("o.symbol"), F.col("o.name")).alias("op_kind")).agg(
            F.sum("o.count").alias("count"), F.sum("o.gpu_ns").alias("gpu_ns"))
        added = by_op.groupBy("session_key").agg(F.sum("gpu_ns").alias("gpu_ns_added"))
        done = batch.groupBy("session_key").agg(F.count(F.lit(1)).alias("new_events"), F.count_if(kind == "MetalCbCompleted").alias("new_cbs"))
        zero = F.lit(0).cast("bigint")
        totals = done.join(state, "session_key").join(added, "session_key", "left").select(
            "session_key", "cursor", (F.col("cursor") - F.col("new_events")).alias("prev_cursor"), "new_events",
            F.greatest(zero, F.col("last_ns") - F.col("first_ns")).alias("elapsed_ns"), "new_cbs", F.coalesce("gpu_ns_added", zero).alias("gpu_ns_added"),
            F.coalesce("current_bytes", zero).alias("current_bytes"), F.coalesce("peak_bytes", zero).alias("peak_bytes_session"))
        self._write(totals, "totals", batch_id)
        self._write(batch.groupBy("session_key", "kind").agg(F.count(F.lit(1)).alias("count")), "by_kind", batch_id)
        self._write(top_per_group(by_op, ["session_key"], [F.col("gpu_ns").desc(), F.col("op_kind")], self.top_n), "top_ops", batch_id)
        self._write(batch.where(kind == "ModelLoad").select(
            "session_key", "event_ord", basename(F.col("path")).alias("name"), F.col("size_bytes").alias("bytes")), "model_loads", batch_id)
        batch.unpersist()


def delta_batches(events: DataFrame, sink: Callable[[DataFrame, int], None], *, checkpoint: str):
    """A writer that hands each micro-batch to ``sink``; the query's checkpoint is the cursor, so a batch has exactly the new events."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
