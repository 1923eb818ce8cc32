"""Batch forms of the live views: deltas after a cursor, rolling state, state as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.labels import op_label
from spanforge.functions.text import basename
from spanforge.operators import gpu, rendering, sequences
from spanforge.operators.gpu import top_per_group
from spanforge.operators.scan import chunk_of, with_running
from spanforge.operators.sessions import recent
from spanforge.schema import NS_PER_SEC

RECENT = {"marks": 10, "notices": 200, "model_loads": 256, "memory_samples": 1024}


def after_cursor(events: DataFrame, cursor: int, *, chunk: Column | None = None) -> DataFrame:
    """Events after the first ``cursor`` ones of each session."""
    n = with_running(events, ["session_key"], ["event_ord"], {"_n": ("count", F.lit(1))},
                     chunk=chunk_of() if chunk is None else chunk)
    return n.where(F.col("_n") > cursor).drop("_n")


def delta_summary(events: DataFrame, cursor: int, *, live: bool = False, clamp: bool = False, top_n: int = 8,
                  chunk: Column | None = None) -> dict[str, DataFrame]:
    """What is new after a cursor: totals, counts by kind, top op kinds and model loads.

    Memory is that of the whole session.  Op times are raw unless ``clamp``.
    """
    delta = after_cursor(events, cursor, chunk=chunk)
    kind = F.col("kind")
    mem = F.when(kind == "MetalDeviceMemSample", F.col("allocated_bytes"))
    whole = events.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("cursor"),
        F.greatest(F.lit(0).cast("bigint"), F.max_by("ts_mono_ns", "event_ord") - F.min_by("ts_mono_ns", "event_ord")).alias("elapsed_ns"),
        F.coalesce(F.max_by(mem, F.when(mem.isNotNull(), F.col("event_ord"))), F.lit(0)).alias("current_bytes"),
        F.coalesce(F.max(mem), F.lit(0)).alias("peak_bytes_session"))
    src = delta.where(kind == "MetalCbOps").select("session_key", "event_ord", "ops")
    if clamp:
        scaled = gpu.clamped_ops(gpu.cb_events(events, chunk=chunk), chunk=chunk).select("session_key", "event_ord", "ops")
        src = src.drop("ops").join(scaled, ["session_key", "event_ord"])
    ops = src.select("session_key", F.explode("ops").alias("o"))
    by_op = ops.groupBy("session_key", op_label(F.col("o.symbol"), F.col("o.name")).alias("op_kind")).agg(
        F.sum("o.count").alias("count"), F.sum("o.gpu_ns").alias("gpu_ns"))
    gpu_total = by_op.groupBy("session_key").agg(F.sum("gpu_ns").alias("gpu_ns_added"))
    new = delta.groupBy("session_key").agg(F.count(F.lit(1)).alias("new_events"),
                                           F.count_if(kind == "MetalCbCompleted").alias("new_cbs"))
    zero = F.lit(0).cast("bigint")
    n = F.coalesce("new_events", zero)
    note = (F.when(F.lit(cursor) > F.col("cursor"), "cursor lies past the end and was set back")
            .when(n == 0, "nothing new" if live else "nothing new, the session is closed")
            .when(F.lit(not live), "the session is closed"))
    totals = whole.join(new, "session_key", "left").join(gpu_total, "session_key", "left").select(
        "session_key", "cursor", F.least(F.lit(cursor).cast("bigint"), F.col("cursor")).alias("prev_cursor"),
        n.alias("new_events"), "elapsed_ns", F.coalesce("new_cbs", zero).alias("new_cbs"),
        F.coalesce("gpu_ns_added", zero).alias("gpu_ns_added"), "current_bytes", "peak_bytes_session", note.alias("note"))
    loads = delta.where(kind == "ModelLoad").select(
        "session_key", "event_ord", basename(F.col("path")).alias("name"), F.col("size_bytes").alias("bytes"))
    return {"totals": totals, "by_kind": delta.groupBy("session_key", "kind").agg(F.count(F.lit(1)).alias("count")),
            "top_ops": top_per_group(by_op, ["session_key"], [F.col("gpu_ns").desc(), F.col("op_kind")], top_n),
            "model_loads": loads}


def events_per_second(events: DataFrame, *, keep_seconds: int = 60) -> DataFrame:
    """Events per wall second, from ``keep_seconds`` before each session's newest."""
    counts = events.groupBy("session_key", F.call_function("div", F.col("ts_wall_ns"), F.lit(NS_PER_SEC)).alias("second")).agg(
        F.count(F.lit(1)).alias("events"))
    newest = counts.groupBy("session_key").agg(F.max("second").alias("_new"))
    return counts.join(newest.hint("merge"), "session_key").where(F.col("second") >= F.col("_new") - keep_seconds).drop("_new")


def hot_ops(events: DataFrame, *, window_ns: int = 30 * NS_PER_SEC, top_n: int = 10,
            chunk: Column | None = None) -> DataFrame:
    """Clamped op time by op name over the last window before each session's newest ops event."""
    ops = gpu.clamped_ops(gpu.cb_events(events, chunk=chunk), chunk=chunk)
    newest = ops.groupBy("session_key").agg(F.max("ts_mono_ns").alias("_new"))
    rows = ops.join(newest, "session_key").where(F.col("ts_mono_ns") >= F.col("_new") - window_ns).select(
        "session_key", F.explode("ops").alias("o"))
    agg = rows.groupBy("session_key", F.col("o.name").alias("name")).agg(
        F.sum("o.gpu_ns").alias("gpu_ns"), F.sum("o.count").alias("count"))
    return top_per_group(agg, ["session_key"], [F.col("gpu_ns").desc(), F.col("name")], top_n)


def queue_state(events: DataFrame) -> DataFrame:
    """Each queue at the log's end: depth, buffers in flight, the oldest, last status and error.

    A commit puts its buffer in flight (again), a completion on that queue takes
    it out; the last of the two per buffer decides.
    """
    kind = F.col("kind")
    rows = events.where(kind.isin("MetalCbCommitted", "MetalCbCompleted"))
    commit, done = kind == "MetalCbCommitted", kind == "MetalCbCompleted"
    keys = ["session_key", "queue_id"]
    last = rows.groupBy(*keys, "cb_id").agg(F.max_by(F.struct("kind", "ts_mono_ns"), "event_ord").alias("l"))
    flying = last.where(F.col("l.kind") == "MetalCbCommitted").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("in_flight"),
        F.min_by(F.struct("cb_id", F.col("l.ts_mono_ns").alias("ts")), F.struct("l.ts_mono_ns", "cb_id")).alias("o"))
    at = lambda c, cond: F.max_by(c, F.when(cond, F.col("event_ord")))
    state = rows.groupBy(*keys).agg(
        F.coalesce(at("queue_depth", commit), F.lit(0)).alias("depth"),
        at("status", done).alias("last_completed_status"), at("error_code", done).alias("last_completed_error"))
    return state.join(flying.hint("merge"), keys, "left").select(
        *keys, "depth", F.coalesce("in_flight", F.lit(0).cast("bigint")).alias("in_flight"),
        F.col("o.cb_id").alias("oldest_cb_id"), F.col("o.ts").alias("oldest_commit_ts"),
        "last_completed_status", "last_completed_error")


def latest_values(events: DataFrame) -> DataFrame:
    """Last memory poll, system sample, process table, streams seen and clock of each session."""
    kind = F.col("kind")
    at = lambda k, *cols: F.max_by(F.struct(*cols, "ts_mono_ns"), F.when(kind == k, F.col("event_ord")))
    return events.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("events_total"),
        at("MlxMemoryPoll", "active_bytes", "peak_bytes", "cache_bytes").alias("mlx_memory"),
        at("VmSample", "wired_bytes", "active_bytes", "compressed_bytes", "swap_used_bytes", "page_outs_per_sec").alias("vm_sample"),
        F.max_by("top", F.when(kind == "ProcTop", F.col("event_ord"))).alias("proc_top"),
        F.array_sort(F.collect_set(F.when(kind == "MlxEvalEntered", F.col("stream")))).alias("streams_seen"),
        F.left(F.min_by("session_id", "event_ord"), F.lit(8)).alias("session_short"),
        F.max_by("ts_wall_ns", "event_ord").alias("last_ts_wall_ns"), F.max_by("ts_mono_ns", "event_ord").alias("last_ts_mono_ns"))


def eval_depth(events: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Open evals at the log's end, never below 0."""
    kind = F.col("kind")
    walk = sequences.saturating_depth(events, keys=["session_key"], order="event_ord", up=kind == "MlxEvalEntered",
                                      down=kind == "MlxEvalReturned", chunk=chunk_of() if chunk is None else chunk)
    return walk.groupBy("session_key").agg(F.max_by("depth", "event_ord").alias("mlx_eval_depth"))


def recent_lists(events: DataFrame, *, limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The latest marks, notices, model loads, unloads and memory samples of each session."""
    n = {**RECENT, **(limits or {})}
    at = lambda k, *cols: events.where(F.col("kind") == k).select("session_key", "event_ord", "ts_mono_ns", *cols)
    last = lambda df, k: recent(df, ["session_key"], "event_ord", n[k])
    return {
        "marks": last(at("Mark", "label"), "marks"),
        "notices": last(rendering.notice_feed(events), "notices"),
        "model_loads": last(at("ModelLoad", "path", "size_bytes", "t_start_ns", "t_end_ns", "sha8", "framework"), "model_loads"),
        "model_unloads": last(at("ModelUnload", "path", "t_ns", "sha8"), "model_loads"),
        "memory_samples": last(at("MetalDeviceMemSample", "allocated_bytes"), "memory_samples"),
    }


def prefix(events: DataFrame, at_ns: int) -> DataFrame:
    """Events up to a time after the session's start, clamped to its duration."""
    start = events.groupBy("session_key").agg(F.min("ts_mono_ns").alias("_t0"))
    return events.join(start.hint("merge"), "session_key").where(F.col("ts_mono_ns") - F.col("_t0") <= max(0, at_ns)).drop("_t0")


def state_as_of(events: DataFrame, at_ns: int, *, chunk: Column | None = None) -> dict[str, DataFrame]:
    """Every live view as it stood at a time: the same views over the prefix."""
    past = prefix(events, at_ns)
    return {"values": latest_values(past), "queues": queue_state(past), "eval_depth": eval_depth(past, chunk=chunk),
            "hot_ops": hot_ops(past, chunk=chunk), "events_per_second": events_per_second(past), **recent_lists(past)}


def snapshot(events: DataFrame, at_ns: int) -> DataFrame:
    """One JSON-ready row per session: latest values, queues and eval depth."""
    past = prefix(events, at_ns)
    queues = queue_state(past).groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct(
        "queue_id", "depth", "in_flight", "oldest_cb_id", "last_completed_status", "last_completed_error"))).alias("metal_queues"))
    # a row per session on either side: all of them lie by session, none is sent to the driver
    return latest_values(past).join(queues.hint("merge"), "session_key", "left").join(eval_depth(past).hint("merge"), "session_key", "left")


