"""Begin/end pairing, scope windows and object lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.operators.scan import chunk_of, with_running
from spanforge.schema import NS_PER_SEC
from spanforge.session_conf import cut_lineage

ASYNC_GRACE_NS = NS_PER_SEC // 2
POST_MORTEM_PREFIX = "post-mortem-"


def pair_intervals(
    df: DataFrame,
    *,
    keys: list[str],
    order: str,
    begin: Column,
    end: Column,
    carry: dict[str, Column],
    chunk: Column | None = None,
) -> DataFrame:
    """Pair each end with the most recent unconsumed begin of the same key.

    A second begin replaces the first and unmatched rows drop, so an end is
    paired exactly when the row before it, among begins and ends of its key, is
    a begin.  Keeps the end rows and adds ``carry`` (evaluated at the begin).
    Pass ``chunk`` for recycled keys whose groups can grow without bound.
    """
    rows = df.where(begin | end).withColumn("_begin", begin)
    state = F.struct("_begin", *[c.alias(n) for n, c in carry.items()])
    rows = with_running(rows, keys, [order], {"_prev": ("last", state)}, chunk=chunk, before=True)
    return (rows.where(~F.col("_begin") & F.col("_prev._begin"))
            .withColumns({n: F.col(f"_prev.{n}") for n in carry})
            .drop("_begin", "_prev"))


def eval_windows(events: DataFrame, *, grace_ns: int = ASYNC_GRACE_NS,
                 chunk: Column | None = None) -> DataFrame:
    """Eval calls as windows, the async ones widened by the grace."""
    frame = F.get(F.col("stack_frames"), 0)
    paired = pair_intervals(
        events, keys=["session_key", "call_id"], order="event_ord",
        begin=F.col("kind") == "MlxEvalEntered", end=F.col("kind") == "MlxEvalReturned",
        carry={
            "t_in": F.col("ts_mono_ns"), "enter_ord": F.col("event_ord"), "enter_seq": F.col("seq"),
            "stack": F.coalesce("module_stack", F.array().cast("array<bigint>")),
            "top_frame": F.concat(F.regexp_replace(frame["filename"], "^.*/", ""), F.lit(":"),
                                  frame["lineno"].cast("string")),
        },
        chunk=chunk,
    )
    return paired.select(
        "session_key", "call_id", "t_in",
        (F.col("ts_mono_ns") + F.when(F.col("was_async"), grace_ns).otherwise(0)).alias("t_out"),
        "enter_seq", F.col("enter_ord"), F.col("event_ord").alias("ret_ord"), "stack", "top_frame",
        "duration_ns", "was_async")


def session_end(events: DataFrame) -> DataFrame:
    """Time and position of the last event of each session, in log order."""
    return events.groupBy("session_key").agg(
        F.max_by("ts_mono_ns", "event_ord").alias("end_ts"), F.max("event_ord").alias("end_ord"))


def scope_calls(events: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Every scope enter with the return that closed it, if any.

    A return closes the latest enter of the call it names, wherever it sits;
    later returns of a closed call change nothing.  Of enters that share an id
    only the last is a call; the others count as malformed.
    """
    rows = events.where(F.col("kind").isin("ModuleEntered", "ModuleReturned")).select(
        "session_key", "event_ord", "ts_mono_ns", "module_call_id", "qualname", "class_name",
        "parent_call_id", "depth", "fields", (F.col("kind") == "ModuleEntered").alias("_enter"))
    rows = with_running(
        rows, ["session_key", "module_call_id"], ["event_ord"],
        {"_next": ("next", F.struct("_enter", F.col("event_ord").alias("ord"),
                                    F.col("ts_mono_ns").alias("ts"))),
         "_again": ("next", F.when(F.col("_enter"), F.col("event_ord")))}, chunk=chunk)
    closed = F.col("_next").isNotNull() & ~F.col("_next._enter")
    return rows.where(F.col("_enter")).select(
        "session_key", F.col("module_call_id").alias("call_id"), F.col("event_ord").alias("enter_ord"),
        F.col("ts_mono_ns").alias("t_in"), "qualname", "class_name", "parent_call_id", "depth",
        "fields",
        F.when(closed, F.col("_next.ts")).alias("ret_ts"),
        F.when(closed, F.col("_next.ord")).alias("ret_ord"),
        (F.col("_next").isNotNull() & F.col("_next._enter")).alias("superseded"),
        F.col("_again").isNull().alias("last_of_id"))


def scope_windows(events: DataFrame, *, calls: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Scope calls as windows; a call that never returned lasts to the session's end."""
    calls = scope_calls(events) if calls is None else calls
    ends = session_end(events) if ends is None else ends
    return (_last_enter_per_id(calls).join(ends, "session_key", "left")
            .withColumn("t_out", F.coalesce("ret_ts", "end_ts")).drop("end_ts"))


def _last_enter_per_id(calls: DataFrame) -> DataFrame:
    return calls.where("last_of_id").drop("last_of_id")


def malformed_returns(events: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Per session: returns of never-entered calls plus calls still open at the end."""
    rows = events.where(F.col("kind").isin("ModuleEntered", "ModuleReturned")).select(
        "session_key", "event_ord", "module_call_id",
        (F.col("kind") == "ModuleEntered").alias("_enter"))
    rows = with_running(
        rows, ["session_key", "module_call_id"], ["event_ord"],
        {"_seen": ("count", F.when(F.col("_enter"), 1))}, chunk=chunk)
    orphan = ~F.col("_enter") & (F.coalesce(F.col("_seen"), F.lit(0)) == 0)
    orphans = rows.groupBy("session_key").agg(F.count_if(orphan).alias("n"))
    open_calls = scope_calls(events, chunk=chunk).groupBy("session_key").agg(
        F.count_if(F.col("ret_ord").isNull()).alias("n"))
    return (orphans.unionByName(open_calls).groupBy("session_key")
            .agg(F.sum("n").alias("malformed_returns")))


def model_loads(events: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Model-file lifetimes: duplicates of an unreleased load, and the unload time.

    Only the difference of the client-clock times is used; it is anchored at
    the event's own timestamp.
    """
    chunk = chunk_of() if chunk is None else chunk
    # two orders are scanned, by session and by path; the few rows of both kinds are taken out of the log once
    rows = cut_lineage(events.where(F.col("kind").isin("ModelLoad", "ModelUnload")).select(
        "session_key", "event_ord", "ts_mono_ns", "seq", "path", "size_bytes", "t_start_ns",
        "t_end_ns", "sha8", "framework", (F.col("kind") == "ModelLoad").alias("_load")))
    rows = with_running(rows, ["session_key"], ["event_ord"], {"_n": ("count", F.when(F.col("_load"), 1))}, chunk=chunk)
    rows = rows.withColumn("load_index", F.col("_n") - 1).drop("_n")
    at = F.struct("_load", F.col("load_index").alias("idx"), F.col("ts_mono_ns").alias("ts"))
    rows = with_running(rows, ["session_key", "path"], ["event_ord"], {"_prev": ("prev", at), "_next": ("next", at)}, chunk=chunk)
    dur = F.greatest(F.lit(0), F.col("t_end_ns") - F.col("t_start_ns"))
    return rows.where(F.col("_load")).select(
        "session_key", "load_index", "path", "size_bytes",
        F.greatest(F.lit(0), F.col("ts_mono_ns") - dur).alias("t_start_ns"),
        F.col("ts_mono_ns").alias("t_end_ns"), dur.alias("duration_ns"), "sha8", "framework",
        F.when(F.col("_prev._load"), F.col("_prev.idx")).alias("duplicate_of"),
        F.when(F.col("_prev._load"), F.col("_prev.ts")).alias("duplicate_of_ts"),
        F.when(~F.col("_next._load"), F.col("_next.ts")).alias("unloaded_at_ns"),
        "event_ord", "seq")


def live_allocations(
    df: DataFrame, *, keys: list[str], ident: str, order: str, alloc: Column, free: Column,
    size: Column, chunk: Column | None = None,
) -> DataFrame:
    """Number and bytes of live objects after each alloc/free row.

    A free of an unknown object is ignored and a second alloc of a live object
    replaces its size.  The previous row of the object gives each row's change;
    the running sum of the changes is the state.
    """
    rows = df.where(alloc | free).withColumn("_size", F.when(alloc, size))
    rows = with_running(rows, keys + [ident], [order],
                        {"_prev": ("last", F.struct("_size"))}, chunk=chunk, before=True)
    was = F.col("_prev._size")
    rows = rows.withColumns({
        "_dn": F.when(alloc, 1).otherwise(0) - F.when(was.isNotNull(), 1).otherwise(0),
        "_db": F.coalesce("_size", F.lit(0)) - F.coalesce(was, F.lit(0)),
    })
    rows = with_running(rows, keys, [order], {"live_count": ("sum", F.col("_dn")),
                                              "live_bytes": ("sum", F.col("_db"))}, chunk=chunk)
    return rows.drop("_size", "_prev", "_dn", "_db")


def live_snapshot(events: DataFrame, at_ns: int | Column) -> DataFrame:
    """Objects alive at a time: count, bytes and the sorted set of their streams."""
    at = at_ns if isinstance(at_ns, Column) else F.lit(at_ns)
    rows = events.where(F.col("kind").isin("MlxArrayAlive", "MlxArrayFreed")
                        & (F.col("ts_mono_ns") <= at))
    last = rows.groupBy("session_key", "array_id").agg(
        F.max_by(F.struct("kind", "size_bytes", "stream"), "event_ord").alias("s"))
    return last.where(F.col("s.kind") == "MlxArrayAlive").groupBy("session_key").agg(
        F.count(F.lit(1)).alias("live_arrays"), F.sum("s.size_bytes").alias("total_array_bytes"),
        F.array_sort(F.collect_set("s.stream")).alias("streams"))


def attachments(log: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Session attachment intervals from attach/detach rows.

    ``log`` has at_ord, at_ns, action ('attach' or 'detach'), pid, session_key
    and scope_token.  A new attach of a pid ends the previous one.
    """
    chunk = chunk_of("at_ord") if chunk is None else chunk
    rows = with_running(log, ["pid"], ["at_ord"],
                        {"_next": ("next", F.struct("action", F.col("at_ns").alias("ns"),
                                                    F.col("at_ord").alias("ord")))}, chunk=chunk)
    return rows.where(F.col("action") == "attach").select(
        "pid", "session_key", "scope_token", F.col("at_ord").alias("attach_ord"),
        F.col("at_ns").alias("attach_ns"), F.col("_next.ord").alias("detach_ord"),
        F.col("_next.ns").alias("detach_ns"),
        F.when(F.col("_next.action") == "attach", "superseded")
        .when(F.col("_next.action") == "detach", F.concat(F.lit("record:exit pid="), F.col("pid").cast("string")))
        .alias("end_reason"))


def close_orphans(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """End sessions that were never finalised at their last event; idempotent."""
    last = events.groupBy("session_key").agg(F.max("ts_wall_ns").alias("_last"))
    orphan = F.col("ended_rfc3339").isNull() & ~F.col("session_key").startswith(POST_MORTEM_PREFIX)
    ended = F.date_format(F.timestamp_micros(F.call_function("div", F.col("_last"), F.lit(1000))),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return (sessions.join(last, "session_key", "left")
            .withColumns({"end_reason": F.when(orphan & F.col("_last").isNotNull(), "recovered-after-crash")
                          .otherwise(F.col("end_reason")),
                          "ended_rfc3339": F.when(orphan, ended).otherwise(F.col("ended_rfc3339"))})
            .drop("_last"))
