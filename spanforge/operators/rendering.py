"""One-line renderings of events and the notice feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.text import basename, binary_bytes, truncate


def _hex(c: str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.col(c))))


def _dash(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def _ms(c: str) -> Column:
    return F.concat(F.call_function("div", F.col(c), F.lit(1_000_000)).cast("string"), F.lit("ms"))


def _list(c: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))


def _line(head: str, **parts) -> Column:
    bits = [F.lit(head)]
    for k, v in parts.items():
        v = F.col(v).cast("string") if isinstance(v, str) else v
        bits.append(F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("-"))))
    return F.concat_ws(" ", *bits)


def notice_feed(events: DataFrame) -> DataFrame:
    """Log-like view: nine kinds of event as (time, label, summary).

    Probe health shows only when degraded or failed.
    """
    kind = F.col("kind")
    bad = (kind == "ProbeHealth") & F.col("state").isin("Degraded", "Failed")
    why = F.coalesce(F.concat(F.lit(": "), F.col("reason")), F.lit(""))
    label = (F.when(kind == "Mark", "mark").when(kind == "OsLogLine", "oslog")
             .when(kind == "CrashReportEmitted", "crash-rpt").when(kind == "MachException", "mach-exc")
             .when(kind == "PostMortemFlushed", "post-mortem").when(kind == "MetalHookSkipped", "metal-hook")
             .when(bad, "probe").when(kind == "MetalCbWarning", "metal-cb")
             .when(kind == "MlxPanicTriggered", "mlx-panic"))
    summary = (
        F.when(kind == "Mark", F.col("label"))
        .when(kind == "OsLogLine", F.concat("subsystem", F.lit(": "), truncate(F.col("message"), 120)))
        .when(kind == "CrashReportEmitted", F.concat(basename(F.col("path")), F.lit(" "), truncate(F.col("summary"), 80)))
        .when(kind == "MachException", F.format_string("pid=%d type=%d", "target_pid", "exception_type"))
        .when(kind == "PostMortemFlushed", F.format_string("%s (%d events)", "reason", "event_count"))
        .when(kind == "MetalHookSkipped", F.concat(F.lit("skipped: "), F.col("reason")))
        .when(bad, F.concat("probe", F.lit(" "), F.lower("state"), why))
        .when(kind == "MetalCbWarning", F.concat(
            F.lit("cb="), _hex("cb_id"), F.lit(" q="), _hex("queue_id"),
            F.format_string(" in-flight %.1fms", F.col("elapsed_ns") / 1e6)))
        .when(kind == "MlxPanicTriggered", F.col("condition")))
    return events.select("session_key", "event_ord", "ts_mono_ns", label.alias("label"),
                         summary.alias("summary")).where(F.col("label").isNotNull())


def render_events(events: DataFrame) -> DataFrame:
    """One readable line per event."""
    kind = F.col("kind")
    size = binary_bytes(F.col("size_bytes"))
    label = _dash("label")
    lines = {
        "Mark": F.concat(F.lit("mark    "), F.col("label")),
        "SessionStarted": F.lit("session-started"),
        "SessionEnded": F.concat(F.lit("session-ended ("), F.col("reason"), F.lit(")")),
        "PythonSidecarHello": _line("PythonSidecarHello", python="python_version",
                                    mlx=F.coalesce("mlx_version", F.lit("none")), argv=_list("argv")),
        "MetalCbCommitted": _line("MetalCbCommitted", cb_id=_hex("cb_id"), queue_id="queue_id",
                                  queue_depth="queue_depth", label=label),
        "MetalCbScheduled": _line("MetalCbScheduled", cb_id=_hex("cb_id"), queue_id="queue_id"),
        "MetalCbCompleted": _line("MetalCbCompleted", cb_id=_hex("cb_id"), queue_id="queue_id", status="status",
                                  error_code="error_code", domain="error_domain", in_flight=_ms("in_flight_ns")),
        "MetalCbWarning": _line("MetalCbWarning", cb_id=_hex("cb_id"), queue_id="queue_id", elapsed=_ms("elapsed_ns")),
        "MetalCbOps": _line("MetalCbOps", cb_id=_hex("cb_id"), ops=F.size("ops").cast("string")),
        "MetalHeapAlloc": _line("MetalHeapAlloc", heap_id=_hex("heap_id"), size=size, label=label),
        "MetalHeapFree": _line("MetalHeapFree", heap_id=_hex("heap_id")),
        "MetalBufferAlloc": _line("MetalBufferAlloc", buf=_hex("buffer_id"), heap=_hex("heap_id"), size=size, label=label),
        "MetalBufferFree": _line("MetalBufferFree", buf=_hex("buffer_id")),
        "MetalTextureAlloc": _line("MetalTextureAlloc", tex=_hex("texture_id"), size=size, label=label),
        "MetalTextureFree": _line("MetalTextureFree", tex=_hex("texture_id")),
        "MetalDeviceMemSample": _line("MetalDeviceMemSample", allocated=binary_bytes(F.col("allocated_bytes")),
                                      budget=binary_bytes(F.col("recommended_max_bytes")), at="at_event"),
        "MetalHookDropped": _line("MetalHookDropped", count="dropped_count"),
        "MetalHookSkipped": _line("MetalHookSkipped", reason="reason"),
        "MlxEvalEntered": _line("MlxEvalEntered", call_id="call_id", arrays="array_count", stream="stream"),
        "MlxEvalReturned": F.concat(_line("MlxEvalReturned", call_id="call_id", duration=_ms("duration_ns")),
                                    F.lit(" async="), F.col("was_async").cast("string")),
        "MlxMemoryPoll": _line("MlxMemoryPoll", active=binary_bytes(F.col("active_bytes")),
                               peak=binary_bytes(F.col("peak_bytes")), cache=binary_bytes(F.col("cache_bytes"))),
        "MlxArrayAlive": _line("MlxArrayAlive", id=_hex("array_id"), size=size, dtype="dtype", shape=_list("shape"),
                               stream="stream"),
        "MlxArrayFreed": _line("MlxArrayFreed", id=_hex("array_id")),
        "MlxSnapshot": _line("MlxSnapshot", arrays="live_arrays", total=binary_bytes(F.col("total_array_bytes")),
                             streams=_list("streams"), mlx=F.coalesce("mlx_version", F.lit("none"))),
        "MlxPanicTriggered": _line("MlxPanicTriggered", condition="condition"),
        "ProcFootprint": F.concat(F.format_string("ProcFootprint pid=%d %s ", "proc_pid", "name"),
                                  F.concat(F.lit("phys="), F.col("phys_footprint_bytes").cast("string")),
                                  F.concat(F.lit(" lifetime_max="), F.col("lifetime_max_phys_footprint_bytes").cast("string"))),
        "JetsamKill": F.concat_ws(" ", F.lit("JetsamKill"), F.concat(F.lit("pid="), _dash("killed_pid")), "killed_name",
                                  F.concat(F.lit("reason="), _dash("reason")),
                                  F.concat(F.lit("footprint="), binary_bytes(F.col("footprint_bytes"))),
                                  F.concat(F.lit("lifetime_max="), binary_bytes(F.col("lifetime_max_bytes")))),
        "PostMortemFlushed": _line("PostMortemFlushed", reason="reason", src="source_session", events="event_count"),
        "ModuleEntered": _line("ModuleEntered", call_id="module_call_id", name="qualname", **{"class": "class_name"},
                               parent="parent_call_id", depth="depth"),
        "ModuleReturned": _line("ModuleReturned", call_id="module_call_id"),
        "ModelLoad": _line("ModelLoad", path="path", size=size),
        "ModelUnload": _line("ModelUnload", path="path"),
    }
    text = None
    for k, expr in lines.items():
        text = F.when(kind == k, expr) if text is None else text.when(kind == k, expr)
    fallback = F.concat(kind, F.lit(" "), F.to_json(F.struct(
        "reason", "level", "message", "subsystem", "probe", "state", "summary", "path", "target_pid")))
    head = F.concat(F.lit("+"), F.col("ts_mono_ns").cast("string"), F.lit("ns  seq="), F.col("seq").cast("string"),
                    F.lit("  src="), F.col("source"), F.lit("  "))
    return events.select("session_key", "event_ord", F.concat(head, text.otherwise(fallback)).alias("line"))
