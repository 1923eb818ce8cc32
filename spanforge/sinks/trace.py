"""Trace-event rows (ph X, i, C, M) of a log, and the documents made of them.

Lanes that pair nothing come out of one projection of the log.  Scopes, command buffers
with their kernels, and model loads pair events; they read the kinds they need from a table
that is written once.  Every row has its place in its session's document: (lane, ord, sub).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.text import basename
from spanforge.operators import gpu, pairing
from spanforge.operators.scan import chunk_of, with_running
from spanforge.session_conf import cut_lineage
from spanforge.sinks.documents import document_lines, framed
from spanforge.sinks.files import fields_json

# Lanes and their names.
LANES = {1: "Python", 2: "Metal CBs", 3: "Kernels", 4: "Model Loads"}

#: Kinds that are paired, by the part of the log that holds them, and the columns that they need.
_PARTS = {
    "scopes": ("ModuleEntered", "ModuleReturned"),
    "buffers": ("MetalCbCommitted", "MetalCbScheduled", "MetalCbCompleted", "MetalCbOps"),
    "loads": ("ModelLoad",),
}
_PART_COLUMNS = ("session_key", "event_ord", "ts_mono_ns", "kind", "module_call_id", "qualname", "class_name", "parent_call_id", "depth", "fields",
                 "cb_id", "queue_id", "in_flight_ns", "label", "status", "error_code", "error_domain", "ops", "path", "sha8", "size_bytes")


def _us(ns: Column) -> Column:
    return ns / F.lit(1000.0)


def _struct(*, lane: int, ph: str, name: Column, pid: int, ord=None, sub=0, ts=None, dur=None, tid=None, args=None, cat=None,  # noqa: A002
            scope=None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(ph).alias("ph"), name.alias("name"), F.lit(pid).alias("pid"),
        (null if tid is None else tid).cast("string").alias("tid"), (null if ts is None else ts).cast("double").alias("ts"),
        (null if dur is None else dur).cast("double").alias("dur"), (null if cat is None else cat).cast("string").alias("cat"),
        F.lit(scope).cast("string").alias("s"), (null if args is None else args).cast("string").alias("args"),
        F.lit(lane).alias("lane"), (F.col("event_ord") if ord is None else ord).cast("bigint").alias("ord"),
        (F.lit(sub) if isinstance(sub, int) else sub).cast("int").alias("sub"))


def _row(df: DataFrame, **parts) -> DataFrame:
    return df.select("session_key", _struct(**parts).alias("_r")).select("session_key", "_r.*")


def _merged_args(fixed: Column, fields: Column) -> Column:
    """Fixed args with the scope's own fields added."""
    extra = fields_json(fields)
    return F.when(fields.isNull() | (F.size(fields) == 0), fixed).otherwise(
        F.concat(F.substring(fixed, F.lit(1), F.length(fixed) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra))))


def trace_rows(events: DataFrame, *, chunk: Column | None = None, ops: DataFrame | None = None) -> DataFrame:
    """All lanes of the export; durations and times in microseconds."""
    kind = F.col("kind")
    part = F.coalesce(*(F.when(kind.isin(*kinds), name) for name, kinds in _PARTS.items()))
    parts = cut_lineage(events.where(kind.isin(*(k for kinds in _PARTS.values() for k in kinds))).select(*_PART_COLUMNS, part.alias("part")), by="part")
    rows_of = lambda name: parts.where(F.col("part") == name).drop("part")
    named = F.array(*(_struct(lane=0, ph="M", name=F.lit("process_name"), pid=p, ord=F.lit(-1), sub=p, tid=F.lit(0),
                              args=F.to_json(F.struct(F.lit(n).alias("name")))) for p, n in LANES.items()))
    lanes = [events.select("session_key").distinct().select("session_key", F.inline(named)),
             events.select("session_key", F.inline(F.filter(F.array(*_single_rows()), lambda r: r.isNotNull())))]

    calls = pairing.scope_calls(rows_of("scopes"), chunk=chunk).where(F.col("ret_ts").isNotNull() & ~F.col("superseded"))
    lanes.append(_row(
        calls, lane=2, ph="X", name=F.col("qualname"), pid=1, ord=F.col("enter_ord"), tid=F.col("depth"), ts=_us(F.col("t_in")),
        dur=_us(F.col("ret_ts")) - _us(F.col("t_in")), args=_merged_args(
            F.to_json(F.struct("class_name", F.col("call_id").alias("module_call_id"))), F.col("fields"))))

    cbs = gpu.cb_events(rows_of("buffers"), chunk=chunk)
    paired = cbs.where(F.col("paired"))
    lanes.append(_row(
        paired, lane=3, ph="X", name=F.coalesce("commit_label", F.concat(F.lit("cb_"), F.col("cb_id").cast("string"))), pid=2,
        tid=F.concat(F.lit("queue_"), F.col("commit_queue_id").cast("string")), ts=_us(F.col("commit_ts")),
        dur=_us(F.col("in_flight_ns")), args=F.to_json(F.struct("cb_id", "status", "error_code", "error_domain"),
                                                      {"ignoreNullFields": "false"})))
    # kernels hang on the lifetime their ops follow, at that lifetime's commit time
    ops = gpu.clamped_ops(cbs, chunk=chunk) if ops is None else ops
    raw = cbs.where(kind == "MetalCbOps").select("session_key", "event_ord", F.col("ops").alias("raw_ops"))
    owned = (ops.where(F.col("comp_ord").isNotNull()).select("session_key", "event_ord", "comp_ord", "cb_id")
             .join(raw, ["session_key", "event_ord"])
             .join(paired.select("session_key", F.col("event_ord").alias("comp_ord"), "commit_ts"), ["session_key", "comp_ord"])
             .select("session_key", "event_ord", "cb_id", "commit_ts", F.posexplode("raw_ops").alias("i", "o")))
    lanes.append(_row(
        owned, lane=4, ph="X", name=F.coalesce("o.symbol", "o.name"), pid=3, sub=F.col("i"),
        tid=F.concat(F.lit("cb_"), F.col("cb_id").cast("string")), ts=_us(F.col("commit_ts")), dur=_us(F.col("o.gpu_ns")),
        args=F.to_json(F.struct(F.col("o.name").alias("raw_name"), F.col("o.symbol").alias("symbol"), F.col("o.count").alias("count")),
                       {"ignoreNullFields": "false"})))
    lanes.append(_load_totals(rows_of("loads"), chunk))
    return reduce(DataFrame.unionByName, lanes)


def _single_rows() -> list[Column]:
    """Rows that one event makes, each null for the events that do not."""
    kind, ts = F.col("kind"), _us(F.col("ts_mono_ns"))
    has = F.col("fields").isNotNull() & (F.size("fields") > 0)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    pct = {x: finite(F.col(f"{x}_residency_pct")) for x in ("gpu", "ane", "cpu")}
    took = F.greatest(F.lit(0).cast("bigint"), F.col("t_end_ns") - F.col("t_start_ns"))
    start = F.greatest(F.lit(0).cast("bigint"), F.col("ts_mono_ns") - took)
    io = kind == "IoReportSample"

    def instant(case: Column, sub: int, name: Column, pid: int = 1, scope: str = "g", **more) -> Column:
        return F.when(case, _struct(lane=1, ph="i", name=name, pid=pid, sub=sub, tid=F.lit(0), ts=ts, scope=scope, **more))

    def counter(case: Column, sub: int, name: str, args: Column) -> Column:
        return F.when(case, _struct(lane=5, ph="C", name=F.lit(name), pid=0, sub=sub, ts=ts, args=F.to_json(args)))

    return [
        instant(kind == "Mark", 0, F.col("label"), args=F.when(has, fields_json(F.col("fields")))),
        instant(kind == "SessionStarted", 1, F.lit("session-started")),
        instant(kind == "SessionEnded", 2, F.concat(F.lit("session-ended ("), F.col("reason"), F.lit(")"))),
        instant(kind == "ModelUnload", 3, F.concat(F.lit("unload:"), basename(F.col("path"))), pid=4, scope="p", cat=F.lit("model-unload"),
                args=F.to_json(F.struct("path", "sha8"))),
        F.when(kind == "ModelLoad", _struct(
            lane=1, ph="X", name=basename(F.col("path")), pid=4, sub=4, tid=F.lit(0), ts=_us(start), dur=_us(F.col("ts_mono_ns") - start),
            cat=F.lit("model-load"), args=F.to_json(F.struct("path", "size_bytes", "sha8", "framework")))),
        counter(kind == "MetalDeviceMemSample", 0, "gpu_memory", F.struct("allocated_bytes", F.col("recommended_max_bytes").alias("budget_bytes"))),
        counter(kind == "VmSample", 1, "system_memory", F.struct("wired_bytes", "active_bytes", "compressed_bytes", "swap_used_bytes")),
        # nulls and numbers that are not finite are left out
        counter((kind == "VmSample") & finite(F.col("page_outs_per_sec")).isNotNull(), 2, "vm_page_outs_per_sec",
                F.struct(F.col("page_outs_per_sec").alias("rate"))),
        counter(kind == "ThermalState", 3, "thermal_level", F.struct("level")),
        counter(io & F.coalesce(*pct.values()).isNotNull(), 4, "utilization_pct", F.struct(*[c.alias(k) for k, c in pct.items()])),
        counter(io & F.col("gpu_power_mw").isNotNull(), 5, "gpu_power_mw", F.struct(F.col("gpu_power_mw").alias("mw"))),
        counter(io & F.col("gpu_freq_mhz").isNotNull(), 6, "gpu_freq_mhz", F.struct(F.col("gpu_freq_mhz").alias("mhz"))),
    ]


def _load_totals(loads: DataFrame, chunk: Column | None) -> DataFrame:
    """Bytes loaded so far of each model, under the first path that it was loaded from."""
    loads = with_running(
        loads.withColumn("_key", F.coalesce("sha8", "path")), ["session_key", "_key"], ["event_ord"],
        {"_sum": ("sum", F.col("size_bytes")), "_first": ("min", F.struct("event_ord", "path"))}, chunk=chunk_of() if chunk is None else chunk)
    return _row(loads, lane=5, ph="C", name=F.concat(F.lit("model:"), basename(F.col("_first.path"))), pid=0, sub=7, ts=_us(F.col("ts_mono_ns")),
                args=F.to_json(F.struct(F.col("_sum").alias("bytes"))))


def trace_json(rows: DataFrame) -> DataFrame:
    """One JSON text per trace row, in its place; args nest as an object."""
    doc = F.struct("ph", "name", "cat", "pid", "tid", "ts", "dur", "s", F.parse_json("args").alias("args"))
    return rows.select("session_key", "lane", "ord", "sub", F.to_json(doc).alias("value"))


def trace_document_lines(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The lines of ``{traceEvents, displayTimeUnit, metadata}`` of each session, for ``write_documents``."""
    frames = framed(sessions, head=F.lit('{"traceEvents":['), foot=F.concat(F.lit('],"displayTimeUnit":"ms","metadata":'), F.col("metadata"), F.lit("}")))
    return document_lines(trace_json(rows), frames, ["lane", "ord", "sub"])
