"""Per-scope memory, allocator, footprint, timeline and over-budget windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.operators import pairing
from spanforge.operators.scan import chunk_of, with_running
from spanforge.operators.sequences import islands
from spanforge.operators.stab import interval_aggregate, stab_join
from spanforge.schema import NS_PER_SEC
from spanforge.session_conf import cut_lineage

_DEFAULT_CELL = NS_PER_SEC


def _spans(events: DataFrame, grace_ns: int, scopes: DataFrame | None) -> DataFrame:
    scopes = pairing.scope_windows(events) if scopes is None else scopes
    # an open call takes every later sample; a returned one those of its tail too
    end = F.when(F.col("ret_ts").isNotNull(), F.col("ret_ts") + grace_ns).otherwise(F.col("t_out"))
    return scopes.select("session_key", "call_id", "qualname", "enter_ord", "t_in", end.alias("t_end"))


def scope_memory_calls(events: DataFrame, *, grace_ns: int = pairing.ASYNC_GRACE_NS,
                       cell: int = _DEFAULT_CELL, scopes: DataFrame | None = None) -> DataFrame:
    """Peak, average, last and number of device samples of every scope call."""
    spans = _spans(events, grace_ns, scopes)
    samples = events.where(F.col("kind") == "MetalDeviceMemSample")
    b = F.col("allocated_bytes")
    agg = interval_aggregate(
        spans, samples, by=["session_key"], interval_key=["call_id"], lo="t_in", hi="t_end",
        ts="ts_mono_ns", after=("enter_ord", "event_ord"), cell=cell,
        aggs={"peak": ("max", b), "total": ("sum", b.cast("decimal(38,0)")),
              "n": ("sum", F.lit(1).cast("bigint")),
              "last": ("max", F.struct(F.col("event_ord").alias("ord"), b.alias("b")))})
    zero = F.lit(0).cast("bigint")
    return spans.join(agg, ["session_key", "call_id"], "left").select(
        "session_key", "call_id", "qualname", "enter_ord",
        F.coalesce("peak", zero).alias("peak_bytes"),
        F.coalesce(F.floor(F.col("total") / F.col("n")).cast("bigint"), zero).alias("avg_bytes"),
        F.coalesce("last.b", zero).alias("end_bytes"),
        F.coalesce("n", zero).alias("sample_count"))


def scope_memory(events: DataFrame, **kw) -> DataFrame:
    """Per qualified name, the call with the highest peak (earliest entered on a tie)."""
    calls = scope_memory_calls(events, **kw)
    best = calls.groupBy("session_key", "qualname").agg(F.max_by(
        F.struct("peak_bytes", "avg_bytes", "end_bytes", "sample_count"),
        F.struct("peak_bytes", -F.col("enter_ord"))).alias("b"))
    return best.select("session_key", "qualname", "b.*")


def scope_heap(events: DataFrame, *, grace_ns: int = pairing.ASYNC_GRACE_NS,
               cell: int = _DEFAULT_CELL, scopes: DataFrame | None = None,
               chunk: Column | None = None) -> DataFrame:
    """Peak live heap count and bytes of each scope; the call with most bytes per name."""
    chunk = chunk_of() if chunk is None else chunk
    # both are read several times, and the states come from a scan of a scan
    spans = cut_lineage(_spans(events, grace_ns, scopes))
    kind = F.col("kind")
    states = cut_lineage(pairing.live_allocations(
        events.select("session_key", "event_ord", "ts_mono_ns", "kind", "heap_id", "size_bytes"),
        keys=["session_key"], ident="heap_id", order="event_ord", alloc=kind == "MetalHeapAlloc",
        free=kind == "MetalHeapFree", size=F.col("size_bytes"), chunk=chunk))
    # the state a call enters into counts as well
    marks = (states.select("session_key", "event_ord", "live_count", "live_bytes",
                           F.lit(None).cast("bigint").alias("call_id"))
             .unionByName(spans.select("session_key", F.col("enter_ord").alias("event_ord"),
                                       F.lit(None).cast("bigint").alias("live_count"),
                                       F.lit(None).cast("bigint").alias("live_bytes"), "call_id")))
    entry = with_running(marks, ["session_key"], ["event_ord"],
                         {"n0": ("last", F.col("live_count")), "b0": ("last", F.col("live_bytes"))},
                         chunk=chunk).where(F.col("call_id").isNotNull()).select("session_key", "call_id", "n0", "b0")
    agg = interval_aggregate(
        spans, states, by=["session_key"], interval_key=["call_id"], lo="t_in", hi="t_end",
        ts="ts_mono_ns", after=("enter_ord", "event_ord"), cell=cell,
        aggs={"n1": ("max", F.col("live_count")), "b1": ("max", F.col("live_bytes"))})
    zero = F.lit(0).cast("bigint")
    peaks = (spans.join(entry, ["session_key", "call_id"], "left").join(agg, ["session_key", "call_id"], "left")
             .select("session_key", "qualname", "enter_ord",
                     F.greatest(F.coalesce("n0", zero), F.coalesce("n1", zero)).alias("peak_heap_count"),
                     F.greatest(F.coalesce("b0", zero), F.coalesce("b1", zero)).alias("peak_heap_bytes")))
    best = peaks.groupBy("session_key", "qualname").agg(F.max_by(
        F.struct("peak_heap_count", "peak_heap_bytes"),
        F.struct("peak_heap_bytes", -F.col("enter_ord"))).alias("b"))
    return best.select("session_key", "qualname", "b.*")


def allocator_summary(events: DataFrame) -> DataFrame:
    """The allocator's own peaks; sessions without samples have no row."""
    polls = events.where(F.col("kind") == "MlxMemoryPoll")
    return polls.groupBy("session_key").agg(
        F.max("active_bytes").alias("peak_active_bytes"), F.max("peak_bytes").alias("peak_reported_bytes"),
        F.max("cache_bytes").alias("peak_cache_bytes"), F.max_by("cache_bytes", "event_ord").alias("end_cache_bytes"),
        F.count(F.lit(1)).alias("sample_count"))


def footprint_summary(events: DataFrame) -> DataFrame:
    """Footprint per process; name and root flag are those of its first sample."""
    rows = events.where(F.col("kind") == "ProcFootprint")
    return rows.groupBy("session_key", F.col("proc_pid").alias("pid")).agg(
        F.min_by("name", "event_ord").alias("name"), F.max("phys_footprint_bytes").alias("peak_bytes"),
        F.max("lifetime_max_phys_footprint_bytes").alias("lifetime_max_bytes"),
        F.min_by("is_traced_root", "event_ord").alias("is_traced_root"),
        F.count(F.lit(1)).alias("sample_count"))


def session_start(events: DataFrame) -> DataFrame:
    return events.groupBy("session_key").agg(F.min_by("ts_mono_ns", "event_ord").alias("t0"))


def memory_timeline(events: DataFrame, *, bucket_seconds: int = 10,
                    unit_per_second: int = NS_PER_SEC) -> DataFrame:
    """Dense time buckets from the session's first event to the last sampled bucket."""
    width_s = max(1, bucket_seconds)
    width = width_s * unit_per_second
    kind = F.col("kind")
    rows = events.where(kind.isin("MlxMemoryPoll", "MetalDeviceMemSample")).join(session_start(events), "session_key")
    rel = F.greatest(F.lit(0).cast("bigint"), F.col("ts_mono_ns") - F.col("t0"))
    rows = rows.withColumn("bucket", F.call_function("div", rel, F.lit(width)))
    poll = kind == "MlxMemoryPoll"
    peaks = rows.groupBy("session_key", "bucket").agg(
        F.max(F.when(poll, F.col("active_bytes"))).alias("active_bytes"),
        F.max(F.when(poll, F.col("cache_bytes"))).alias("cache_bytes"),
        F.max(F.when(~poll, F.col("allocated_bytes"))).alias("device_alloc_bytes"),
        F.max(F.when(~poll, F.col("recommended_max_bytes"))).alias("recommended_max_bytes"))
    dense = (peaks.groupBy("session_key").agg(F.max("bucket").alias("_last"))
             .select("session_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("bucket")))
    zero = F.lit(0).cast("bigint")
    return dense.join(peaks, ["session_key", "bucket"], "left").select(
        "session_key", (F.col("bucket") * width_s).alias("t_start_s"),
        ((F.col("bucket") + 1) * width_s).alias("t_end_s"),
        *[F.coalesce(c, zero).alias(c) for c in
          ("active_bytes", "cache_bytes", "device_alloc_bytes", "recommended_max_bytes")])


def open_scope_at(events: DataFrame, points: DataFrame, *, scopes: DataFrame | None = None) -> DataFrame:
    """Innermost scope still open (no tail) at each point, by log position.

    Positions, not times, decide: a scope is open from its enter up to the row
    of its return.
    """
    scopes = pairing.scope_windows(events) if scopes is None else scopes
    spans = scopes.select("session_key", "enter_ord", "qualname",
                          F.coalesce(F.col("ret_ord") - 1, F.col("end_ord")).alias("ret_ord"))
    return stab_join(points, spans, by=["session_key"], ts="event_ord", lo="enter_ord", hi="ret_ord",
                     prefer=F.col("enter_ord"), keep=["qualname"], cell=4096, name="scope")


def over_budget_windows(events: DataFrame, *, threshold: float = 0.9, gap_ns: int = 5 * NS_PER_SEC,
                        scopes: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """Spans of device samples at or above ``threshold`` of the budget.

    Samples more than ``gap_ns`` apart start a new span; each span reports its
    first maximum and the innermost scope open there.
    """
    chunk = chunk_of() if chunk is None else chunk
    samples = events.where((F.col("kind") == "MetalDeviceMemSample") & (F.col("recommended_max_bytes") != 0))
    ratio = F.try_divide(F.col("allocated_bytes").cast("double"), F.col("recommended_max_bytes"))
    peak = F.max_by(F.struct(
        F.col("allocated_bytes").alias("peak_bytes"), F.col("ts_mono_ns").alias("peak_ts_mono_ns"),
        F.col("seq").alias("peak_seq"), "recommended_max_bytes", "event_ord"),
        F.struct("allocated_bytes", -F.col("event_ord")))
    spans = islands(samples, keys=["session_key"], order="event_ord", ts="ts_mono_ns",
                    keep=ratio >= threshold, gap=gap_ns, chunk=chunk,
                    aggs=[F.min("ts_mono_ns").alias("start_ts_mono_ns"),
                          F.max("ts_mono_ns").alias("end_ts_mono_ns"), peak.alias("p")])
    spans = cut_lineage(spans.select("session_key", "island", "start_ts_mono_ns", "end_ts_mono_ns", "p.*"))
    with_scope = open_scope_at(events, spans, scopes=scopes)
    return with_scope.withColumns({
        "peak_scope": F.coalesce("scope.qualname", F.lit("<unscoped>")),
        "peak_ratio": F.col("peak_bytes").cast("double") / F.col("recommended_max_bytes")}).drop("scope")


def timeline_windows(events: DataFrame, *, unit_per_second: int = NS_PER_SEC, **kw) -> DataFrame:
    """Over-budget windows in whole seconds from the session start."""
    w = over_budget_windows(events, **kw).join(session_start(events), "session_key")

    def rel(c):
        return F.call_function("div", F.greatest(F.lit(0).cast("bigint"), F.col(c) - F.col("t0")), F.lit(unit_per_second))

    return w.select("session_key", "island", rel("start_ts_mono_ns").alias("t_start_s"),
                    rel("end_ts_mono_ns").alias("t_end_s"), "peak_bytes",
                    F.round(F.col("peak_ratio") * 100).cast("bigint").alias("peak_pct"), "peak_scope")
